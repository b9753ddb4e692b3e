"""Command-line jobs for spark-submit: ``python -m layerline.jobs <job> --help``.

``ingest`` publishes landed JSON to a topic and sets aside what it cannot read, ``bronze`` lands a topic and its broken
messages, ``publish-letters`` sends new dead letters to another topic, ``publish-rejects`` those of a range of dates,
``compact`` gathers closed dates of bronze into fewer files, ``silver`` rewrites the clean table or keeps it up to date,
``gold`` builds the dimension and the fact, ``check`` runs the rules, ``load`` replaces a database table.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from layerline.operators import responses
from layerline.operators.matches import normalize_matches, select_matches
from layerline.operators.messages import dead_letters, encode, rejects
from layerline.operators.quality import run_checks
from layerline.plans import gold, silver
from layerline.schemas import BRONZE, BRONZE_WITH_REJECTS, SILVER
from layerline.session import build_session, scratch_path
from layerline.sources import jdbc, kafka, paths, snapshots
from layerline.sources.files import ANY_AGE, read_table, stream_landed
from layerline.sources.tables import as_view, publish_table
from layerline.streaming.batches import compact, drop_batches, folder_sink, read_batches, start_batches, start_delivery
from layerline.streaming.bronze import TRIGGER_SECONDS, start_bronze
from layerline.streaming.counters import DeliveryCounters
from layerline.streaming.silver import start_silver

# The competitions and the status that are ingested, and the seconds between cycles.
COMPETITIONS = ("PL", "CL", "BL1")
STATUS = "SCHEDULED"
CYCLE_SECONDS = 60


def _pairs(given: list[str]) -> dict[str, str]:
    """Connector options given as ``name=value``."""
    return dict(pair.split("=", 1) for pair in given)


def _bounds(args: argparse.Namespace) -> dict[str, str]:
    """Bounds of a batch of files, and where the files of finished batches go."""
    options = {"maxFilesPerTrigger": args.max_files or None, "maxBytesPerTrigger": args.max_bytes or None}
    if args.archive:
        options |= {"cleanSource": "archive", "sourceArchiveDir": args.archive}
    return {name: str(value) for name, value in options.items() if value}


def _interval(args: argparse.Namespace) -> str | None:
    return None if args.once else f"{args.seconds} seconds"


def ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    landed = stream_landed(spark, args.landed, args.whole_files, **_bounds(args))
    options = _pairs(args.option)

    def events(batch: DataFrame, number: int) -> None:
        chosen = select_matches(normalize_matches(responses.good_documents(batch)), args.competitions, args.status)
        kafka.publish(encode(chosen), args.servers, args.topic, **options)

    def letters(batch: DataFrame) -> DataFrame:
        return responses.reject_letters(responses.document_rejects(batch))

    # Letters come first: they replace their own batch, while events of a batch that is run again are sent again.
    sinks = [folder_sink(args.letters or f"{args.checkpoint}_letters", prepare=letters), events]
    rows = responses.unfold_responses(responses.decode_responses(landed))
    start_batches(rows, sinks, args.checkpoint, _interval(args)).awaitTermination()
    return 0


def bronze(spark: SparkSession, args: argparse.Namespace) -> int:
    bounds = {"maxOffsetsPerTrigger": args.max_offsets, "minPartitions": args.min_partitions}
    options = {name: str(value) for name, value in bounds.items() if value} | _pairs(args.option)
    stream = kafka.stream_topic(spark, args.servers, args.topic, **options)
    if args.append:
        run = start_bronze(stream, args.bronze, args.checkpoint, _interval(args), args.keep_rejects, args.max_writers)
    else:
        if args.counters:
            spark.streams.addListener(DeliveryCounters(spark, args.counters))
        run = start_delivery(
            stream, args.bronze, args.letters or f"{args.bronze}_letters", args.checkpoint, _interval(args), args.max_writers)
    run.awaitTermination()
    return 0


def publish_letters(spark: SparkSession, args: argparse.Namespace) -> int:
    """Publish the letters that came since the last run of this checkpoint."""
    letters = spark.readStream.schema("key string, value string").options(
        maxFileAge=ANY_AGE, ignoreMissingFiles="true", **_bounds(args)
    ).parquet(args.letters)
    options = _pairs(args.option)
    send = lambda batch, number: kafka.publish(batch.select("key", "value"), args.servers, args.topic, **options)
    start_batches(letters, [send], args.checkpoint, _interval(args)).awaitTermination()
    return 0


def publish_rejects(spark: SparkSession, args: argparse.Namespace) -> int:
    """Publish the rejects in bronze; refused where bronze has no texts, as after ``--append`` without ``--keep-rejects``."""
    if paths.exists(spark, f"{args.bronze}/batches"):
        landed = read_batches(spark, args.bronze, BRONZE_WITH_REJECTS, args.start, args.end)
    else:
        if not {"error_reason", "raw_value"} <= set(spark.read.parquet(args.bronze).columns):
            raise ValueError(f"{args.bronze} holds no text of rejects: run bronze with --keep-rejects")
        landed = read_table(spark, args.bronze, BRONZE_WITH_REJECTS, "ingestion_date", args.start, args.end)
    kafka.publish(dead_letters(rejects(landed)), args.servers, args.topic)
    return 0


def compact_bronze(spark: SparkSession, args: argparse.Namespace) -> int:
    print("compacted:", *compact(spark, args.bronze))
    if args.drop_after:
        print("batches dropped:", *drop_batches(spark, args.bronze, args.drop_after))
    return 0


def _read_bronze(spark: SparkSession, path: str) -> DataFrame:
    """Bronze as batches and compacted dates, or as one directory of dates."""
    in_batches = any(paths.exists(spark, f"{path}/{folder}") for folder in ("batches", "compacted"))
    return read_batches(spark, path, BRONZE) if in_batches else read_table(spark, path, BRONZE)


def _read_silver(spark: SparkSession, path: str) -> DataFrame:
    if paths.exists(spark, f"{path}/{snapshots.LISTS}"):
        return snapshots.read_snapshot(spark, path, SILVER)
    return read_table(spark, path, SILVER)


def rewrite_silver(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.checkpoint:
        options = {"maxFileAge": ANY_AGE, "ignoreMissingFiles": "true", **_bounds(args)}
        rows = spark.readStream.schema(BRONZE).options(**options).parquet(f"{args.bronze}/batches").select(*BRONZE.names)
        start_silver(rows, args.silver, args.checkpoint, _interval(args)).awaitTermination()
    else:
        source = _read_bronze(spark, args.bronze)
        stored = silver.replace_silver(source, args.silver)
        silver.silver_counts(source, stored).show()
    if args.drop_after:
        print("folders dropped:", snapshots.drop_unlisted(spark, args.silver, "match_date", args.drop_after))
    return 0


def build_gold(spark: SparkSession, args: argparse.Namespace) -> int:
    stg = as_view(gold.staging(_read_silver(spark, args.silver)), "stg_match_events")

    def place(table: str) -> str | None:
        return f"{args.path}/{table}" if args.path else None

    teams = publish_table(gold.dim_teams(stg), f"{args.schema}.dim_teams", place("dim_teams"))
    if args.buckets:
        fact = gold.bucketed_fact(stg, teams, args.schema, args.path or scratch_path(spark, "gold"), args.buckets)
    else:
        fact = gold.fct_match_events(stg, teams)
    publish_table(fact, f"{args.schema}.fct_match_events", place("fct_match_events"), by="match_date")
    return 0


def check(spark: SparkSession, args: argparse.Namespace) -> int:
    stored = _read_silver(spark, args.silver)
    teams = gold.dim_teams(gold.staging(stored))
    # One row per rule.
    results = run_checks(stored, gold.SILVER_RULES).collect() + run_checks(teams, gold.DIMENSION_RULES).collect()
    for row in results:
        print(row.rule, "ok" if row.passed else f"{row.failures} failures in {row.rows_affected} rows")
    return 0 if all(row.passed for row in results) else 1


def load(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.driver and "." in args.table:
        jdbc.connect_catalog(spark, "target", args.url, args.driver)
        jdbc.create_schema(spark, "target", args.table.rpartition(".")[0])
    options = {"driver": args.driver} if args.driver else {}
    source = _read_silver(spark, args.silver)
    sent = source.count()
    # A replace-load can be repeated; see write_jdbc for why the counts may differ.
    for _ in range(args.attempts):
        jdbc.write_jdbc(source, args.url, args.table, args.writers, **options)
        loaded = jdbc.count_jdbc(spark, args.url, args.table, **options).first()[0]
        print(f"{loaded} of {sent} rows, {len(source.columns)} columns in {args.table}")
        if loaded == sent:
            return 0
    return 1


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="layerline.jobs", description=__doc__)
    jobs = top.add_subparsers(required=True)

    def job(name: str, run, *required: str, **optional) -> None:
        sub = jobs.add_parser(name)
        for flag in required:
            sub.add_argument(f"--{flag}", required=True)
        for flag, default in optional.items():
            kind = {"action": "store_true"} if default is False else {"default": default, "type": str if default is None else type(default)}
            if isinstance(default, tuple):
                kind = {"default": list(default), "nargs": "+"}
            sub.add_argument(f"--{flag.replace('_', '-')}", **kind)
        sub.set_defaults(run=run)

    files = {"max_files": 0, "max_bytes": 0, "archive": None}
    job("ingest", ingest, "landed", "servers", "topic", "checkpoint", competitions=COMPETITIONS, status=STATUS,
        letters=None, whole_files=False, once=False, seconds=CYCLE_SECONDS, option=(), **files)
    job("bronze", bronze, "servers", "topic", "bronze", "checkpoint", seconds=TRIGGER_SECONDS, once=False,
        keep_rejects=False, max_writers=0, append=False, letters=None, counters=None, max_offsets=0, min_partitions=0,
        option=())
    job("publish-letters", publish_letters, "letters", "servers", "topic", "checkpoint", once=False,
        seconds=TRIGGER_SECONDS, option=(), **files)
    job("publish-rejects", publish_rejects, "bronze", "servers", "topic", start=None, end=None)
    job("compact", compact_bronze, "bronze", drop_after=0)
    job("silver", rewrite_silver, "bronze", "silver", checkpoint=None, once=False, seconds=TRIGGER_SECONDS, drop_after=0, **files)
    job("gold", build_gold, "silver", schema="analytics", path=None, buckets=0)
    job("check", check, "silver")
    job("load", load, "silver", "url", table="raw.match_events", driver=None, writers=16, attempts=3)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(build_session(f"layerline-{args.run.__name__}"), args)


if __name__ == "__main__":
    sys.exit(main())
