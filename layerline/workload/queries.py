"""One query per operator, each over whole tables.

Timestamps and dates are returned as text, so that results compare alike across engines.
Stored layers go below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from layerline.functions import match_result
from layerline.operators import matches, messages as msg, quality, responses
from layerline.operators.cleaning import keep_latest, require
from layerline.operators.roles import role_join
from layerline.plans import gold, silver
from layerline.schemas import BRONZE, BRONZE_WITH_REJECTS, EVENT, LATEST_FIRST, MESSAGE, REQUIRED, RESPONSE, SILVER
from layerline.session import scratch_path
from layerline.sources import snapshots
from layerline.sources.files import read_documents, read_landed, read_table, stream_documents, stream_landed, write_partitioned
from layerline.sources.tables import as_table, as_view, publish_table, read_relation
from layerline.streaming.batches import compact, drop_batches, folder_sink, read_batches, start_batches, start_delivery
from layerline.streaming.bronze import start_append, start_bronze
from layerline.streaming.counters import DeliveryCounters, read_counters
from layerline.streaming.silver import start_silver
from layerline.workload.tables import (
    bronze_events, damaged, land, landed_responses, match_responses, messages, repairable, table
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEQUENCED_RESPONSE = StructType([*RESPONSE.fields]).add("sequence", "long")


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def plain(df: DataFrame) -> DataFrame:
    patterns = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd HH:mm:ss", "timestamp_ntz": "yyyy-MM-dd HH:mm:ss"}
    return df.select(*[
        F.date_format(name, patterns[kind]).alias(name) if kind in patterns else F.col(name)
        for name, kind in df.dtypes
    ])


def _stored_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.write_silver(bronze_events(spark, sf_dir), scratch_path(spark, "silver"))


def _stored_teams(stg: DataFrame) -> DataFrame:
    path = scratch_path(stg.sparkSession, "dim_teams")
    gold.dim_teams(stg).write.parquet(path)
    return read_table(stg.sparkSession, path)


def _own_schema(label: str) -> str:
    """A schema name of this call alone: the calls of one session do not replace each other's tables."""
    return f"layerline_{label}_{uuid.uuid4().hex[:12]}"


# Scans and landed documents


@query
def src_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("ship_year", F.year("l_shipdate"))
    path = scratch_path(spark, "lineitem")
    write_partitioned(lines, path, "ship_year")
    return plain(read_table(spark, path, lines.schema))


@query
def src_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "landed")
    match_responses(bronze_events(spark, sf_dir)).write.json(path)
    return matches.normalize_matches(matches.explode_documents(read_documents(spark, path))).drop("ingested_at")


@query
def norm_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "responses")
    match_responses(bronze_events(spark, sf_dir)).write.parquet(path)
    return matches.normalize_matches(matches.explode_documents(read_table(spark, path))).drop("ingested_at")


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several matches per response, some damaged, read back from both kinds of files."""
    root = scratch_path(spark, "landed_responses")
    land(landed_responses(bronze_events(spark, sf_dir)), root)
    both = read_landed(spark, f"{root}/lines").withColumn("layout", F.lit("lines")).unionByName(
        read_landed(spark, f"{root}/files", whole_files=True).withColumn("layout", F.lit("files"))
    )
    # The layout is carried as a part of the file's name, as any caller could.
    return both.select("value", F.concat_ws(" ", "layout", "source_file").alias("source_file"))


def _layout() -> Column:
    return F.substring_index("source_file", " ", 1).alias("layout")


@query
def response_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = responses.decode_responses(_landed(spark, sf_dir))
    return responses.response_counts(decoded, by=[_layout()])


@query
def document_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = responses.decode_responses(_landed(spark, sf_dir), SEQUENCED_RESPONSE, keep=["sequence"])
    rejected = responses.document_rejects(responses.unfold_responses(decoded, keep=["sequence"]), keep=["sequence"])
    # The number of a response that did not decode is read from its text, where that still has it.
    written = F.regexp_extract("raw_value", r'"sequence"\s*:\s*(\d+)', 1).try_cast("long")
    return rejected.select(
        _layout(), F.coalesce("sequence", written).alias("sequence"), "position", "error_reason",
        F.get_json_object("raw_value", "$.utcDate").alias("utc_date"),
    )


@query
def norm_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    unfolded = responses.unfold_responses(responses.decode_responses(_landed(spark, sf_dir)))
    return matches.normalize_matches(responses.good_documents(unfolded)).drop("ingested_at")


# Selections and counts


@query
def select_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = bronze_events(spark, sf_dir).select(*EVENT.names)
    return matches.select_matches(events, competitions=["PL", "CL", "BL1"], status="SCHEDULED")


@query
def select_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.select_matches(bronze_events(spark, sf_dir).select(*EVENT.names), status="LIVE")


@query
def select_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.select_matches(bronze_events(spark, sf_dir).select(*EVENT.names), match_id=8)


@query
def counts_by_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.counts_by(bronze_events(spark, sf_dir), "competition_code")


# Messages


@query
def msg_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msg.encode(bronze_events(spark, sf_dir), columns=EVENT.names)


@query
def msg_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(msg.decode(messages(bronze_events(spark, sf_dir))).drop("error_reason", "raw_value"))


@query
def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msg.delivery_counts(msg.decode(damaged(messages(bronze_events(spark, sf_dir)))))


@query
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = msg.decode(damaged(messages(bronze_events(spark, sf_dir))))
    return msg.dead_letters(msg.rejects(decoded)).select(
        "key",
        F.get_json_object("value", "$.error_reason").alias("error_reason"),
        F.get_json_object("value", "$.original_event").alias("original_event"),
    )


# Silver


@query
def clean_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(require(bronze_events(spark, sf_dir), REQUIRED))


@query
def dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = require(bronze_events(spark, sf_dir), REQUIRED)
    return plain(keep_latest(cleaned, ["event_id"], LATEST_FIRST))


@query
def dedup_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    newest = ["l_shipdate", *[name for name in lines.columns if name not in ("l_orderkey", "l_shipdate")]]
    return plain(keep_latest(lines, ["l_orderkey"], newest))


@query
def silver_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(silver.to_silver(bronze_events(spark, sf_dir)))


@query
def snk_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_stored_silver(spark, sf_dir))


@query
def silver_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    bronze = bronze_events(spark, sf_dir)
    stored = silver.write_silver(bronze, scratch_path(spark, "silver"))
    return silver.silver_counts(bronze, stored)


@query
def silver_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, bronze = scratch_path(spark, "silver_snapshots"), bronze_events(spark, sf_dir)
    silver.replace_silver(bronze.where("kafka_offset % 2 = 0"), path)
    return plain(silver.replace_silver(bronze, path))


# Gold


@query
def gold_stg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stg = as_view(gold.staging(silver.to_silver(bronze_events(spark, sf_dir))), "layerline_stg_match_events")
    return plain(stg)


@query
def gold_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.by_name(gold.dim_teams(silver.to_silver(bronze_events(spark, sf_dir))))


@query
def gold_fct(spark: SparkSession, sf_dir: str) -> DataFrame:
    stg = gold.staging(_stored_silver(spark, sf_dir))
    return plain(gold.fct_match_events(stg, _stored_teams(stg)))


@query
def gold_fct_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    stg = gold.staging(_stored_silver(spark, sf_dir))
    schema, path = _own_schema("gold"), scratch_path(spark, "gold")
    fact = gold.bucketed_fact(stg, _stored_teams(stg), schema, path, buckets=8)
    return plain(publish_table(fact, f"{schema}.fct_match_events", f"{path}/fct_match_events", by="match_date"))


@query
def case_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = match_result("score_home", "score_away").alias("result")
    return bronze_events(spark, sf_dir).select("kafka_offset", "score_home", "score_away", outcome)


@query
def role_join_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    orders, customer, supplier, nation = (
        table(spark, sf_dir, name) for name in ("orders", "customer", "supplier", "nation")
    )
    facts = role_join(lines, orders, {"order": "l_orderkey"}, "o_orderkey", {"order": {"o_custkey": "custkey"}})
    facts = role_join(facts, customer, {"buyer": "custkey"}, "c_custkey", {"buyer": {"c_nationkey": "buyer_key"}})
    facts = role_join(facts, supplier, {"seller": "l_suppkey"}, "s_suppkey", {"seller": {"s_nationkey": "seller_key"}})
    return role_join(
        facts,
        nation,
        {"buyer": "buyer_key", "seller": "seller_key"},
        "n_nationkey",
        {"buyer": {"n_name": "buyer_nation"}, "seller": {"n_name": "seller_nation"}},
    )


# Quality rules


@query
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unique_by_hash(bronze_events(spark, sf_dir), "event_id")


@query
def dq_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(quality.not_null(bronze_events(spark, sf_dir), "match_id"))


@query
def dq_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [rule for rule in gold.SILVER_RULES if rule.kind == "accepted_values"]
    events = bronze_events(spark, sf_dir)
    found = [
        rule.failing(events).select(F.lit(rule.column).alias("field"), F.col(rule.column).alias("value"), "n")
        for rule in rules
    ]
    return found[0].unionByName(found[1])


@query
def dq_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.run_checks(
        table(spark, sf_dir, "orders"),
        [
            quality.Rule("unique", "o_orderkey"),
            quality.Rule("unique", "o_custkey"),
            quality.Rule("not_null", "o_orderdate"),
            quality.Rule("accepted_values", "o_orderstatus", ("O", "F")),
        ],
    )


@query
def dq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.run_checks(bronze_events(spark, sf_dir), gold.SILVER_RULES)


@query
def dq_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = gold.dim_teams(silver.to_silver(bronze_events(spark, sf_dir)))
    return quality.run_checks(teams, gold.DIMENSION_RULES)


# Streams


def _message_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(MESSAGE).parquet(path)


@query
def st_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "st_bronze")
    messages(bronze_events(spark, sf_dir)).write.parquet(f"{root}/topic")
    start_bronze(_message_stream(spark, f"{root}/topic"), f"{root}/bronze", f"{root}/log", None).awaitTermination()
    return plain(read_table(spark, f"{root}/bronze", BRONZE).drop("ingestion_date"))


@query
def st_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "st_restart")
    sent = messages(bronze_events(spark, sf_dir))
    # Three runs on one checkpoint: the first part, the rest, and nothing new.
    for part in (sent.where("partition = 0"), sent.where("partition <> 0"), None):
        if part is not None:
            part.write.mode("append").parquet(f"{root}/topic")
        stream = _message_stream(spark, f"{root}/topic")
        start_bronze(stream, f"{root}/bronze", f"{root}/log", None).awaitTermination()
    return plain(read_table(spark, f"{root}/bronze", BRONZE).drop("ingestion_date"))


@query
def st_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "st_ingest")
    match_responses(bronze_events(spark, sf_dir)).write.json(f"{root}/landed")
    documents = matches.explode_documents(stream_documents(spark, f"{root}/landed"))
    events = matches.select_matches(matches.normalize_matches(documents), ["PL", "CL", "BL1"], "SCHEDULED")
    start_append(msg.encode(events), f"{root}/topic", f"{root}/log").awaitTermination()
    sent = read_table(spark, f"{root}/topic")
    return sent.select("key", F.inline(F.array(F.from_json("value", EVENT)))).drop("ingested_at")


@query
def st_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "st_rejects")
    damaged(messages(bronze_events(spark, sf_dir))).write.parquet(f"{root}/topic")
    stream = _message_stream(spark, f"{root}/topic")
    start_bronze(stream, f"{root}/bronze", f"{root}/log", None, keep_rejects=True).awaitTermination()
    return msg.delivery_counts(read_table(spark, f"{root}/bronze", BRONZE_WITH_REJECTS))


@query
def st_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "st_delivery")
    damaged(messages(bronze_events(spark, sf_dir))).write.parquet(f"{root}/topic")
    # The second run finds nothing new and sends nothing again.
    for _ in range(2):
        stream = _message_stream(spark, f"{root}/topic")
        start_delivery(stream, f"{root}/bronze", f"{root}/letters", f"{root}/log", None).awaitTermination()
    letters = read_table(spark, f"{root}/letters")
    return letters.select(
        "key",
        F.get_json_object("value", "$.error_reason").alias("error_reason"),
        F.get_json_object("value", "$.original_event").alias("original_event"),
    )


# Rows of one landed file; a larger part has several.
FILE_ROWS = 50_000


def _in_parts(rows: DataFrame, path: str, parts: int, column: str) -> int:
    """Land rows as equally many files per remainder of a column, one part after the other, so that each part can be a
    batch of its own. Returns the files of a part.
    """
    sizes = {row["part"]: row["n"] for row in rows.groupBy((F.col(column) % parts).alias("part")).agg(F.count("*").alias("n")).collect()}
    files = max(1, min(-(-n // FILE_ROWS) for n in sizes.values())) if len(sizes) == parts else 1
    for part in range(parts):
        own = rows.where(F.col(column) % parts == part)
        # Dealt in turn, so that no file is empty.
        own = own.repartition(files) if files > 1 else own.coalesce(1)
        own.write.mode("append").parquet(path)
    return files


@query
def st_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "st_batches")
    files = _in_parts(messages(bronze_events(spark, sf_dir)), f"{root}/topic", 3, "offset")
    reader = spark.readStream.schema(MESSAGE).options(
        maxFilesPerTrigger=files, cleanSource="archive", sourceArchiveDir=f"{root}/archive")
    start_delivery(reader.parquet(f"{root}/topic"), f"{root}/bronze", f"{root}/letters", f"{root}/log", None).awaitTermination()
    return plain(read_batches(spark, f"{root}/bronze").drop("ingestion_date", "error_reason", "raw_value"))


@query
def st_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "st_counters")
    files = _in_parts(repairable(damaged(messages(bronze_events(spark, sf_dir)))), f"{root}/topic", 3, "offset")
    counters = DeliveryCounters(spark, f"{root}/counters")
    spark.streams.addListener(counters)
    try:
        reader = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files)
        run = start_delivery(reader.parquet(f"{root}/topic"), f"{root}/bronze", f"{root}/letters", f"{root}/log", None)
        run.awaitTermination()
        counters.wait(run)
    finally:
        spark.streams.removeListener(counters)
    counts = [F.sum(name).alias(name) for name in ("total", "ok", "repaired", "failed")]
    return read_counters(spark, f"{root}/counters").agg(F.count("*").alias("batches"), *counts)


@query
def st_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "st_silver")
    files = _in_parts(bronze_events(spark, sf_dir), f"{root}/bronze", 3, "kafka_offset")
    bronze = spark.readStream.schema(BRONZE).option("maxFilesPerTrigger", files).parquet(f"{root}/bronze")
    start_silver(bronze, f"{root}/silver", f"{root}/log").awaitTermination()
    return plain(snapshots.read_snapshot(spark, f"{root}/silver", SILVER))


@query
def st_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "st_documents")
    land(landed_responses(bronze_events(spark, sf_dir)), f"{root}/landed")
    decoded = responses.decode_responses(stream_landed(spark, f"{root}/landed/lines"))
    events = lambda rows: msg.encode(matches.normalize_matches(responses.good_documents(rows)))
    letters = lambda rows: responses.reject_letters(responses.document_rejects(rows))
    sinks = [folder_sink(f"{root}/topic", prepare=events), folder_sink(f"{root}/letters", prepare=letters)]
    start_batches(responses.unfold_responses(decoded), sinks, f"{root}/log").awaitTermination()
    body = lambda field: F.get_json_object("value", f"$.{field}")
    sent = read_table(spark, f"{root}/topic").select("key", body("event_id").alias("event_id"), F.lit("ok").alias("outcome"))
    lost = read_table(spark, f"{root}/letters").select("key", F.lit(None).cast("string"), body("error_reason"))
    return sent.union(lost)


@query
def bronze_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, bronze = scratch_path(spark, "bronze_compacted"), bronze_events(spark, sf_dir)
    write = folder_sink(f"{root}/batches", ["ingestion_date"])
    # Batches of ten days each, the first one twice.
    for number, days in enumerate(("< 11", "< 11", "BETWEEN 11 AND 20", "> 20")):
        write(bronze.where(f"day(ingestion_date) {days}"), max(0, number - 1))
    compact(spark, root, BRONZE)
    drop_batches(spark, root, 0)
    return plain(read_batches(spark, root, BRONZE))


# Loads and the whole way


@query
def load_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _own_schema("raw")
    name = f"{schema}.match_events"
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema} LOCATION '{scratch_path(spark, 'schema')}'")
    as_table(silver.to_silver(bronze_events(spark, sf_dir)), name, scratch_path(spark, "load"))
    return plain(gold.staging(read_relation(spark, name)))


@query
def end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "end_to_end")
    match_responses(bronze_events(spark, sf_dir)).write.json(f"{root}/landed")
    landed = stream_documents(spark, f"{root}/landed", SEQUENCED_RESPONSE)
    events = matches.normalize_matches(matches.explode_documents(landed, keep=["sequence"]), keep=["sequence"])
    numbered = events.withColumnsRenamed({"sequence": "kafka_offset"}).withColumns(
        {"kafka_partition": F.lit(0), "kafka_timestamp": F.current_timestamp()}
    )
    start_append(messages(numbered), f"{root}/topic", f"{root}/topic_log").awaitTermination()
    stream = _message_stream(spark, f"{root}/topic")
    start_bronze(stream, f"{root}/bronze", f"{root}/bronze_log", None).awaitTermination()
    stored = silver.write_silver(read_table(spark, f"{root}/bronze", BRONZE), f"{root}/silver")
    stg = gold.staging(stored)
    return plain(gold.fct_match_events(stg, _stored_teams(stg)).drop("ingested_at"))
