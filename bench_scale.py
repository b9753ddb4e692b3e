"""Time the layer builders on many copies of the match records with hot keys.

    python bench_scale.py [copies]

A third of the rows share one event id and one date, another third one home team. Each step is also
timed in the plain form that it replaces. Data goes below ``spark.checkpoint.dir``; one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, Window, functions as F  # noqa: E402

from layerline.operators import messages as msg  # noqa: E402
from layerline.operators.cleaning import keep_latest, require  # noqa: E402
from layerline.operators.quality import run_checks  # noqa: E402
from layerline.plans import gold, silver  # noqa: E402
from layerline.schemas import BRONZE, LATEST_FIRST, MESSAGE, REQUIRED, SILVER  # noqa: E402
from layerline.session import build_session, scratch_path  # noqa: E402
from layerline.sources.files import read_table, write_partitioned  # noqa: E402
from layerline.workload.tables import bronze_events, damaged, messages  # noqa: E402


def skewed(spark: SparkSession, sf_dir: str, copies: int) -> DataFrame:
    copy = F.col("copy")
    rows = bronze_events(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    hot = copy % 3 == 0
    return rows.withColumns({
        "kafka_offset": F.col("kafka_offset") * copies + copy,
        "event_id": F.when(hot, "hot").otherwise(F.concat("event_id", F.lit("-"), (copy % 20).cast("string"))),
        "utc_date": F.when(hot, "2024-01-05T03:00:00Z").otherwise(F.col("utc_date")),
        "home_team_id": F.when(copy % 3 == 1, 7).otherwise(F.col("home_team_id")),
        "home_team_name": F.when(copy % 3 == 1, "Team 7").otherwise(F.col("home_team_name")),
    }).drop("copy")


def run_all(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def plain_dedup(df: DataFrame) -> DataFrame:
    newest = [F.col(name).desc() for name in LATEST_FIRST]
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy(*newest))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def plain_dimension(stg: DataFrame) -> DataFrame:
    home, away = (
        stg.select(F.col(f"{side}_team_id").alias("team_id"), F.col(f"{side}_team_name").alias("team_name"))
        .where("team_id IS NOT NULL")
        .distinct()
        for side in ("home", "away")
    )
    return home.union(away).distinct()


def counted_silver(bronze: DataFrame, path: str) -> None:
    """The silver job with a separate count of each intermediate frame."""
    clean = require(bronze, REQUIRED)
    typed = silver.to_silver(bronze)
    for frame in (bronze, clean, typed, typed):
        frame.count()
    write_partitioned(typed, path, "match_date", rebalance=False)


def main() -> None:
    copies = int(sys.argv[1]) if len(sys.argv) > 1 else 200
    cpus = os.environ.get("BENCH_CPUS", "8")
    memory = os.environ.get("BENCH_MEMORY", "12g")
    spark = build_session(
        "bench-scale",
        f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.driver.memory": memory, "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    root = scratch_path(spark, "bench_scale")
    source = skewed(spark, os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), copies)
    source.repartition(64).write.parquet(f"{root}/bronze")
    bronze = read_table(spark, f"{root}/bronze", BRONZE)
    damaged(messages(bronze)).write.parquet(f"{root}/topic")
    topic = read_table(spark, f"{root}/topic", MESSAGE)
    clean = require(bronze, REQUIRED)
    silver.write_silver(bronze, f"{root}/silver")
    stored = read_table(spark, f"{root}/silver", SILVER)
    # The dimension over all of bronze: silver is too small here to show a difference.
    stg = bronze.select("home_team_id", "home_team_name", "away_team_id", "away_team_name")
    gold.dim_teams(gold.staging(stored)).write.parquet(f"{root}/dim")
    wide = silver.with_times(bronze, "utc_date", "match_timestamp", "match_date")

    def facts() -> DataFrame:
        return gold.fct_match_events(gold.staging(wide), read_table(spark, f"{root}/dim"))

    def shuffled_facts() -> None:
        threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            run_all(facts())
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

    steps = {
        "scan": lambda: run_all(bronze),
        "decode": lambda: run_all(msg.decode(topic)),
        "decode_rejects": lambda: run_all(msg.rejects(msg.decode(topic))),
        "dedup": lambda: run_all(keep_latest(clean, ["event_id"], LATEST_FIRST)),
        "dedup_plain": lambda: run_all(plain_dedup(clean)),
        "silver_write_and_counts": lambda: run_all(
            silver.silver_counts(bronze, silver.write_silver(bronze, f"{root}/silver_a"))
        ),
        "silver_with_five_actions": lambda: counted_silver(bronze, f"{root}/silver_b"),
        "dimension": lambda: run_all(gold.dim_teams(stg)),
        "dimension_plain": lambda: run_all(plain_dimension(stg)),
        "facts": lambda: run_all(facts()),
        "facts_without_broadcast": shuffled_facts,
        "checks": lambda: run_all(run_checks(bronze, gold.SILVER_RULES)),
        "checks_one_by_one": lambda: [run_all(rule.failing(bronze)) for rule in gold.SILVER_RULES],
    }
    timed = {}
    for name, step in steps.items():
        times = []
        for _ in range(3):
            start = time.perf_counter()
            step()
            times.append(time.perf_counter() - start)
        timed[name] = round(sorted(times)[1], 2)
        print(name, timed[name], file=sys.stderr, flush=True)
    rows = bronze.count()
    spark.stop()
    print(json.dumps({"rows": rows, "cpus": int(cpus), "seconds": timed}))


if __name__ == "__main__":
    main()
