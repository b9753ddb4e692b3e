"""Plan shapes that matter at scale, and results under skew."""

from __future__ import annotations

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from layerline.operators import messages as msg
from layerline.operators.cleaning import keep_latest
from layerline.operators.matches import select_matches
from layerline.operators.quality import run_checks
from layerline.operators.roles import role_join
from layerline.plans import gold, silver
from layerline.schemas import SILVER
from layerline.sources.files import read_table, write_partitioned
from layerline.workload.queries import QUERIES
from layerline.workload.tables import bronze_events

SF_DIR = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def settings(spark, **conf):
    names = {f"spark.sql.{key.replace('__', '.')}": value for key, value in conf.items()}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


SMALL_PARTITIONS = {
    "adaptive__advisoryPartitionSizeInBytes": "20000",
    "adaptive__skewJoin__skewedPartitionThresholdInBytes": "20000",
    "adaptive__coalescePartitions__minPartitionSize": "10000",
}
NO_BROADCAST = {"autoBroadcastJoinThreshold": "-1"}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("layers")
    bronze_events(spark, SF_DIR).write.parquet(str(root / "bronze"))
    stg = gold.staging(silver.write_silver(spark.read.parquet(str(root / "bronze")), str(root / "silver")))
    gold.dim_teams(stg).write.parquet(str(root / "dim"))
    return root


def test_dedup_limits_each_key_before_the_only_shuffle(spark, stored):
    text = plan(silver.to_silver(spark.read.parquet(str(stored / "bronze"))))
    assert text.count("Exchange hashpartitioning") == 1
    assert "IsNotNull(event_id)" in text and "IsNotNull(match_id)" in text
    before = text[text.index("Exchange hashpartitioning"):]
    assert re.search(r"WindowGroupLimit .*Partial", before)


def test_dedup_sends_one_row_per_task_and_key(spark):
    """A hot key with most of the rows reaches the reducer as one row per task."""
    hot = spark.range(0, 200_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 1000)).alias("k"),
        F.col("id").alias("o"),
    )
    kept = keep_latest(hot, ["k"], ["o"])
    rows = {row.k: row.o for row in kept.collect()}
    assert rows["hot"] == 199_998 and len(rows) == 1001
    metrics = kept._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit .*Partial", metrics)


def test_counts_read_two_columns_of_bronze_and_no_column_of_silver(spark, stored):
    silver_table = read_table(spark, str(stored / "silver"), SILVER)
    text = plan(silver.silver_counts(spark.read.parquet(str(stored / "bronze")), silver_table))
    assert "ReadSchema: struct<event_id:string,match_id:int>" in text
    assert "ReadSchema: struct<>" in text


def test_rejects_are_a_pushed_down_filter_on_bronze(spark, stored):
    text = plan(msg.rejects(spark.read.parquet(str(stored / "bronze"))))
    assert "PushedFilters: [Or(IsNull(event_id),IsNull(match_id))]" in text


def test_selections_reach_the_scan(spark, stored):
    bronze = spark.read.parquet(str(stored / "bronze"))
    assert "In(competition_code, [CL,PL])" in plan(select_matches(bronze, ["PL", "CL"]))
    assert "EqualTo(status,LIVE)" in plan(select_matches(bronze, status="LIVE"))
    assert "EqualTo(match_id,8)" in plan(select_matches(bronze, match_id=8))


def test_dimension_reads_its_input_once(spark, stored):
    text = plan(gold.dim_teams(gold.staging(read_table(spark, str(stored / "silver"), SILVER))))
    assert text.count("FileScan parquet") == 1
    assert text.count("Exchange") == 1
    assert re.search(r"ReadSchema: struct<home_team_id:int,home_team_name:string,away_team_id:int,away_team_name:string>", text)


def test_checks_read_their_input_once_and_once_per_unique_rule(spark, stored):
    text = plan(run_checks(read_table(spark, str(stored / "silver"), SILVER), gold.SILVER_RULES))
    assert text.count("FileScan parquet") == 2
    assert "ReadSchema: struct<event_id:string>" in text


def test_small_stored_dimension_is_broadcast_and_the_fact_is_not_shuffled(spark, stored):
    stg = gold.staging(read_table(spark, str(stored / "silver"), SILVER))
    text = plan(gold.fct_match_events(stg, read_table(spark, str(stored / "dim"))))
    assert text.count("BroadcastHashJoin") == 2
    assert "hashpartitioning" not in text


def test_large_dimension_is_not_broadcast_and_gives_the_same_facts(spark, stored):
    stg = gold.staging(read_table(spark, str(stored / "silver"), SILVER))
    small = gold.fct_match_events(stg, read_table(spark, str(stored / "dim")))
    rows = small.collect()
    with settings(spark, **NO_BROADCAST):
        large = gold.fct_match_events(stg, read_table(spark, str(stored / "dim")))
        assert "BroadcastHashJoin" not in plan(large)
        assert sorted(map(str, large.collect())) == sorted(map(str, rows))


def test_hot_keys_of_a_large_join_are_split(spark):
    hot = F.col("id") % 3 == 0
    facts = spark.range(0, 300_000, 1, 8).select(
        "id",
        F.when(hot, 7).otherwise(F.col("id") % 5000).cast("int").alias("a"),
        F.when(hot, None).otherwise(F.col("id") % 4999).cast("int").alias("b"),
        F.sha2(F.col("id").cast("string"), 256).alias("pad"),
    )
    dim = spark.range(0, 5000, 1, 4).select(
        F.col("id").cast("int").alias("key"), F.concat(F.lit("n"), "id").alias("name")
    )
    with settings(spark, shuffle__partitions="64", **NO_BROADCAST, **SMALL_PARTITIONS):
        joined = role_join(facts, dim, {"a": "a", "b": "b"}, "key", {"a": {"name": "an"}, "b": {"name": "bn"}})
        total = joined.agg(F.count("*"), F.count("an"), F.count("bn"), F.sum("id"), F.max("pad"))
        assert tuple(total.collect()[0])[:4] == (300_000, 300_000, 200_000, 300_000 * 299_999 // 2)
        assert plan(total).count("SortMergeJoin(skew=true)") == 2


def test_hot_partition_value_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(0, 100_000, 1, 8).select(
        F.sha2(F.col("id").cast("string"), 256).alias("pad"),
        F.when(F.col("id") % 3 == 0, F.lit("2026-01-01")).otherwise(
            F.concat(F.lit("2026-02-"), F.lpad((F.col("id") % 20 + 1).cast("string"), 2, "0"))
        ).alias("day"),
    )
    with settings(spark, shuffle__partitions="64", adaptive__advisoryPartitionSizeInBytes="500000",
                  adaptive__coalescePartitions__minPartitionSize="100000"):
        write_partitioned(rows, str(tmp_path / "t"), "day")
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "t").iterdir() if p.is_dir()}
    assert files.pop("day=2026-01-01") >= 4
    assert len(files) == 20 and max(files.values()) <= 2
    assert spark.read.parquet(str(tmp_path / "t")).count() == 100_000


def test_no_cross_join_or_python_step_in_any_query(spark):
    for name, run in QUERIES.items():
        text = plan(run(spark, "/root/testdata/sf0.001"))
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "Arrow"):
            assert word not in text, name
