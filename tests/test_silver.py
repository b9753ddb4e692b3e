from __future__ import annotations

from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from layerline.operators.cleaning import keep_latest, require, with_times
from layerline.plans.silver import silver_counts, to_silver, write_silver
from layerline.schemas import BRONZE, SILVER
from layerline.sources.files import read_table, write_partitioned


def test_require(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), ("a", None), (None, None)], "event_id string, match_id int")
    assert [tuple(row) for row in require(df, ["event_id", "match_id"]).collect()] == [("a", 1)]


def test_require_keeps_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (None,)], "v double")
    assert require(df, ["v"]).count() == 1


def test_keep_latest_ranks_null_offsets_last(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", None), ("b", None)], "k string, o long")
    kept = keep_latest(df, ["k"], ["o"])
    assert kept.columns == ["k", "o"]
    assert sorted(map(tuple, kept.collect())) == [("a", 2), ("b", None)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(0, 3), st.integers(0, 3)), min_size=1))
def test_keep_latest_against_brute_force(spark, rows):
    df = spark.createDataFrame([(k, o, p, i) for i, (k, o, p) in enumerate(rows)], "k string, o int, p int, i int")
    kept = keep_latest(df, ["k"], ["o", "p", "i"]).collect()
    expected = {}
    for i, (k, o, p) in enumerate(rows):
        expected[k] = max(expected.get(k, (-1, -1, -1)), (o, p, i))
    assert {row.k: (row.o, row.p, row.i) for row in kept} == expected
    assert len(kept) == len(expected)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("2026-01-02T01:30:00Z",), ("bad",), (None,), ("2026-02-30T01:00:00Z",)], "t string")
        typed = with_times(df, "t", "ts", "d").select("t", F.unix_timestamp("ts").alias("s"), F.col("d").cast("string"))
        rows = {row.t: (row.s, row.d) for row in typed.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    seconds = int((datetime(2026, 1, 2, 1, 30) - datetime(1970, 1, 1)).total_seconds())
    assert rows["2026-01-02T01:30:00Z"] == (seconds, "2026-01-02")
    assert rows["bad"] == rows[None] == rows["2026-02-30T01:00:00Z"] == (None, None)


def bronze(spark, rows):
    """Rows of (event_id, match_id, offset, utc_date) with the other bronze columns null."""
    df = spark.createDataFrame(rows, "event_id string, match_id int, kafka_offset long, utc_date string")
    return df.select(*[
        F.col(field.name) if field.name in df.columns else F.lit(None).cast(field.dataType).alias(field.name)
        for field in BRONZE
    ])


ROWS = [("a", 1, 1, "2026-01-01T10:00:00Z"), ("a", 1, 2, "2026-01-02T10:00:00Z"), ("b", 2, 3, "bad"),
        ("b", None, 9, "2026-01-01T10:00:00Z"), (None, 3, 4, None)]


def test_silver_rows_and_schema(spark, tmp_path):
    stored = write_silver(bronze(spark, ROWS), str(tmp_path / "silver"))
    assert stored.schema == SILVER
    rows = {row.event_id: row for row in stored.collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"].kafka_offset, rows["a"].match_date) == (2, date(2026, 1, 2))
    assert (rows["b"].match_timestamp, rows["b"].match_date) == (None, None)
    assert sorted(p.name for p in (tmp_path / "silver").iterdir() if p.is_dir()) == [
        "match_date=2026-01-02", "match_date=__HIVE_DEFAULT_PARTITION__",
    ]


def test_a_message_landed_twice_is_settled_by_its_date(spark):
    twice = bronze(spark, [("a", 1, 1, None)])
    landed = [twice.withColumn("ingestion_date", F.lit(f"2026-01-0{day}").cast("date")) for day in (1, 3, 2)]
    kept = to_silver(landed[0].union(landed[1]).union(landed[2])).collect()
    assert [row.ingestion_date for row in kept] == [date(2026, 1, 3)]


def test_counts(spark, tmp_path):
    source = bronze(spark, ROWS)
    for silver in (to_silver(source), write_silver(source, str(tmp_path / "silver"))):
        assert silver_counts(source, silver).first().asDict() == {
            "rows_read": 5, "rows_clean": 3, "duplicates_removed": 1, "rows_written": 2, "columns_written": 20,
        }


def test_counts_of_nothing(spark):
    empty = bronze(spark, ROWS).where("false")
    assert tuple(silver_counts(empty, to_silver(empty)).first()) == (0, 0, 0, 0, 20)


def test_all_dates_bad_keeps_the_type(spark, tmp_path):
    stored = write_silver(bronze(spark, [("b", 2, 3, "bad")]), str(tmp_path / "silver"))
    assert dict(stored.dtypes)["match_date"] == "date"
    assert stored.first().match_date is None


def test_overwrite_drops_old_partitions_unless_told_otherwise(spark, tmp_path):
    path = str(tmp_path / "t")
    day = spark.createDataFrame([(1, "2026-01-01")], "v int, d string")
    other = spark.createDataFrame([(2, "2026-01-02")], "v int, d string")
    write_partitioned(day, path, "d")
    write_partitioned(other, path, "d", only_touched_partitions=True)
    assert sorted(row.v for row in spark.read.parquet(path).collect()) == [1, 2]
    write_partitioned(other, path, "d", rebalance=False)
    assert [row.v for row in spark.read.parquet(path).collect()] == [2]


def test_date_range_prunes_directories(spark, tmp_path):
    path = str(tmp_path / "silver")
    write_silver(bronze(spark, [(str(i), i, i, f"2026-01-0{i}T00:00:00Z") for i in range(1, 6)]), path)
    part = read_table(spark, path, SILVER, "match_date", "2026-01-02", "2026-01-03")
    assert sorted(row.match_id for row in part.collect()) == [2, 3]
    assert len({row.f for row in part.select(F.input_file_name().alias("f")).collect()}) == 2
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(match_date" in plan
