"""Tables that change in one step: silver by whole rewrite and by merge, gold behind views."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from layerline.operators.roles import hot_values
from layerline.plans import gold, silver
from layerline.schemas import SILVER
from layerline.sources import snapshots
from layerline.sources.tables import drop_former, publish_table
from layerline.workload.tables import bronze_events
from tests.test_plans import NO_BROADCAST, plan, settings

SF_DIR = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def bronze(spark):
    return bronze_events(spark, SF_DIR)


def test_replace_gives_silver(spark, bronze, tmp_path):
    expected = rows_of(silver.to_silver(bronze).select(*SILVER.names))
    for _ in range(2):
        stored = silver.replace_silver(bronze, str(tmp_path))
        assert stored.columns == list(SILVER.names) and rows_of(stored) == expected
    assert snapshots.current(spark, str(tmp_path))[0] == 2
    assert silver.silver_counts(bronze, stored).first().rows_written == len(expected)


def test_a_failed_write_leaves_the_table(spark, bronze, tmp_path):
    path = str(tmp_path)
    expected = rows_of(silver.replace_silver(bronze, path))
    fails = F.when(F.col("kafka_offset") % 7 == 3, F.raise_error("lost").cast("int")).otherwise(F.col("matchday"))
    with pytest.raises(Exception, match="lost"):
        silver.replace_silver(bronze.withColumn("matchday", fails), path)
    assert rows_of(snapshots.read_snapshot(spark, path, SILVER)) == expected
    with pytest.raises(Exception, match="lost"):
        silver.merge_silver(bronze.withColumn("matchday", fails), path)
    assert rows_of(snapshots.read_snapshot(spark, path, SILVER)) == expected


def test_two_writers_do_not_overwrite_each_other(spark, bronze, tmp_path):
    path = str(tmp_path)
    silver.replace_silver(bronze, path)
    number, folders = snapshots.current(spark, path)
    silver.replace_silver(bronze.limit(50), path)
    with pytest.raises(RuntimeError, match="another writer"):
        snapshots.publish(spark, path, number, folders[:1])
    assert snapshots.current(spark, path)[0] == number + 1
    assert not [p for p in (tmp_path / "_snapshots").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_a_reader_goes_on_until_old_folders_go(spark, bronze, tmp_path):
    path = str(tmp_path)
    reader = silver.replace_silver(bronze, path)
    expected = rows_of(reader)
    silver.replace_silver(bronze.where("kafka_offset < 100"), path)
    assert rows_of(reader) == expected
    assert snapshots.drop_unlisted(spark, path, "match_date", 3600) == 0
    assert snapshots.drop_unlisted(spark, path, "match_date", 0) > 0
    now = snapshots.read_snapshot(spark, path, SILVER)
    assert rows_of(now) == rows_of(silver.to_silver(bronze.where("kafka_offset < 100")).select(*SILVER.names))


def test_dates_prune_folders(spark, bronze, tmp_path):
    stored = silver.replace_silver(bronze, str(tmp_path))
    text = plan(stored.where("match_date = DATE'2024-01-05'"))
    assert re.search(r"PartitionFilters: \[[^\]]*match_date", text)


@pytest.mark.parametrize("order", ["kafka_offset", "-kafka_offset", "hash(kafka_offset)"])
def test_merges_in_any_order_give_silver(spark, bronze, tmp_path, order):
    path = str(tmp_path)
    numbered = bronze.withColumn("part", F.expr(f"ntile(4) OVER (ORDER BY {order})")).cache()
    for part in (1, 2, 3, 4, 2):
        silver.merge_silver(numbered.where(f"part = {part}").drop("part"), path)
    numbered.unpersist()
    found = snapshots.read_snapshot(spark, path, SILVER)
    assert rows_of(found) == rows_of(silver.to_silver(bronze).select(*SILVER.names))


def test_a_merge_rewrites_only_touched_dates_and_those_moved_from(spark, bronze, tmp_path):
    path = str(tmp_path)
    first = bronze.where("event_id IS NOT NULL AND match_id IS NOT NULL")
    silver.replace_silver(first, path)
    before = snapshots.current(spark, path)[1]
    old = snapshots.read_snapshot(spark, path, SILVER).where("match_date = DATE'2024-01-05'").first()
    moved = first.where(F.col("event_id") == old.event_id).limit(1).withColumns(
        {"utc_date": F.lit("2030-02-03T10:00:00Z"), "kafka_offset": F.lit(10**9).cast("long")})
    assert silver.merge_silver(moved, path) == ["2024-01-05", "2030-02-03"]
    after = snapshots.current(spark, path)[1]
    assert {f.split("/")[0] for f in set(before) ^ set(after)} == {"match_date=2024-01-05", "match_date=2030-02-03"}
    found = snapshots.read_snapshot(spark, path, SILVER).where(F.col("event_id") == old.event_id).collect()
    assert [(str(r.match_date), r.kafka_offset) for r in found] == [("2030-02-03", 10**9)]
    # An older version changes nothing; a bad date moves the record to the folder without one, and its date is empty then.
    assert silver.merge_silver(first.where(F.col("event_id") == old.event_id).limit(1), path)
    assert snapshots.read_snapshot(spark, path, SILVER).where("kafka_offset = 1000000000").count() == 1
    lost = moved.withColumns({"utc_date": F.lit("bad"), "kafka_offset": F.lit(10**9 + 1).cast("long")})
    assert silver.merge_silver(lost, path) == ["2030-02-03", None]
    assert not [f for f in snapshots.current(spark, path)[1] if f.startswith("match_date=2030")]
    assert silver.merge_silver(first.limit(0), path) == []


def test_empty_snapshot(spark, tmp_path):
    assert snapshots.read_snapshot(spark, str(tmp_path), SILVER).count() == 0
    assert snapshots.current(spark, str(tmp_path)) == (0, [])


# Gold


@pytest.fixture(scope="module")
def stg(spark, bronze, tmp_path_factory):
    return gold.staging(silver.replace_silver(bronze, str(tmp_path_factory.mktemp("silver"))))


@pytest.fixture(scope="module")
def teams(spark, stg, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dim") / "teams")
    gold.dim_teams(stg).write.parquet(path)
    return spark.read.parquet(path)


def test_bucketed_facts_are_the_facts(spark, stg, teams, tmp_path):
    expected = rows_of(gold.fct_match_events(stg, teams))
    assert rows_of(gold.bucketed_fact(stg, teams, "bucket_test", str(tmp_path), 4)) == expected
    hot = stg.withColumn("home_team_id", F.when(F.col("kafka_offset") % 3 > 0, 3).otherwise(F.col("home_team_id")))
    assert hot_values(hot, "home_team_id", 16) == [3] and hot_values(stg, "home_team_id", 8) == []
    found = gold.bucketed_fact(hot, teams, "bucket_hot", str(tmp_path / "hot"), 16)
    assert rows_of(found) == rows_of(gold.fct_match_events(hot, teams))
    assert spark.table("bucket_hot.facts_by_home").where("home_team_id = 3 OR home_team_id IS NULL").count() == 0


def test_buckets_join_without_a_shuffle(spark, stg, teams, tmp_path):
    gold.bucketed_fact(stg, teams, "bucket_plan", str(tmp_path), 4)
    with settings(spark, **NO_BROADCAST):
        for role in gold.TEAM_ROLES:
            joined = gold.join_team(spark.table(f"bucket_plan.facts_by_{role}"), spark.table("bucket_plan.dim_teams_buckets"), role)
            text = plan(joined)
            assert "SortMergeJoin" in text and "Exchange" not in text
            assert joined.count() >= spark.table(f"bucket_plan.facts_by_{role}").count()


def test_published_table_is_partitioned_and_keeps_its_column_order(spark, stg, teams, tmp_path):
    path = tmp_path / "fct"
    facts = gold.fct_match_events(stg, teams)
    shown = publish_table(facts, "view_test.fct", str(path), by="match_date")
    assert shown.dtypes == facts.dtypes and rows_of(shown) == rows_of(facts)
    assert list(path.glob("version=*/match_date=2024-01-05/*.parquet"))
    assert re.search(r"PartitionFilters: \[[^\]]*match_date", plan(shown.where("match_date = DATE'2024-01-05'")))


def test_a_failed_publication_leaves_what_was_shown(spark, stg, tmp_path):
    path = str(tmp_path / "t")
    expected = rows_of(publish_table(stg, "view_fail.t", path))
    with pytest.raises(Exception, match="lost"):
        publish_table(stg.withColumn("status", F.raise_error("lost").cast("string")), "view_fail.t", path)
    assert rows_of(spark.table("view_fail.t")) == expected
    reader = spark.table("view_fail.t")
    publish_table(stg.limit(3), "view_fail.t", path)
    assert rows_of(reader) == expected and spark.table("view_fail.t").count() == 3
    assert drop_former(spark, "view_fail.t", path, 3600) == []
    assert len(drop_former(spark, "view_fail.t", path, 0)) == 2
    assert spark.table("view_fail.t").count() == 3
