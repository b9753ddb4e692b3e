"""Streams written batch by batch: replays, letters, bounds, compaction and counts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from layerline.operators import messages as msg
from layerline.schemas import BRONZE, BRONZE_WITH_REJECTS, MESSAGE
from layerline.streaming.batches import compact, drop_batches, folder_sink, read_batches, start_batches, start_delivery
from layerline.streaming.counters import DeliveryCounters, read_counters
from layerline.workload.tables import bronze_events, damaged, messages, repairable

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sent(spark):
    return repairable(damaged(messages(bronze_events(spark, SF_DIR))))


def land(rows, root, parts=3):
    for part in range(parts):
        rows.where(F.col("offset") % parts == part).coalesce(1).write.mode("append").parquet(f"{root}/topic")


def topic(spark, root, **options):
    return spark.readStream.schema(MESSAGE).options(maxFilesPerTrigger=1, **options).parquet(f"{root}/topic")


def deliver(spark, root, letters=None, **options):
    run = start_delivery(topic(spark, root, **options), f"{root}/bronze", letters or f"{root}/letters", f"{root}/log", None)
    run.awaitTermination()
    return run


def forget_last_commit(root):
    commits = sorted((root / "log" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for name in (commits[-1].name, f".{commits[-1].name}.crc"):
        (root / "log" / "commits" / name).unlink(missing_ok=True)


def test_bronze_and_letters_come_from_one_pass(spark, sent, tmp_path):
    land(sent, str(tmp_path))
    deliver(spark, str(tmp_path))
    bronze = read_batches(spark, f"{tmp_path}/bronze")
    assert bronze.schema == BRONZE_WITH_REJECTS
    assert bronze.count() == sent.count() == bronze.select("kafka_offset").distinct().count()
    expected = msg.dead_letters(msg.rejects(msg.decode(sent)))
    letters = spark.read.parquet(f"{tmp_path}/letters").select("key", "value")
    assert letters.exceptAll(expected).count() == 0 == expected.exceptAll(letters).count() < letters.count()
    # No list of files is kept on the driver, and plain readers see the same rows.
    assert not list(tmp_path.glob("bronze/**/_spark_metadata"))
    assert spark.read.parquet(f"{tmp_path}/bronze/batches").count() == sent.count()


def test_a_second_run_sends_nothing_twice(spark, sent, tmp_path):
    land(sent, str(tmp_path))
    for _ in range(2):
        deliver(spark, str(tmp_path))
    assert read_batches(spark, f"{tmp_path}/bronze").count() == sent.count()
    assert spark.read.parquet(f"{tmp_path}/letters").count() == msg.rejects(msg.decode(sent)).count()


def test_a_batch_that_is_run_again_replaces_itself(spark, sent, tmp_path):
    land(sent, str(tmp_path))
    deliver(spark, str(tmp_path))
    before = sorted(map(str, read_batches(spark, f"{tmp_path}/bronze").collect()))
    forget_last_commit(tmp_path)
    deliver(spark, str(tmp_path))
    assert sorted(map(str, read_batches(spark, f"{tmp_path}/bronze").collect())) == before
    assert spark.read.parquet(f"{tmp_path}/letters").count() == msg.rejects(msg.decode(sent)).count()


def test_a_failure_between_the_sinks_is_made_good(spark, sent, tmp_path):
    land(sent, str(tmp_path))
    failing = {1}
    write = folder_sink(f"{tmp_path}/letters")

    def letters(rows, number):
        if number in failing:
            raise RuntimeError("no letters today")
        write(rows, number)

    with pytest.raises(Exception, match="no letters today"):
        deliver(spark, str(tmp_path), letters)
    failing.clear()
    deliver(spark, str(tmp_path), letters)
    assert read_batches(spark, f"{tmp_path}/bronze").count() == sent.count()
    assert spark.read.parquet(f"{tmp_path}/letters").count() == msg.rejects(msg.decode(sent)).count()


def test_a_null_key_stays_null(spark, tmp_path):
    rows = spark.createDataFrame([(None, b"x", "t", 0, 1, None), (b"k", b"y", "t", 0, 2, None)], MESSAGE)
    rows.write.parquet(f"{tmp_path}/topic")
    deliver(spark, str(tmp_path))
    letters = spark.read.parquet(f"{tmp_path}/letters").collect()
    assert sorted((r.key, json.loads(r.value)["original_event"]) for r in letters if r.key) == [("k", "y")]
    assert [json.loads(r.value)["original_event"] for r in letters if r.key is None] == ["x"]


def test_bounded_batches_equal_one_and_their_files_are_archived(spark, sent, tmp_path):
    land(sent, str(tmp_path), 4)
    spark.conf.set("spark.sql.streaming.fileSource.cleaner.numThreads", "0")
    try:
        for _ in range(2):
            deliver(spark, str(tmp_path), cleanSource="archive", sourceArchiveDir=f"{tmp_path}/archive")
    finally:
        spark.conf.unset("spark.sql.streaming.fileSource.cleaner.numThreads")
    bronze = read_batches(spark, f"{tmp_path}/bronze")
    assert len(list(tmp_path.glob("bronze/batches/*/batch_id=*"))) == 4
    expected = msg.decode(sent).select(*bronze.drop("ingestion_date").columns)
    found = bronze.drop("ingestion_date")
    assert found.exceptAll(expected).count() == 0 == expected.exceptAll(found).count()
    moved, left = list(tmp_path.glob("archive/**/*.parquet")), list(tmp_path.glob("topic/*.parquet"))
    assert len(moved) >= 3 and len(moved) + len(left) == 4


def test_counts_of_each_batch_are_kept(spark, sent, tmp_path):
    land(sent, str(tmp_path))
    counters = DeliveryCounters(spark, f"{tmp_path}/counters")
    spark.streams.addListener(counters)
    try:
        run = deliver(spark, str(tmp_path))
        assert counters.wait(run)
        forget_last_commit(tmp_path)
        again = deliver(spark, str(tmp_path))
        assert counters.wait(again)
    finally:
        spark.streams.removeListener(counters)
    kept = read_counters(spark, f"{tmp_path}/counters")
    assert kept.count() == 3
    total = kept.agg(*[F.sum(name).alias(name) for name in ("total", "ok", "repaired", "failed")]).first()
    found = {r.outcome: r.n for r in msg.delivery_counts(msg.decode(sent), repaired_apart=True).collect()}
    assert total.total == sent.count() == total.ok + total.repaired + total.failed
    assert (total.ok, total.repaired) == (found["ok"], found["repaired"])
    assert total.failed == msg.rejects(msg.decode(sent)).count() > 0 < total.repaired


def days(spark):
    return bronze_events(spark, SF_DIR)


@pytest.fixture
def bronze(spark, tmp_path):
    """Nine batches over three thirds of the month."""
    write = folder_sink(f"{tmp_path}/batches", ["ingestion_date"])
    thirds = ("< 11", "BETWEEN 11 AND 20", "> 20")
    for number in range(9):
        rows = days(spark).where(f"day(ingestion_date) {thirds[number // 3]}").where(f"kafka_offset % 3 = {number % 3}")
        write(rows, number)
    return tmp_path


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_compaction_keeps_the_rows_and_lessens_the_files(spark, bronze):
    expected, root = rows_of(days(spark)), str(bronze)
    reader = read_batches(spark, root, BRONZE)
    assert rows_of(reader) == expected
    files = len(list(bronze.glob("batches/*/*/*.parquet")))
    closed = compact(spark, root, BRONZE)
    dates = {r[0] for r in days(spark).select(F.col("ingestion_date").cast("string")).distinct().collect()}
    assert set(closed) == dates - {max(dates)}
    assert len(list(bronze.glob("compacted/*/*.parquet"))) < files / 2
    assert not list(bronze.glob("_compacting-*"))
    # A reader that has its list of files goes on, a new one sees the same rows, before and after the batches go.
    assert rows_of(reader) == expected == rows_of(read_batches(spark, root, BRONZE))
    assert compact(spark, root, BRONZE) == []
    assert drop_batches(spark, root, 3600) == []
    assert drop_batches(spark, root, 0) == closed
    assert rows_of(read_batches(spark, root, BRONZE)) == expected
    some = read_batches(spark, root, BRONZE, "2024-01-05", "2024-01-12")
    assert rows_of(some) == rows_of(days(spark).where("ingestion_date BETWEEN DATE'2024-01-05' AND DATE'2024-01-12'"))


def test_compaction_that_failed_half_way_is_finished_by_the_next(spark, bronze, monkeypatch):
    from layerline.streaming import batches

    expected, root, moved = rows_of(days(spark)), str(bronze), []
    move = batches.paths.move_new

    def fails_at_third(*args):
        if len(moved) == 2:
            raise OSError("gone")
        moved.append(args)
        move(*args)

    monkeypatch.setattr(batches.paths, "move_new", fails_at_third)
    with pytest.raises(OSError):
        compact(spark, root, BRONZE)
    assert rows_of(read_batches(spark, root, BRONZE)) == expected
    monkeypatch.setattr(batches.paths, "move_new", move)
    assert len(compact(spark, root, BRONZE)) > 5
    assert rows_of(read_batches(spark, root, BRONZE)) == expected


def test_empty_bronze(spark, tmp_path):
    assert read_batches(spark, str(tmp_path), BRONZE).schema == BRONZE
    assert read_batches(spark, str(tmp_path), BRONZE).count() == 0
    assert compact(spark, str(tmp_path)) == []


def test_a_single_sink_gets_each_batch(spark, sent, tmp_path):
    land(sent, str(tmp_path))
    seen = []
    start_batches(topic(spark, str(tmp_path)), [lambda rows, number: seen.append((number, rows.count()))], f"{tmp_path}/log").awaitTermination()
    assert [number for number, _ in seen] == [0, 1, 2] and sum(n for _, n in seen) == sent.count()


def test_a_large_part_is_landed_as_several_files_of_one_batch(spark, tmp_path, monkeypatch):
    from layerline.workload import queries

    events = bronze_events(spark, SF_DIR)
    monkeypatch.setattr(queries, "FILE_ROWS", max(1, events.count() // 12))
    files = queries._in_parts(events, str(tmp_path / "parts"), 3, "kafka_offset")
    landed = spark.read.parquet(str(tmp_path / "parts"))
    by_file = landed.groupBy(F.input_file_name().alias("file")).agg(F.collect_set(F.col("kafka_offset") % 3).alias("of")).collect()
    assert files > 1 and len(by_file) == 3 * files and all(len(row["of"]) == 1 for row in by_file)
    assert landed.count() == events.count() == landed.distinct().count()
    [counted] = queries.QUERIES["st_counters"](spark, SF_DIR).collect()
    assert (counted["batches"], counted["total"]) == (3, events.count())
