from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from layerline.operators import messages as msg
from layerline.schemas import BRONZE, BRONZE_WITH_REJECTS, MESSAGE
from layerline.sources.files import read_table
from layerline.streaming.bronze import bronze_rows, start_append, start_bronze
from layerline.workload.tables import bronze_events, damaged, messages

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def sent(spark):
    return damaged(messages(bronze_events(spark, SF_DIR)))


def run(spark, root, **options):
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(f"{root}/topic")
    query = start_bronze(stream, f"{root}/bronze", f"{root}/log", None, **options)
    query.awaitTermination()
    return query


def test_bronze_holds_every_message_once(spark, sent, tmp_path):
    root = str(tmp_path)
    sent.repartition(3).write.parquet(f"{root}/topic")
    query = run(spark, root)
    assert query.exception() is None
    bronze = read_table(spark, f"{root}/bronze", BRONZE)
    assert bronze.schema == BRONZE
    assert bronze.count() == sent.count() == bronze.select("kafka_offset").distinct().count()
    today = spark.range(1).select(F.current_date()).first()[0]
    assert {row[0] for row in bronze.select("ingestion_date").distinct().collect()} <= {today, date.today()}


def test_progress_reports_the_delivery(spark, sent, tmp_path):
    root = str(tmp_path)
    sent.repartition(2).write.parquet(f"{root}/topic")
    query = run(spark, root)
    seen = [progress.observedMetrics["delivery"] for progress in query.recentProgress if progress.numInputRows]
    assert len(seen) == 2
    assert sum(row.total for row in seen) == sent.count()
    assert sum(row.valid for row in seen) == msg.valid(msg.decode(sent)).count()


def test_writers_of_a_batch_can_be_bounded(spark, sent, tmp_path):
    root = str(tmp_path)
    sent.repartition(6).write.parquet(f"{root}/topic")
    for label, options, files in (("free", {}, 6), ("bounded", {"max_writers": 2}, 2)):
        with_all = spark.readStream.schema(MESSAGE).parquet(f"{root}/topic")
        spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
        try:
            query = start_bronze(with_all, f"{root}/{label}", f"{root}/{label}_log", None, **options)
            query.awaitTermination()
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert len(list((tmp_path / label).glob("ingestion_date=*/*.parquet"))) == files
        assert read_table(spark, f"{root}/{label}", BRONZE).count() == sent.count()


def test_broken_messages_stay_as_rows_of_nulls(spark, sent, tmp_path):
    root = str(tmp_path)
    sent.write.parquet(f"{root}/topic")
    run(spark, root)
    broken = read_table(spark, f"{root}/bronze", BRONZE).where("kafka_offset % 20 IN (1, 2, 3)")
    assert broken.count() == sent.where("offset % 20 IN (1, 2, 3)").count() > 0
    assert broken.dropna("all", subset=["event_id", "match_id", "status"]).count() == 0


def test_restart_takes_only_new_messages(spark, sent, tmp_path):
    root = str(tmp_path)
    total = sent.count()
    first = sent.where("offset < 300")
    first.write.mode("append").parquet(f"{root}/topic")
    counts = []
    for part in (None, sent.where("offset >= 300"), None):
        if part is not None:
            part.write.mode("append").parquet(f"{root}/topic")
        run(spark, root)
        counts.append(read_table(spark, f"{root}/bronze", BRONZE).count())
    assert counts == [first.count(), total, total]


def test_a_batch_that_failed_to_commit_is_written_once(spark, sent, tmp_path):
    """The commit of the last batch is lost, as after a crash between the sink and the log."""
    root = str(tmp_path)
    sent.write.parquet(f"{root}/topic")
    run(spark, root)
    commits = sorted((tmp_path / "log" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for name in (commits[-1].name, f".{commits[-1].name}.crc"):
        (tmp_path / "log" / "commits" / name).unlink(missing_ok=True)
    run(spark, root)
    assert read_table(spark, f"{root}/bronze", BRONZE).count() == sent.count()


def test_rejects_are_read_from_bronze(spark, sent, tmp_path):
    root = str(tmp_path)
    sent.write.parquet(f"{root}/topic")
    run(spark, root, keep_rejects=True)
    bronze = read_table(spark, f"{root}/bronze", BRONZE_WITH_REJECTS)
    rejected = msg.rejects(bronze)
    decoded = msg.decode(sent)
    columns = ["kafka_offset", "error_reason", "raw_value"]
    expected = msg.rejects(decoded).select(*columns)
    assert rejected.select(*columns).exceptAll(expected).count() == 0
    assert rejected.count() == expected.count() > 0
    assert msg.dead_letters(rejected).count() == expected.count()


def test_dead_letters_can_be_streamed(spark, sent, tmp_path):
    sent.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(MESSAGE).parquet(str(tmp_path / "in"))
    letters = msg.dead_letters(msg.rejects(msg.decode(stream)))
    start_append(letters, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    expected = msg.dead_letters(msg.rejects(msg.decode(sent)))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.exceptAll(expected).count() == 0 == expected.exceptAll(found).count()


def test_batch_and_stream_share_the_decode(spark, sent):
    assert bronze_rows(sent).dtypes == [(field.name, field.dataType.simpleString()) for field in BRONZE]
    assert bronze_rows(sent, keep_rejects=True).columns[-2:] == ["error_reason", "raw_value"]


def test_interval_query_runs_until_stopped(spark, sent, tmp_path):
    root = str(tmp_path)
    sent.write.parquet(f"{root}/topic")
    stream = spark.readStream.schema(MESSAGE).parquet(f"{root}/topic")
    query = start_bronze(stream, f"{root}/bronze", f"{root}/log", "1 seconds")
    try:
        query.processAllAvailable()
        assert query.isActive
        assert sum(p.numInputRows for p in query.recentProgress) == sent.count()
    finally:
        query.stop()


def test_append_without_partitions(spark, sent, tmp_path):
    sent.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(MESSAGE).parquet(str(tmp_path / "in"))
    start_append(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == sent.count()


def test_old_files_are_read(spark, tmp_path):
    import os
    import time

    from layerline.sources.files import stream_documents

    landed = tmp_path / "landed"
    landed.mkdir()

    def cycle():
        stream_documents(spark, str(landed)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "log")
        ).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    (landed / "new.json").write_text('{"matches": []}\n')
    assert cycle() == 1
    (landed / "old.json").write_text('{"matches": []}\n')
    past = time.time() - 10 * 86400
    os.utime(landed / "old.json", (past, past))
    assert cycle() == 2
