"""Connectors that cannot run here are checked by the options they set."""

from __future__ import annotations

import pytest

from layerline.session import scratch_path
from layerline.sources import jdbc, kafka, tables


class Recorder:
    """Stands in for a session, reader or writer and notes what it is told."""

    def __init__(self):
        self.seen = {}

    def __getattr__(self, name):
        if name in ("read", "readStream", "write", "writeStream"):
            return self

        def call(*args, **kwargs):
            self.seen.setdefault(name, {}).update(kwargs) if kwargs else self.seen.update({name: args})
            return self

        return call


def test_kafka_stream_options():
    spark = Recorder()
    kafka.stream_topic(spark, "host:9092", "matches", minPartitions="64")
    assert spark.seen["format"] == ("kafka",)
    assert spark.seen["options"] == {
        "kafka.bootstrap.servers": "host:9092", "subscribe": "matches", "startingOffsets": "earliest",
        "failOnDataLoss": "false", "minPartitions": "64",
    }


def test_kafka_batch_and_publish_options():
    spark = Recorder()
    kafka.read_topic(spark, "h", "t", startingOffsets="latest")
    assert spark.seen["options"]["startingOffsets"] == "latest"
    rows = Recorder()
    kafka.publish(rows, "h", "t")
    assert rows.seen["options"] == {"kafka.bootstrap.servers": "h", "topic": "t"}
    stream = Recorder()
    kafka.publish_stream(stream, "h", "t", "/log", "60 seconds")
    assert stream.seen["options"]["checkpointLocation"] == "/log"
    assert stream.seen["trigger"] == {"processingTime": "60 seconds"}


def test_jdbc_write_replaces_in_batches():
    rows = Recorder()
    jdbc.write_jdbc(rows, "jdbc:x", "raw.match_events", user="u")
    assert rows.seen["mode"] == ("overwrite",)
    assert rows.seen["options"] == {
        "url": "jdbc:x", "dbtable": "raw.match_events", "numPartitions": "16", "batchsize": "1000", "truncate": "true", "user": "u",
    }


def test_jdbc_read_splits_by_column():
    spark = Recorder()
    jdbc.read_jdbc(spark, "jdbc:x", "t", "match_id", "0", "1000", readers=4)
    assert spark.seen["options"] == {
        "url": "jdbc:x", "dbtable": "t", "partitionColumn": "match_id", "lowerBound": "0", "upperBound": "1000",
        "numPartitions": "4",
    }


def test_jdbc_catalog_settings(spark):
    jdbc.connect_catalog(spark, "unused_target", "jdbc:x", "some.Driver")
    name = spark.conf.get("spark.sql.catalog.unused_target")
    assert spark.sparkContext._jvm.java.lang.Class.forName(name).getName() == name
    assert spark.conf.get("spark.sql.catalog.unused_target.url") == "jdbc:x"
    assert spark.conf.get("spark.sql.catalog.unused_target.driver") == "some.Driver"


def test_table_is_replaced(spark, tmp_path):
    first = spark.createDataFrame([(1, "a")], "id int, name string")
    second = spark.createDataFrame([(2.5,)], "score double")
    assert tables.as_table(first, "layer_test.t", str(tmp_path / "one")).collect() == first.collect()
    assert tables.as_table(second, "layer_test.t", str(tmp_path / "two")).collect() == second.collect()
    assert tables.read_relation(spark, "layer_test.t").columns == ["score"]
    assert list((tmp_path / "two").glob("*.parquet"))


def test_view_stores_nothing(spark):
    view = tables.as_view(spark.range(3), "layer_view")
    assert view.count() == spark.table("layer_view").count() == 3


def test_scratch_is_below_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first.startswith(f"{shared}/layerline/{spark.sparkContext.applicationId}/x-") and first != second


def test_scratch_on_a_cluster_needs_the_setting():
    class Conf:
        def get(self, name, default):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "yarn", "applicationId": "app"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Cluster(), "x")
    Cluster.sparkContext.master = "local[2]"
    assert "/layerline/app/x-" in scratch_path(Cluster(), "x")
