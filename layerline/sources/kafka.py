"""Kafka source and sink. They need Spark's Kafka connector on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def _subscription(servers: str, topic: str, options: dict[str, str]) -> dict[str, str]:
    # Read from the start of the topic and go on when old messages are gone.
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "failOnDataLoss": "false",
        **options,
    }


def stream_topic(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A topic as a stream. ``minPartitions`` splits large topic partitions over more tasks and
    ``maxOffsetsPerTrigger`` bounds a batch."""
    return spark.readStream.format("kafka").options(**_subscription(servers, topic, options)).load()


def read_topic(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A topic's present content as a batch."""
    return spark.read.format("kafka").options(**_subscription(servers, topic, options)).load()


def publish(messages: DataFrame, servers: str, topic: str, **options: str) -> None:
    """Write ``key`` and ``value`` columns to a topic; equal keys go to one topic partition."""
    target = {"kafka.bootstrap.servers": servers, "topic": topic, **options}
    messages.write.format("kafka").options(**target).save()


def publish_stream(
    messages: DataFrame, servers: str, topic: str, checkpoint: str, interval: str = "60 seconds", **options: str
) -> StreamingQuery:
    """Write a stream of ``key`` and ``value`` columns to a topic."""
    target = {"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint, **options}
    return messages.writeStream.format("kafka").options(**target).trigger(processingTime=interval).start()
