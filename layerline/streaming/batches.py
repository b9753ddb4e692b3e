"""Streams whose batches are written whole, each into a partition of its own, without a log of files on the driver.

``bronze/batches/ingestion_date=<date>/batch_id=<n>`` holds what batch n brought. A batch that is run again has the same
rows and, as its time is kept with its offsets, the same date; it replaces its own partition. A date is closed when a batch
of a later date is there, as batches follow one another. Closed dates are rewritten as fewer files below ``compacted``, where
each date appears in one step and then stands for its batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from layerline.operators.messages import dead_letters, delivery_metrics, rejects
from layerline.schemas import BRONZE_WITH_REJECTS
from layerline.sources import paths
from layerline.streaming.bronze import TRIGGER_SECONDS, bronze_rows

Sink = Callable[[DataFrame, int], None]
DATE = "ingestion_date"


def start_batches(
    stream: DataFrame, sinks: Sequence[Sink], checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Hand each batch, computed once, to every sink with its number; one checkpoint covers them all.

    A batch counts as done when the last sink is; after a failure it is run again with the same rows and number, so a sink
    must replace what it wrote for that number. Without an interval the query takes what is available and stops.
    """

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist(StorageLevel.MEMORY_AND_DISK) if len(sinks) > 1 else batch
        try:
            for sink in sinks:
                sink(held, number)
        finally:
            held.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def folder_sink(path: str, by: Sequence[str] = (), prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Sink:
    """Replace the batch's own partition of a Parquet folder with its prepared rows."""

    def write(batch: DataFrame, number: int) -> None:
        marked = prepare(batch).withColumn("batch_id", F.lit(number).cast("long"))
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch_id").parquet(path)

    return write


def start_delivery(
    messages: DataFrame,
    bronze: str,
    letters: str | Sink,
    checkpoint: str,
    interval: str | None = f"{TRIGGER_SECONDS} seconds",
    max_writers: int | None = None,
) -> StreamingQuery:
    """Messages to bronze and, from the same pass, broken ones as dead letters: into a folder, or to a sink that takes
    their rows. Bronze keeps reasons and texts. Each batch observes its ``delivery`` counts.
    """
    rows = bronze_rows(messages, keep_rejects=True)
    if max_writers:
        rows = rows.coalesce(max_writers)
    as_letters = lambda batch: dead_letters(rejects(batch))
    if callable(letters):
        send = lambda batch, number: letters(as_letters(batch), number)
    else:
        send = folder_sink(letters, prepare=as_letters)
    sinks = [folder_sink(f"{bronze}/batches", [DATE]), send]
    return start_batches(rows.observe("delivery", *delivery_metrics()), sinks, checkpoint, interval)


def read_batches(
    spark: SparkSession, path: str, schema: StructType = BRONZE_WITH_REJECTS, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Bronze as written by ``start_delivery``, whole or for dates from ``start`` to ``end`` inclusive.

    Compacted dates are read from there, the others from their batches. Both filters prune folders.
    """
    done = _dates(spark, f"{path}/compacted")
    open_dates = [day for day in _dates(spark, f"{path}/batches") if day not in done]
    found = spark.createDataFrame([], schema)
    for folder, days in (("compacted", done), ("batches", open_dates)):
        days = [day for day in days if (start is None or day >= start) and (end is None or day <= end)]
        if days:
            reader = spark.read.schema(schema).option("basePath", f"{path}/{folder}")
            rows = reader.parquet(*[f"{path}/{folder}/{DATE}={day}" for day in days]).select(*schema.names)
            found = rows if folder == "compacted" or not done else found.unionByName(rows)
    return found


def _dates(spark: SparkSession, path: str) -> list[str]:
    return [name.partition("=")[2] for name in paths.names(spark, path) if name.startswith(f"{DATE}=")]


def compact(spark: SparkSession, path: str, schema: StructType = BRONZE_WITH_REJECTS) -> list[str]:
    """Rewrite the closed dates that still are batches, all in one job; returns them.

    ``rebalance`` gathers a date into few files and splits a large one. Readers that have begun go on with the batches,
    which stay until ``drop_batches``.
    """
    batches, done = _dates(spark, f"{path}/batches"), _dates(spark, f"{path}/compacted")
    closed = [day for day in batches if day < max(batches) and day not in done]
    if not closed:
        return []
    draft = f"{path}/_compacting-{uuid.uuid4().hex}"
    reader = spark.read.schema(schema).option("basePath", f"{path}/batches")
    rows = reader.parquet(*[f"{path}/batches/{DATE}={day}" for day in closed]).select(*schema.names)
    rows.hint("rebalance", DATE).write.partitionBy(DATE).parquet(draft)
    paths.make_folder(spark, f"{path}/compacted")
    for day in closed:
        paths.move_new(spark, f"{draft}/{DATE}={day}", f"{path}/compacted/{DATE}={day}")
    paths.remove(spark, draft)
    return closed


def drop_batches(spark: SparkSession, path: str, older_than_seconds: float) -> list[str]:
    """Delete the batches of dates that were compacted at least that long ago: longer than any reader runs."""
    old = [
        day for day in _dates(spark, f"{path}/compacted")
        if paths.exists(spark, f"{path}/batches/{DATE}={day}")
        and paths.age_seconds(spark, f"{path}/compacted/{DATE}={day}") >= older_than_seconds
    ]
    for day in old:
        paths.remove(spark, f"{path}/batches/{DATE}={day}")
    return old
