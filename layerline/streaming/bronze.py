"""Messages to bronze: stateless decode, date stamp, checkpointed append."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from layerline.functions import all_present
from layerline.operators.messages import decode
from layerline.schemas import BRONZE, BRONZE_WITH_REJECTS, REQUIRED

# Fixed value: seconds between micro-batches.
TRIGGER_SECONDS = 30


def bronze_rows(messages: DataFrame, keep_rejects: bool = False) -> DataFrame:
    """Decoded messages with the processing date; broken messages stay as rows of nulls.

    ``keep_rejects`` adds the reason and the raw text of broken messages, so that the dead letters
    are a filter on bronze and the input is neither read nor parsed a second time.
    """
    stamped = decode(messages).withColumn("ingestion_date", F.current_date())
    return stamped.select(*(BRONZE_WITH_REJECTS if keep_rejects else BRONZE).names)


def start_append(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    by: str | None = None,
    interval: str | None = None,
    max_writers: int | None = None,
) -> StreamingQuery:
    """Append a stream to Parquet, exactly once per checkpoint.

    With an interval the query runs on; without one it takes all that is available and stops.
    Read the result with Spark: the sink's ``_spark_metadata`` log lists the committed files.
    A batch writes one file per task and partition value. ``max_writers`` bounds its tasks without a
    shuffle, so that many topic partitions do not make as many small files and log entries.
    """
    if max_writers:
        stream = stream.coalesce(max_writers)
    writer = stream.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    if by:
        writer = writer.partitionBy(by)
    if interval:
        return writer.trigger(processingTime=interval).start()
    return writer.trigger(availableNow=True).start()


def start_bronze(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    interval: str | None = f"{TRIGGER_SECONDS} seconds",
    keep_rejects: bool = False,
    max_writers: int | None = None,
) -> StreamingQuery:
    """Decode a message stream and append it to bronze by ingestion date.

    The progress of each batch reports its ``total`` and ``valid`` messages under ``delivery``.
    """
    rows = bronze_rows(messages, keep_rejects)
    counted = rows.observe(
        "delivery", F.count(F.lit(1)).alias("total"), F.count_if(all_present(REQUIRED)).alias("valid")
    )
    return start_append(counted, path, checkpoint, "ingestion_date", interval, max_writers)
