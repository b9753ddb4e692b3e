"""Silver kept up to date by a stream of bronze rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from layerline.plans.silver import merge_silver
from layerline.streaming.batches import start_batches


def start_silver(bronze: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Merge each batch of bronze rows into the snapshot table at ``path``. A batch that is run again changes nothing."""
    return start_batches(bronze, [lambda batch, number: merge_silver(batch, path)], checkpoint, interval)
