"""Delivery counts of each batch, kept by a listener."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from layerline.sources import paths

COUNTERS = "query string, batch_id long, total long, ok long, repaired long, failed long"


class DeliveryCounters(StreamingQueryListener):
    """Stores the observed counts of each batch as one small file, which a batch that is run again replaces.

    Add it with ``spark.streams.addListener`` before the query starts. Events come after the batch: call ``wait`` before
    reading the counts of a query that has ended. A batch whose event is lost with the driver has no file.
    """

    def __init__(self, spark: SparkSession, path: str, metric: str = "delivery"):
        self.spark, self.path, self.metric = spark, path, metric
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.id), threading.Event()).clear()

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        counts = progress.observedMetrics.get(self.metric)
        if counts is not None and progress.numInputRows:
            row = {"query": str(progress.id), "batch_id": progress.batchId, **counts.asDict()}
            paths.write_text(self.spark, f"{self.path}/{progress.id}-{progress.batchId:012d}.json", json.dumps(row) + "\n")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.id), threading.Event()).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> bool:
        """Whether all events of an ended query have come."""
        return self.ended.setdefault(str(query.id), threading.Event()).wait(seconds)


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COUNTERS).json(path)
