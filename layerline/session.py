"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

# Timestamps are read and shown in UTC. AQE merges small shuffle partitions up to the advisory size, which
# is also the size of the files behind a rebalance, and splits skewed ones. It never makes more partitions
# than spark.sql.shuffle.partitions, so set that for the input: about its bytes over the advisory size.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """Session with the library's settings where nobody set them. The master is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    given = spark.conf.getAll
    for key, value in DEFAULTS.items():
        if key not in given:
            spark.conf.set(key, value)
    return spark


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="layerline-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder named by ``spark.checkpoint.dir``.

    The paths of one application lie together and can be deleted when it has ended. Only a local
    session may go without the setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_scratch()
    application = spark.sparkContext.applicationId
    return f"{base.rstrip('/')}/layerline/{application}/{label}-{uuid.uuid4().hex}"
