"""Parquet tables and landed JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from layerline.schemas import RESPONSE

ANY_AGE = "36500d"


def read_table(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    date_column: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Scan a partitioned Parquet directory, whole or for dates from ``start`` to ``end`` inclusive.

    With a schema no footer is read to infer one, and a partition column whose values are all null
    keeps its type. A range on the partition column prunes directories.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    if start is not None:
        df = df.where(F.col(date_column) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date_column) <= F.lit(end).cast("date"))
    return df


def write_partitioned(
    df: DataFrame, path: str, by: str, rebalance: bool = True, only_touched_partitions: bool = False
) -> None:
    """Overwrite a Parquet directory partitioned by one column.

    The rebalance gathers each partition value into few files and lets AQE split a value that holds
    much of the table over several tasks. By default the whole directory is replaced;
    ``only_touched_partitions`` keeps the partitions that the new data does not mention.
    """
    if rebalance:
        df = df.hint("rebalance", by)
    mode = "dynamic" if only_touched_partitions else "static"
    df.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(by).parquet(path)


def read_documents(
    spark: SparkSession, path: str, schema: StructType = RESPONSE, multiline: bool = False, **options: str
) -> DataFrame:
    """Landed JSON responses, one per line, or one per file with ``multiline``.

    A line that is not JSON counts as a response without documents; ``mode="FAILFAST"`` stops at it, and
    ``read_landed`` with ``operators.responses`` sets it aside.
    """
    return spark.read.schema(schema).options(multiLine=multiline, **options).json(path)


def stream_documents(spark: SparkSession, path: str, schema: StructType = RESPONSE, **options: str) -> DataFrame:
    """The same responses as a stream over the files that land in a directory.

    Files count whatever their modification time: the source's own limit would skip backfilled ones.
    """
    return spark.readStream.schema(schema).options(**{"maxFileAge": ANY_AGE, **options}).json(path)


def _landed(reader, path: str, whole_files: bool, options: dict) -> DataFrame:
    text = reader.options(**options).text(path, wholetext=whole_files)
    return text.select("value", F.col("_metadata.file_path").alias("source_file"))


def read_landed(spark: SparkSession, path: str, whole_files: bool = False, **options: str) -> DataFrame:
    """Landed responses as they are: ``value`` and ``source_file``, one row per line, or per file with ``whole_files``.

    A folder of lines is split over tasks anywhere; a whole file is one value, so it must fit in memory. An empty file
    holds no response. ``pathGlobFilter`` tells apart files of both kinds in one folder.
    """
    return _landed(spark.read, path, whole_files, options)


def stream_landed(spark: SparkSession, path: str, whole_files: bool = False, **options: str) -> DataFrame:
    """The same as a stream over the files that land in a directory, whatever their age.

    ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` bound a batch; ``cleanSource="archive"`` with ``sourceArchiveDir``
    moves files away when the batch after theirs is planned.
    """
    return _landed(spark.readStream, path, whole_files, {"maxFileAge": ANY_AGE, **options})
