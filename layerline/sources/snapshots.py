"""A Parquet directory whose content changes in one step.

Each write puts its files into folders of its own, ``<column>=<value>/write_id=<id>``. A small numbered file below
``_snapshots`` lists the folders that make up the table; the one with the highest number counts. A write that fails leaves
the list, and so the table, as it was; readers of an earlier list are not disturbed until ``drop_unlisted``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from layerline.sources import paths

LISTS = "_snapshots"


def current(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Number and folders of the table's present content; 0 where nothing was published."""
    numbers = paths.names(spark, f"{path}/{LISTS}")
    if not numbers:
        return 0, []
    return int(numbers[-1]), paths.read_text(spark, f"{path}/{LISTS}/{numbers[-1]}").split("\n")[:-1]


def read_snapshot(spark: SparkSession, path: str, schema: StructType, folders: list[str] | None = None) -> DataFrame:
    """The table's present content, or that of the given folders. Filters on the partition column prune folders."""
    folders = current(spark, path)[1] if folders is None else folders
    if not folders:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{folder}" for folder in folders])
    return found.select(*schema.names)


def write_folders(df: DataFrame, path: str, by: str) -> list[str]:
    """Write the rows into new folders, which no list names yet."""
    spark, write_id = df.sparkSession, uuid.uuid4().hex
    marked = df.hint("rebalance", by).withColumn("write_id", F.lit(write_id))
    marked.write.mode("append").partitionBy(by, "write_id").parquet(path)
    values = [name for name in paths.names(spark, path) if name.startswith(f"{by}=")]
    return [f"{value}/write_id={write_id}" for value in values if paths.exists(spark, f"{path}/{value}/write_id={write_id}")]


def publish(spark: SparkSession, path: str, after: int, folders: list[str]) -> None:
    """Make the folders the table's content, if it is still that of list number ``after``; fails otherwise."""
    draft = f"{path}/{LISTS}/.{uuid.uuid4().hex}"
    paths.write_text(spark, draft, "".join(f"{folder}\n" for folder in sorted(folders)))
    try:
        paths.move_new(spark, draft, f"{path}/{LISTS}/{after + 1:010d}")
    except Exception as error:
        paths.remove(spark, draft)
        raise RuntimeError(f"{path} was changed by another writer since list {after}") from error


def replace(df: DataFrame, path: str, by: str) -> None:
    """Replace the whole table in one step."""
    number, _ = current(df.sparkSession, path)
    publish(df.sparkSession, path, number, write_folders(df, path, by))


def folder_value(folder: str) -> str | None:
    """The partition value that a folder's name spells, null for the default partition."""
    value = folder.split("/")[0].partition("=")[2]
    return None if value == "__HIVE_DEFAULT_PARTITION__" else value


def drop_unlisted(spark: SparkSession, path: str, by: str, older_than_seconds: float) -> int:
    """Delete folders that the present list does not name, and earlier lists, once they are of that age.

    Choose an age beyond that of the longest reader and writer. Returns the number of folders deleted.
    """
    number, listed = current(spark, path)
    dropped = 0
    for value in [name for name in paths.names(spark, path) if name.startswith(f"{by}=")]:
        for write in paths.names(spark, f"{path}/{value}"):
            folder = f"{value}/{write}"
            if folder not in listed and paths.age_seconds(spark, f"{path}/{folder}") >= older_than_seconds:
                paths.remove(spark, f"{path}/{folder}")
                dropped += 1
    for name in paths.names(spark, f"{path}/{LISTS}"):
        if int(name) < number and paths.age_seconds(spark, f"{path}/{LISTS}/{name}") >= older_than_seconds:
            paths.remove(spark, f"{path}/{LISTS}/{name}")
    return dropped
