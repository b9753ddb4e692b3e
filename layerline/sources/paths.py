"""Files and folders of the file system that a path names, through Hadoop's own classes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, none where it is missing; hidden ones are left out."""
    files, where = _place(spark, path)
    if not files.exists(where):
        return []
    found = [status.getPath().getName() for status in files.listStatus(where)]
    return sorted(name for name in found if not name.startswith((".", "_")))


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _place(spark, path)
    return files.exists(where)


def age_seconds(spark: SparkSession, path: str) -> float:
    files, where = _place(spark, path)
    return (spark._jvm.java.lang.System.currentTimeMillis() - files.getFileStatus(where).getModificationTime()) / 1000


def make_folder(spark: SparkSession, path: str) -> None:
    files, where = _place(spark, path)
    files.mkdirs(where)


def remove(spark: SparkSession, path: str) -> None:
    files, where = _place(spark, path)
    files.delete(where, True)


def move_new(spark: SparkSession, source: str, target: str) -> None:
    """Rename in one step; fails when the target is there already."""
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        jvm.org.apache.hadoop.fs.Path(target).toUri(), spark._jsc.hadoopConfiguration()
    ) if "://" in target else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    path = jvm.org.apache.hadoop.fs.Path
    context.rename(path(source), path(target), no_options)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    files, where = _place(spark, path)
    out = files.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    files, where = _place(spark, path)
    source = files.open(where)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()
