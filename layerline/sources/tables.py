"""Views and tables of the Spark catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from layerline.sources.paths import age_seconds, names, remove


def as_view(df: DataFrame, name: str) -> DataFrame:
    """Expose a frame as a session view: nothing is computed or stored."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def as_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Replace a catalog table, making its schema if it is missing, and return the stored table.

    ``path`` keeps the files in a folder of the caller's choice instead of the warehouse.
    """
    spark = df.sparkSession
    schema, _, _ = name.rpartition(".")
    if schema:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return spark.table(name)


def read_relation(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def as_bucketed_table(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Replace a catalog table that is stored by the hash of one column, one file per bucket, and return it.

    Tables with as many buckets join on that column without a shuffle. One value's rows are in one bucket, so keep hot
    values apart (``operators.roles.hot_values``).
    """
    spark = df.sparkSession
    schema, _, _ = name.rpartition(".")
    if schema:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return spark.table(name)


def publish_table(df: DataFrame, name: str, path: str | None = None, by: str | None = None) -> DataFrame:
    """Store the rows in a new folder below ``path``, by default that of the schema, and let ``name`` show them.

    ``name`` is a view that is replaced in one step when all rows are stored, so a failure leaves what it showed before.
    Columns keep their order also where the files are partitioned ``by`` one. Former folders stay for readers that have
    begun; ``drop_former`` deletes them.
    """
    spark = df.sparkSession
    schema, _, table = name.rpartition(".")
    if schema:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    place = path or f"{spark.catalog.getDatabase(schema or spark.catalog.currentDatabase()).locationUri}/{table}"
    folder = f"{place}/version={uuid.uuid4().hex}"
    writer = df.hint("rebalance", by).write.partitionBy(by) if by else df.write
    writer.parquet(folder)
    columns = ", ".join(f"CAST(`{column}` AS {kind}) AS `{column}`" for column, kind in df.dtypes)
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType not in ("VIEW", "TEMPORARY"):
        spark.sql(f"DROP TABLE {name}")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {columns} FROM parquet.`{folder}`")
    return spark.table(name)


def drop_former(spark: SparkSession, name: str, place: str, older_than_seconds: float) -> list[str]:
    """Delete the folders below ``place`` that ``name`` does not show, once they are of that age."""
    shown = spark.table(name).inputFiles()
    old = [
        folder for folder in names(spark, place)
        if folder.startswith("version=") and not any(f"/{folder}/" in file for file in shown)
        and age_seconds(spark, f"{place}/{folder}") >= older_than_seconds
    ]
    for folder in old:
        remove(spark, f"{place}/{folder}")
    return old
