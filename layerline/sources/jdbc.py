"""Relational load and read over JDBC. The driver jar and the connection come from the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def connect_catalog(spark: SparkSession, catalog: str, url: str, driver: str, **options: str) -> None:
    """Register a database as a Spark catalog, so that its schemas and tables have SQL names."""
    prefix = f"spark.sql.catalog.{catalog}"
    spark.conf.set(prefix, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    for key, value in {"url": url, "driver": driver, **options}.items():
        spark.conf.set(f"{prefix}.{key}", value)


def create_schema(spark: SparkSession, catalog: str, schema: str) -> None:
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {catalog}.{schema}")


def load_options(url: str, table: str, writers: int = 16, batch_rows: int = 1000, **options: str) -> dict[str, str]:
    return {"url": url, "dbtable": table, "numPartitions": str(writers), "batchsize": str(batch_rows), "truncate": "true", **options}


def write_jdbc(df: DataFrame, url: str, table: str, writers: int = 16, batch_rows: int = 1000, **options: str) -> None:
    """Replace a database table, with at most ``writers`` connections open at a time.

    The table is emptied and kept, with the views that depend on it; ``truncate="false"`` makes it anew.

    A task commits its own transaction, so one that is lost after its commit and run again leaves
    its rows twice. Compare ``count_jdbc`` with the source and load again if they differ.
    """
    df.write.format("jdbc").options(**load_options(url, table, writers, batch_rows, **options)).mode("overwrite").save()


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    split_column: str | None = None,
    lower: str | None = None,
    upper: str | None = None,
    readers: int = 16,
    **options: str,
) -> DataFrame:
    """Read a database table, in parallel ranges of ``split_column`` when it is given.

    The bounds only place the range borders; rows outside them are read by the outer ranges.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split_column:
        reader = reader.options(
            partitionColumn=split_column, lowerBound=lower, upperBound=upper, numPartitions=str(readers)
        )
    return reader.load()


def count_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Row count of a database table, computed by the database."""
    query = f"SELECT count(*) AS n FROM {table}"
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()
