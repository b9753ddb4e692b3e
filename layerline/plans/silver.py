"""Bronze to silver: required fields, latest version of each record, typed times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from layerline.functions import all_present
from layerline.operators.cleaning import keep_latest, require, with_times
from layerline.schemas import EVENT_KEY, LATEST_FIRST, REQUIRED, SILVER
from layerline.session import scratch_path
from layerline.sources import paths, snapshots
from layerline.sources.files import read_table, write_partitioned


def to_silver(
    bronze: DataFrame,
    required: Sequence[str] = REQUIRED,
    keys: Sequence[str] = EVENT_KEY,
    latest_first: Sequence[str] = LATEST_FIRST,
) -> DataFrame:
    latest = keep_latest(require(bronze, required), keys, latest_first)
    return with_times(latest, "utc_date", "match_timestamp", "match_date")


def write_silver(bronze: DataFrame, path: str) -> DataFrame:
    """Rewrite silver by match date and return the stored table."""
    write_partitioned(to_silver(bronze), path, "match_date")
    return read_table(bronze.sparkSession, path, SILVER)


def silver_counts(bronze: DataFrame, silver: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """One row: rows read, clean and written, duplicates removed, number of silver columns.

    Bronze is read for its required columns only and a stored silver for its footers only. Counts
    observed while writing would be cheaper but sit before the shuffle, where the tasks that are run
    again after an executor loss are counted again.
    """
    zero = F.lit(0).cast("long")
    before = bronze.agg(
        F.count("*").alias("rows_read"),
        F.count_if(all_present(required)).alias("rows_clean"),
        zero.alias("rows_written"),
    )
    after = silver.agg(zero.alias("rows_read"), zero.alias("rows_clean"), F.count("*").alias("rows_written"))
    total = before.unionByName(after).agg(
        *[F.sum(name).alias(name) for name in ("rows_read", "rows_clean", "rows_written")]
    )
    return total.select(
        "rows_read",
        "rows_clean",
        (F.col("rows_clean") - F.col("rows_written")).alias("duplicates_removed"),
        "rows_written",
        F.lit(len(silver.columns)).alias("columns_written"),
    )


def replace_silver(bronze: DataFrame, path: str) -> DataFrame:
    """Rewrite silver in one step, as a snapshot table, and return it: a failure on the way leaves the former content."""
    snapshots.replace(to_silver(bronze), path, "match_date")
    return snapshots.read_snapshot(bronze.sparkSession, path, SILVER)


def merge_silver(
    bronze: DataFrame,
    path: str,
    required: Sequence[str] = REQUIRED,
    keys: Sequence[str] = EVENT_KEY,
    latest_first: Sequence[str] = LATEST_FIRST,
) -> list[str | None]:
    """Bring new bronze rows into a snapshot table of silver; returns the dates that were rewritten.

    The result is that of ``to_silver`` over all rows ever merged, in whatever order they came, and merging rows again
    changes nothing. Rewritten are the dates of the new rows and those from which a record moves away. To find the latter,
    the keys of silver are read; below ``spark.sql.autoBroadcastJoinThreshold`` the new keys are broadcast to them.
    """
    spark = bronze.sparkSession
    place = scratch_path(spark, "silver_batch")
    to_silver(bronze, required, keys, latest_first).write.parquet(place)
    new = spark.read.schema(SILVER).parquet(place)
    number, folders = snapshots.current(spark, path)
    stored = snapshots.read_snapshot(spark, path, SILVER, folders)
    former = stored.join(new.select(*keys), list(keys), "left_semi").select("match_date")
    # At most one row per date.
    dates = former.union(new.select("match_date")).distinct().select(F.col("match_date").cast("string")).collect()
    touched = {row.match_date for row in dates}
    if touched:
        rewritten = [folder for folder in folders if snapshots.folder_value(folder) in touched]
        rows = snapshots.read_snapshot(spark, path, SILVER, rewritten).unionByName(new)
        made = snapshots.write_folders(keep_latest(rows, keys, latest_first), path, "match_date")
        snapshots.publish(spark, path, number, [folder for folder in folders if folder not in rewritten] + made)
    paths.remove(spark, place)
    return sorted(touched, key=str)
