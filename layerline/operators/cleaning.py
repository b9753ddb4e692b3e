"""Required fields, keep-latest dedup and typed times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from layerline.functions import all_present, written_date, written_timestamp


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every one of the columns is present."""
    return df.where(all_present(columns))


def keep_latest(df: DataFrame, keys: Sequence[str], latest_first: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest ``latest_first`` values, nulls ranking last.

    The rank test is planned as a group limit on both sides of the shuffle, so a task sends at most
    one row per key, however many copies of it there are. Name enough columns to break ties:
    among full ties any one is kept.
    """
    newest = [F.col(name).desc_nulls_last() for name in latest_first]
    # The hash adds nothing to the grouping. It leads the sort, which tells most rows apart by their
    # first eight bytes; text keys often share those.
    grouped = Window.partitionBy(F.xxhash64(*keys), *keys)
    rank = F.row_number().over(grouped.orderBy(*newest))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def with_times(df: DataFrame, text: str, timestamp: str, date: str) -> DataFrame:
    """Add a timestamp and a date read from a text column; bad text gives nulls and keeps the row."""
    return df.withColumns({timestamp: written_timestamp(text), date: written_date(text)})
