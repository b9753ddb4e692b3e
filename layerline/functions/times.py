from __future__ import annotations

from pyspark.sql import Column, functions as F


def written_timestamp(column: str) -> Column:
    """Instant named by ISO text, its offset respected; null for bad text, also under ANSI mode."""
    return F.col(column).try_cast("timestamp")


def written_date(column: str) -> Column:
    """The date as written in the text, so it does not move with the session time zone."""
    return F.col(column).try_cast("date")
