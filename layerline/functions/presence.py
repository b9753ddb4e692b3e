from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def all_present(columns: Sequence[str]) -> Column:
    """True where none of the columns is null; as a filter it reaches the Parquet scan."""
    return reduce(Column.__and__, [F.col(name).isNotNull() for name in columns], F.lit(True))
