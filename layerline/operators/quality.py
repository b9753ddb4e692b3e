"""Declarative data-quality rules. A rule holds when its frame of failing rows is empty."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from layerline.session import scratch_path


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their count; nulls are ignored."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counted.where("n > 1")


def unique_by_hash(df: DataFrame, column: str) -> DataFrame:
    """The result of ``unique`` for long values that seldom repeat: whole values are not shuffled unless they may repeat.

    Counted first are 64-bit hashes. Those that occur twice or more, by repeated values or by chance, are stored, so their
    size is known: below ``spark.sql.autoBroadcastJoinThreshold`` they are broadcast, and only the values under them are
    grouped. The input is read twice.
    """
    spark = df.sparkSession
    values = df.where(F.col(column).isNotNull()).select(column)
    place = scratch_path(spark, "repeated_hashes")
    counted = values.groupBy(F.xxhash64(column).alias("_hash")).agg(F.count("*").alias("n"))
    counted.where("n > 1").select("_hash").write.parquet(place)
    repeated = spark.read.schema("_hash long").parquet(place)
    return unique(values.join(repeated, F.xxhash64(column) == F.col("_hash"), "left_semi"), column)


def not_null(df: DataFrame, column: str) -> DataFrame:
    """Rows in which the column is null."""
    return df.where(F.col(column).isNull())


def accepted_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Values outside the list, with their count; nulls pass."""
    return df.where(~F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Rule:
    """``kind`` is ``unique``, ``not_null`` or ``accepted_values``; ``by_hash`` tests a ``unique`` rule in two phases."""

    kind: str
    column: str
    values: tuple = ()
    by_hash: bool = False

    def __post_init__(self) -> None:
        if self.kind not in ("unique", "not_null", "accepted_values"):
            raise ValueError(f"no such kind of rule: {self.kind}")

    @property
    def name(self) -> str:
        return f"{self.kind}_{self.column}"

    def failing(self, df: DataFrame) -> DataFrame:
        if self.kind == "unique":
            return (unique_by_hash if self.by_hash else unique)(df, self.column)
        if self.kind == "not_null":
            return not_null(df, self.column)
        return accepted_values(df, self.column, self.values)

    def breach(self) -> Column:
        """Row-level test of a ``not_null`` or ``accepted_values`` rule."""
        if self.kind == "not_null":
            return F.col(self.column).isNull()
        return F.coalesce(~F.col(self.column).isin(*self.values), F.lit(False))


def run_checks(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: ``rule``, ``failures``, ``rows_affected``, ``passed``.

    ``failures`` counts failing rows for ``not_null`` and failing values for the other kinds. All
    row-level rules share one scan that passes on only rows with a breach; each ``unique`` rule needs its own
    shuffle on the column, with copies combined before it.
    """
    names = [rule.name for rule in rules]
    if len(set(names)) < len(names):
        raise ValueError("two rules of one kind on one column would share a result row: check them apart")
    listed = [F.struct(F.lit(rule.name).alias("rule")) for rule in rules]
    # A zero line per rule, so that rules without a breach are reported too.
    blank = df.sparkSession.range(1).select(F.inline(F.array(*listed)))
    parts = [blank.select("rule", F.lit(0).cast("long").alias("failures"), F.lit(0).cast("long").alias("rows_affected"))]

    row_level = [rule for rule in rules if rule.kind != "unique"]
    if row_level:
        breaches = F.array(*[
            F.when(rule.breach(), F.struct(F.lit(rule.name).alias("rule"), F.col(rule.column).cast("string").alias("value")))
            for rule in row_level
        ])
        any_breach = reduce(Column.__or__, [rule.breach() for rule in row_level])
        by_value = (
            df.where(any_breach)
            .select(F.inline(F.array_compact(breaches)))
            .groupBy("rule", "value")
            .agg(F.count("*").alias("n"))
        )
        value_failures = F.when(F.col("value").isNull(), F.col("n")).otherwise(F.lit(1))
        parts.append(by_value.select("rule", value_failures.alias("failures"), F.col("n").alias("rows_affected")))
    for rule in rules:
        if rule.kind == "unique":
            parts.append(
                rule.failing(df).agg(
                    F.count("*").alias("failures"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_affected")
                ).select(F.lit(rule.name).alias("rule"), "failures", "rows_affected")
            )

    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return (
        found.groupBy("rule")
        .agg(F.sum("failures").alias("failures"), F.sum("rows_affected").alias("rows_affected"))
        .withColumn("passed", F.col("failures") == 0)
    )
