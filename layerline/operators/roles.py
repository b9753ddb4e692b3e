"""Role-playing dimensions: one entity seen through several columns of a fact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def role_dimension(df: DataFrame, roles: Sequence[Sequence[str]], names: Sequence[str]) -> DataFrame:
    """Distinct entities over all roles; the first name is the key and must be present.

    ``roles`` lists each role's columns in the order of ``names``. The roles are unfolded inside one
    scan and deduplicated before the shuffle, so the exchange carries distinct entities per task.
    """
    entities = F.array(*[
        F.struct(*[F.col(column).alias(name) for column, name in zip(columns, names, strict=True)])
        for columns in roles
    ])
    return df.select(F.inline(entities)).where(F.col(names[0]).isNotNull()).distinct()


def role_join(
    facts: DataFrame, dimension: DataFrame, roles: Mapping[str, str], key: str, attributes: Mapping[str, Mapping[str, str]]
) -> DataFrame:
    """Left-join one dimension once per role.

    ``roles`` maps a role to the fact's key column, ``attributes`` maps a role to
    ``{dimension column: output column}``. Output columns replace fact columns of the same name.
    Facts without a match stay; a key with several dimension rows multiplies them.

    No join strategy is forced. Pass a dimension read from a written table: its files give Catalyst a
    measured size, so it is broadcast only below ``spark.sql.autoBroadcastJoinThreshold``. Beyond
    that both sides are shuffled and AQE splits the partitions of hot keys.
    """
    replaced = {name for columns in attributes.values() for name in columns.values()}
    joined = facts.drop(*replaced)
    for role, fact_key in roles.items():
        role_key = f"_{role}_key"
        side = dimension.select(
            F.col(key).alias(role_key), *[F.col(column).alias(name) for column, name in attributes[role].items()]
        )
        joined = joined.join(side, F.col(fact_key) == F.col(role_key), "left").drop(role_key)
    return joined


def hot_values(df: DataFrame, column: str, buckets: int, times: int = 4) -> list:
    """Values that hold more than ``times`` the rows of an even bucket: at most ``buckets / times`` of them."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    limit = times * df.count() / buckets
    return [row[0] for row in counted.where(F.col("n") > limit).select(column).collect()]


def is_hot(column: str, values: Sequence) -> Column:
    """Rows that no bucket should hold: those of hot values, and nulls, which match nothing."""
    return F.col(column).isNull() | F.col(column).isin(list(values)) if values else F.col(column).isNull()
