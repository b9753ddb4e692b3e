"""Nested match documents: unfold, flatten, select and count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from layerline.functions import utc_now_text, version_id


def explode_documents(responses: DataFrame, array: str = "matches", keep: Sequence[str] = ()) -> DataFrame:
    """One row per document of an envelope; a missing or empty array gives no rows.

    ``keep`` carries columns of the envelope along.
    """
    return responses.select(*keep, F.inline(array))


def normalize_matches(documents: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Flat event rows from nested match documents; a missing or null parent gives nulls."""
    return documents.select(
        version_id("id", "lastUpdated").alias("event_id"),
        F.col("id").alias("match_id"),
        F.col("competition.code").alias("competition_code"),
        "status",
        F.col("utcDate").alias("utc_date"),
        "matchday",
        *[
            F.col(f"{side}Team.{field}").alias(f"{side}_team_{field}")
            for side in ("home", "away")
            for field in ("id", "name")
        ],
        *[F.col(f"score.fullTime.{side}").alias(f"score_{side}") for side in ("home", "away")],
        utc_now_text().alias("ingested_at"),
        *keep,
    )


def select_matches(
    df: DataFrame,
    competitions: Sequence[str] | None = None,
    status: str | None = None,
    match_id: int | None = None,
) -> DataFrame:
    """Rows of the given competitions, status and match; a condition left out does not apply."""
    if competitions is not None:
        df = df.where(F.col("competition_code").isin(*competitions))
    if status is not None:
        df = df.where(F.col("status") == status)
    if match_id is not None:
        df = df.where(F.col("match_id") == match_id)
    return df


def counts_by(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias(name))
