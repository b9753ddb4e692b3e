from __future__ import annotations

from pyspark.sql import Column, functions as F


def match_result(home: str, away: str) -> Column:
    """HOME_WIN, AWAY_WIN or DRAW; null while the home score is missing.

    A home score without an away score counts as DRAW, because neither comparison holds.
    """
    compared = (
        F.when(F.col(home) > F.col(away), "HOME_WIN")
        .when(F.col(home) < F.col(away), "AWAY_WIN")
        .otherwise("DRAW")
    )
    return F.when(F.col(home).isNotNull(), compared)
