from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from layerline.functions import match_result
from layerline.operators.roles import role_dimension, role_join
from layerline.plans import gold
from layerline.schemas import FACT_COLUMNS, SILVER, STAGING_COLUMNS


def silver(spark, rows):
    """Rows of (event_id, home id, home name, away id, away name, home score, away score)."""
    df = spark.createDataFrame(
        rows,
        "event_id string, home_team_id int, home_team_name string, away_team_id int, away_team_name string,"
        "score_home int, score_away int",
    )
    return df.select(*[
        F.col(field.name) if field.name in df.columns else F.lit(None).cast(field.dataType).alias(field.name)
        for field in SILVER
    ])


@pytest.mark.parametrize(
    "home, away, result",
    [(1, None, "DRAW"), (None, 1, None), (None, None, None), (2, 1, "HOME_WIN"), (1, 2, "AWAY_WIN"), (1, 1, "DRAW")],
)
def test_result(spark, home, away, result):
    df = spark.createDataFrame([(home, away)], "h int, a int")
    assert df.select(match_result("h", "a")).first()[0] == result


ROWS = [
    ("e1", 1, "A", 2, "B", 2, 1),
    ("e2", 2, "B", 1, "A FC", 0, 0),
    ("e3", None, "C", 3, None, None, None),
    ("e4", 1, "A", 2, "B", 0, 3),
]


def test_dimension_has_a_row_per_id_and_name(spark):
    teams = gold.by_name(gold.dim_teams(gold.staging(silver(spark, ROWS))))
    assert teams.columns == ["team_id", "team_name"]
    assert [tuple(row) for row in teams.collect()] == [(1, "A"), (1, "A FC"), (2, "B"), (3, None)]


def test_fact_multiplies_by_names_and_keeps_unmatched(spark):
    stg = gold.staging(silver(spark, ROWS))
    assert stg.columns == list(STAGING_COLUMNS)
    facts = gold.fct_match_events(stg, gold.dim_teams(stg))
    assert facts.columns == list(FACT_COLUMNS)
    found = sorted((r.event_id, r.home_team_name, r.away_team_name, r.result) for r in facts.collect() if r.home_team_id)
    assert found == [
        ("e1", "A", "B", "HOME_WIN"), ("e1", "A FC", "B", "HOME_WIN"),
        ("e2", "B", "A", "DRAW"), ("e2", "B", "A FC", "DRAW"),
        ("e4", "A", "B", "AWAY_WIN"), ("e4", "A FC", "B", "AWAY_WIN"),
    ]
    (lonely,) = facts.where("home_team_id IS NULL").collect()
    assert (lonely.home_team_name, lonely.away_team_id, lonely.away_team_name) == (None, 3, None)


def test_role_dimension_takes_any_columns(spark):
    df = spark.createDataFrame([(1, "x", 2, "y", 3, "z")], "a int, an string, b int, bn string, c int, cn string")
    entities = role_dimension(df, [("a", "an"), ("b", "bn"), ("c", "cn")], ("id", "name"))
    assert sorted(map(tuple, entities.collect())) == [(1, "x"), (2, "y"), (3, "z")]


def test_role_join_with_one_role_and_several_attributes(spark):
    facts = spark.createDataFrame([(1, 7), (2, 8)], "id int, k int")
    dim = spark.createDataFrame([(7, "x", 1.0)], "key int, name string, size double")
    joined = role_join(facts, dim, {"r": "k"}, "key", {"r": {"name": "r_name", "size": "r_size"}})
    assert joined.columns == ["id", "k", "r_name", "r_size"]
    assert sorted(map(tuple, joined.collect())) == [(1, 7, "x", 1.0), (2, 8, None, None)]
