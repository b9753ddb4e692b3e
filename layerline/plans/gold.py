"""Silver to gold: staging projection, team dimension, match fact."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from layerline.functions import match_result
from layerline.operators.quality import Rule
from layerline.operators.roles import hot_values, is_hot, role_dimension, role_join
from layerline.schemas import FACT_COLUMNS, STAGING_COLUMNS
from layerline.session import scratch_path
from layerline.sources.tables import as_bucketed_table

TEAM_ROLES = {"home": "home_team_id", "away": "away_team_id"}
TEAM_COLUMNS = ("team_id", "team_name")

# The rules declared for silver, with their accepted codes.
SILVER_RULES = (
    Rule("unique", "event_id"),
    Rule("not_null", "event_id"),
    Rule("not_null", "match_id"),
    Rule("not_null", "competition_code"),
    Rule("accepted_values", "competition_code", ("PL", "CL", "BL1", "SA", "PD", "FL1")),
    Rule(
        "accepted_values",
        "status",
        ("SCHEDULED", "LIVE", "IN_PLAY", "PAUSED", "FINISHED", "POSTPONED", "CANCELLED"),
    ),
)
# A team under several names makes several dimension rows and multiplies facts; this rule shows it.
DIMENSION_RULES = (Rule("unique", "team_id"),)


def staging(silver: DataFrame) -> DataFrame:
    return silver.select(*STAGING_COLUMNS)


def dim_teams(stg: DataFrame) -> DataFrame:
    roles = [(f"{role}_team_id", f"{role}_team_name") for role in TEAM_ROLES]
    return role_dimension(stg, roles, TEAM_COLUMNS)


def by_name(teams: DataFrame) -> DataFrame:
    """The dimension in display order. A stored table keeps no order, so sort where it is shown."""
    return teams.orderBy(F.col("team_name").asc_nulls_last())


def fct_match_events(stg: DataFrame, teams: DataFrame) -> DataFrame:
    """One row per staged event and matching pair of team rows, with the result.

    Team names come from the dimension. Pass ``teams`` as a stored table (see ``role_join``).
    """
    joined = role_join(stg, teams, TEAM_ROLES, "team_id", _names(TEAM_ROLES))
    return _with_result(joined)


def _names(roles: Iterable[str]) -> dict[str, dict[str, str]]:
    return {role: {"team_name": f"{role}_team_name"} for role in roles}


def _with_result(joined: DataFrame) -> DataFrame:
    return joined.withColumn("result", match_result("score_home", "score_away")).select(*FACT_COLUMNS)


def bucketed_fact(stg: DataFrame, teams: DataFrame, schema: str, path: str, buckets: int = 256) -> DataFrame:
    """The rows of ``fct_match_events`` for a dimension that is too large to broadcast.

    The dimension is stored once in buckets of the team. For each role the facts are stored in as many buckets of that
    role's team, and joined to it bucket by bucket without another shuffle. Rows of hot teams and without a team are kept
    out of the buckets and joined to the few dimension rows of those teams, which are stored, so that Spark knows
    their size. The bucketed tables ``dim_teams_buckets`` and ``facts_by_<role>`` stay in ``schema`` below ``path``.
    """
    spark = stg.sparkSession
    stored = as_bucketed_table(teams, f"{schema}.dim_teams_buckets", "team_id", buckets, f"{path}/dim_teams_buckets")
    facts = stg
    for role, key in TEAM_ROLES.items():
        hot = hot_values(stg, key, buckets)
        place = scratch_path(spark, "hot_teams")
        stored.where(F.col("team_id").isin(hot) if hot else F.lit(False)).write.parquet(place)
        few = spark.read.schema(stored.schema).parquet(place)
        cold = as_bucketed_table(
            facts.where(~is_hot(key, hot)), f"{schema}.facts_by_{role}", key, buckets, f"{path}/facts_by_{role}"
        )
        facts = join_team(cold, stored, role).unionByName(join_team(facts.where(is_hot(key, hot)), few, role))
    return _with_result(facts)


def join_team(facts: DataFrame, teams: DataFrame, role: str) -> DataFrame:
    """Facts with the team name of one role."""
    return role_join(facts, teams, {role: TEAM_ROLES[role]}, "team_id", _names([role]))
