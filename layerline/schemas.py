"""Schemas and column orders of the match model.

Every operator takes its columns as arguments; these are the defaults.
"""

from __future__ import annotations

from pyspark.sql.types import ArrayType, StructType


def struct_of(columns: dict) -> StructType:
    """Nullable struct from ``{name: type}``; a nested dict becomes a nested struct."""
    schema = StructType()
    for name, kind in columns.items():
        schema = schema.add(name, struct_of(kind) if isinstance(kind, dict) else kind)
    return schema


# Column names and types of the event record and of the match document.
_EVENT = {
    "event_id": "string",
    "match_id": "integer",
    "competition_code": "string",
    "status": "string",
    "utc_date": "string",
    "matchday": "integer",
    "home_team_id": "integer",
    "home_team_name": "string",
    "away_team_id": "integer",
    "away_team_name": "string",
    "score_home": "integer",
    "score_away": "integer",
    "ingested_at": "string",
}
_MESSAGE_META = {
    "kafka_key": "string",
    "kafka_partition": "integer",
    "kafka_offset": "long",
    "kafka_timestamp": "timestamp",
}
_TEAM = {"id": "integer", "name": "string"}
_MATCH = {
    "id": "integer",
    "lastUpdated": "string",
    "utcDate": "string",
    "status": "string",
    "matchday": "integer",
    "competition": {"code": "string"},
    "homeTeam": _TEAM,
    "awayTeam": _TEAM,
    "score": {"fullTime": {"home": "integer", "away": "integer"}},
}

# The columns of the staging view and of the fact table, in order.
STAGING_COLUMNS = (
    "event_id", "match_id", "competition_code", "matchday",
    "home_team_id", "home_team_name", "away_team_id", "away_team_name",
    "score_home", "score_away", "status", "match_timestamp", "match_date",
    "ingested_at", "kafka_partition", "kafka_offset",
)
FACT_COLUMNS = (
    "match_id", "event_id", "competition_code", "matchday",
    "home_team_id", "home_team_name", "away_team_id", "away_team_name",
    "score_home", "score_away", "result", "status",
    "match_timestamp", "match_date", "ingested_at",
)

EVENT = struct_of(_EVENT)
MESSAGE_META = struct_of(_MESSAGE_META)
BRONZE = struct_of({**_EVENT, **_MESSAGE_META, "ingestion_date": "date"})
# Bronze that also keeps why a message was rejected and its text.
BRONZE_WITH_REJECTS = struct_of(
    {**_EVENT, **_MESSAGE_META, "ingestion_date": "date", "error_reason": "string", "raw_value": "string"}
)
SILVER = struct_of(
    {**_EVENT, **_MESSAGE_META, "ingestion_date": "date", "match_timestamp": "timestamp", "match_date": "date"}
)
MATCH = struct_of(_MATCH)
RESPONSE = StructType().add("matches", ArrayType(MATCH))

# The columns of the Kafka source that the decode step reads, plus the topic.
MESSAGE = struct_of(
    {"key": "binary", "value": "binary", "topic": "string", "partition": "integer", "offset": "long",
     "timestamp": "timestamp"}
)

REQUIRED = ("event_id", "match_id")
EVENT_KEY = ("event_id",)
# Offsets are unique within a topic partition; the date tells apart a message that was landed twice.
LATEST_FIRST = ("kafka_offset", "kafka_partition", "ingestion_date")
