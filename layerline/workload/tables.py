"""Test tables, and the match records that are derived from ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from layerline.schemas import BRONZE, EVENT, MESSAGE
from layerline.operators.messages import encode


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The codes that ``user_id % 7`` and the event type stand for.
COMPETITIONS = ("PL", "CL", "BL1", "SA", "PD", "FL1", "XX")
STATUSES = {
    "signup": "SCHEDULED",
    "view": "LIVE",
    "click": "FINISHED",
    "purchase": "POSTPONED",
    "error": "SUSPENDED",
}


def bronze_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze-shaped match records: one per event, with repeats, nulls and bad values.

    A projection of ``events`` without a shuffle; the rules are those of FIXTURES.md.
    """
    events = table(spark, sf_dir, "events")
    every = lambda n: F.col("event_id") % n == 0
    home = (F.col("user_id") % 20).cast("int")
    away = ((F.col("user_id") * 7 + 3) % 20).cast("int")
    day = F.date_format("ts", "yyyy-MM-dd")
    scored = F.col("event_type").isin("view", "click")
    status = F.create_map(*[F.lit(text) for pair in STATUSES.items() for text in pair])[F.col("event_type")]
    competition = F.element_at(
        F.array(*[F.lit(code) for code in COMPETITIONS]), (F.col("user_id") % 7 + 1).cast("int")
    )
    columns = {
        "event_id": F.when(~every(89), F.concat(F.col("user_id").cast("string"), F.lit("-"), day)),
        "match_id": F.when(~every(97), F.col("user_id").cast("int")),
        "competition_code": competition,
        "status": status,
        "utc_date": F.when(every(101), "bad").otherwise(F.concat(day, F.date_format("ts", "'T'HH':00:00Z'"))),
        "matchday": F.dayofmonth("ts"),
        "home_team_id": F.when(~every(53), home),
        "home_team_name": F.concat(F.lit("Team "), home.cast("string")),
        "away_team_id": away,
        "away_team_name": F.concat(
            F.lit("Team "), away.cast("string"), F.when(away == 0, " FC").otherwise("")
        ),
        "score_home": F.when(scored, (F.floor("value") % 4).cast("int")),
        "score_away": F.when(scored & ~every(13), (F.col("user_id") % 4).cast("int")),
        "ingested_at": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        "kafka_partition": (F.col("user_id") % 3).cast("int"),
        "kafka_offset": F.col("event_id"),
        "kafka_timestamp": F.col("ts").cast("timestamp"),
        "ingestion_date": F.col("ts").cast("date"),
    }
    columns["kafka_key"] = F.coalesce(columns["match_id"].cast("string"), F.lit("unknown"))
    return events.select(*[columns[name].alias(name) for name in BRONZE.names])


def _document() -> Column:
    """A record as a nested match document."""
    sides = {
        side: F.struct(F.col(f"{side}_team_id").alias("id"), F.col(f"{side}_team_name").alias("name"))
        for side in ("home", "away")
    }
    full_time = F.struct(F.col("score_home").alias("home"), F.col("score_away").alias("away"))
    return F.struct(
        F.col("match_id").alias("id"),
        F.substring_index("event_id", "-", -3).alias("lastUpdated"),
        F.col("utc_date").alias("utcDate"),
        "status",
        "matchday",
        F.struct(F.col("competition_code").alias("code")).alias("competition"),
        sides["home"].alias("homeTeam"),
        sides["away"].alias("awayTeam"),
        F.struct(full_time.alias("fullTime")).alias("score"),
    )


def match_responses(bronze: DataFrame) -> DataFrame:
    """The same records as nested documents: one numbered response per record, holding it alone.

    Beside every 50th lies one without its array, and beside every other 50th one with an empty array.
    """
    document = _document()
    place = F.col("kafka_offset") % 50
    full = F.array(document)
    extra = F.when(place == 1, F.slice(full, 1, 0))
    envelope = lambda matches: F.struct(F.col("kafka_offset").alias("sequence"), matches.alias("matches"))
    envelopes = F.when(place < 2, F.array(envelope(full), envelope(extra))).otherwise(F.array(envelope(full)))
    return bronze.select(F.inline(envelopes))


def messages(events: DataFrame) -> DataFrame:
    """Event rows with message metadata as keyed JSON messages in the shape of the Kafka source."""
    encoded = encode(events, columns=EVENT.names, keep=["kafka_partition", "kafka_offset", "kafka_timestamp"])
    return encoded.select(
        F.col("key").cast("binary"),
        F.col("value").cast("binary"),
        F.lit("matches").alias("topic"),
        *[F.col(f"kafka_{name}").alias(name) for name in ("partition", "offset", "timestamp")],
    ).select(*MESSAGE.names)


def damaged(sent: DataFrame) -> DataFrame:
    """The messages with a fifth of the values cut, emptied, wrapped in an array or given a text id."""
    text = F.col("value").cast("string")
    place = F.col("offset") % 20
    broken = (
        F.when(place == 1, F.substr(text, F.lit(1), F.length(text) - 1))
        .when(place == 2, F.lit(None))
        .when(place == 3, F.concat(F.lit("["), text, F.lit("]")))
        .when(place == 4, F.regexp_replace(text, r'"match_id":(\d+)', '"match_id":"$1"'))
        .otherwise(text)
    )
    return sent.withColumn("value", broken.cast("binary"))


def repairable(sent: DataFrame) -> DataFrame:
    """The messages with a twentieth of the match days written as text."""
    text = F.col("value").cast("string")
    changed = F.when(F.col("offset") % 20 == 5, F.regexp_replace(text, r'"matchday":(\d+)', '"matchday":"day $1"')).otherwise(text)
    return sent.withColumn("value", changed.cast("binary"))


# Responses per thousand that are landed as files of their own, written over several lines.
WHOLE, WHOLE_CUT = 7, 8


def landed_responses(bronze: DataFrame, per: int = 5) -> DataFrame:
    """``sequence, layout, value``: numbered responses of up to ``per`` records each, a fourth of them damaged.

    ``layout`` is ``files`` for those that are to be landed one per file, ``lines`` for the others.
    """
    numbered = bronze.select(F.floor(F.col("kafka_offset") / per).alias("sequence"), F.struct("kafka_offset", _document().alias("d")).alias("r"))
    held = numbered.groupBy("sequence").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["d"]).alias("matches"))
    envelope = F.struct("sequence", "matches")
    text, pretty = F.to_json(envelope), F.to_json(envelope, {"pretty": "true"})
    place, rare = F.col("sequence") % 20, F.col("sequence") % 1000
    value = (
        F.when(rare == WHOLE, pretty)
        .when(rare == WHOLE_CUT, F.substr(pretty, F.lit(1), F.length(pretty) - 3))
        .when(place == 1, F.substr(text, F.lit(1), F.length(text) - 2))
        .when(place == 2, F.lit("<html><body>Too Many Requests</body></html>"))
        .when(place == 3, F.to_json(F.struct("sequence", F.lit("none").alias("matches"))))
        .when(place == 4, F.concat(F.lit("["), text, F.lit("]")))
        .when(place == 5, F.regexp_replace(text, r'"matchday":(\d+)', '"matchday":"day $1"'))
        .otherwise(text)
    )
    layout = F.when(rare.isin(WHOLE, WHOLE_CUT), "files").otherwise("lines")
    return held.select("sequence", layout.alias("layout"), value.alias("value"))


def land(responses: DataFrame, root: str) -> None:
    """Write responses as line files below ``lines`` and as one file each below ``files``."""
    responses.where("layout = 'lines'").select("value").write.text(f"{root}/lines")
    responses.where("layout = 'files'").select("sequence", "value").write.partitionBy("sequence").text(f"{root}/files")
