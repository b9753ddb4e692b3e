from __future__ import annotations

import re

from layerline.operators.matches import counts_by, explode_documents, normalize_matches, select_matches
from layerline.schemas import EVENT
from layerline.sources.files import read_documents, stream_documents

LANDED = [
    '{"matches":[{"id":1,"lastUpdated":"2026-01-01T00:00:00Z","utcDate":"2026-01-02T20:00:00Z","status":"SCHEDULED",'
    '"matchday":3,"competition":{"code":"PL"},"homeTeam":{"id":10,"name":"A"},"awayTeam":{"id":11,"name":"B"},'
    '"score":{"fullTime":{"home":2,"away":1}},"venue":"ignored"},'
    '{"id":2,"homeTeam":null,"score":{"fullTime":null}}]}',
    '{"matches":[{"id":3,"lastUpdated":null,"competition":{}},{"lastUpdated":"2026-01-01T00:00:00Z"}]}',
    '{"matches":[]}',
    '{"count":0}',
]


def landed(tmp_path):
    (tmp_path / "a.json").write_text("\n".join(LANDED))
    return str(tmp_path)


def test_landed_documents_become_events(spark, tmp_path):
    events = normalize_matches(explode_documents(read_documents(spark, landed(tmp_path))))
    assert events.columns == EVENT.names
    assert [kind for _, kind in events.dtypes] == [field.dataType.simpleString() for field in EVENT]
    rows = {row.event_id: row.asDict() for row in events.collect()}
    assert set(rows) == {"1-2026-01-01T00:00:00Z", "2-", "3-", None}
    first = rows["1-2026-01-01T00:00:00Z"]
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00", first.pop("ingested_at"))
    assert first == {
        "event_id": "1-2026-01-01T00:00:00Z", "match_id": 1, "competition_code": "PL", "status": "SCHEDULED",
        "utc_date": "2026-01-02T20:00:00Z", "matchday": 3, "home_team_id": 10, "home_team_name": "A",
        "away_team_id": 11, "away_team_name": "B", "score_home": 2, "score_away": 1,
    }
    assert (rows["2-"]["home_team_id"], rows["2-"]["away_team_name"], rows["2-"]["score_home"]) == (None, None, None)
    assert rows["3-"]["competition_code"] is None
    assert rows[None]["match_id"] is None


def test_multiline_response(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "matches": [\n  {"id": 4}\n ]\n}')
    documents = explode_documents(read_documents(spark, str(tmp_path), multiline=True))
    assert [row.id for row in documents.collect()] == [4]


def test_landed_stream_gives_the_same_events(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    stream = normalize_matches(explode_documents(stream_documents(spark, landed(source))))
    query = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_utc_stamp_does_not_depend_on_the_session_zone(spark):
    from datetime import datetime, timezone

    from layerline.functions import utc_now_text

    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        text = spark.range(1).select(utc_now_text()).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert abs((datetime.now(timezone.utc) - datetime.fromisoformat(text)).total_seconds()) < 60


def test_select_matches(spark):
    df = spark.createDataFrame(
        [(1, "PL", "SCHEDULED"), (2, "PL", "LIVE"), (3, "SA", "SCHEDULED"), (4, None, None)],
        "match_id int, competition_code string, status string",
    )

    def ids(**conditions):
        return sorted(row.match_id for row in select_matches(df, **conditions).collect())

    assert ids(competitions=["PL", "CL", "BL1"], status="SCHEDULED") == [1]
    assert ids(status="LIVE") == [2]
    assert ids(match_id=3) == [3]
    assert ids() == [1, 2, 3, 4]
    counts = {row.competition_code: row.n for row in counts_by(df, "competition_code").collect()}
    assert counts == {"PL": 2, "SA": 1, None: 1}
