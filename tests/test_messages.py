from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from layerline.operators import messages as msg
from layerline.schemas import EVENT, MESSAGE_META

# value, expected event_id, expected match_id, expected reason
CASES = [
    ('{"event_id":"a","match_id":1}', "a", 1, None),
    ('{"event_id":"a","match_id":1,"extra":2}', "a", 1, None),
    ('{"event_id":5,"match_id":1}', "5", 1, None),
    ("not json", None, None, msg.MALFORMED),
    ('{"event_id":"a","match_id":1', None, None, msg.MALFORMED),
    (None, None, None, msg.EMPTY),
    ("", None, None, msg.EMPTY),
    (" \n\t", None, None, msg.EMPTY),
    ("{}", None, None, msg.MISSING),
    ('{"match_id":1}', None, 1, msg.MISSING),
    ('{"event_id":"a","match_id":null}', "a", None, msg.MISSING),
    ('[{"match_id":1},{"match_id":2}]', None, None, msg.NOT_OBJECT),
    ("5", None, None, msg.NOT_OBJECT),
    ('"text"', None, None, msg.NOT_OBJECT),
    ("null", None, None, msg.NOT_OBJECT),
    ('{"event_id":"a","match_id":1.5}', "a", None, msg.WRONG_TYPE),
    ('{"event_id":"a","match_id":"7"}', "a", None, msg.WRONG_TYPE),
    ('{"event_id":"a","match_id":9999999999}', "a", None, msg.WRONG_TYPE),
    ('\n {"event_id":"a","match_id":"7"}', "a", None, msg.WRONG_TYPE),
    ('{"event_id":"a","match_id":1,"matchday":"x"}', "a", 1, msg.WRONG_TYPE),
]


def as_messages(spark, values):
    rows = [(i, value) for i, value in enumerate(values)]
    return spark.createDataFrame(rows, "offset long, text string").select(
        F.lit("k").cast("binary").alias("key"),
        F.col("text").cast("binary").alias("value"),
        F.lit(0).alias("partition"),
        "offset",
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("timestamp"),
    )


@pytest.fixture(scope="module")
def decoded(spark):
    return msg.decode(as_messages(spark, [case[0] for case in CASES]))


def test_decode_cases(decoded):
    rows = {row.kafka_offset: row for row in decoded.collect()}
    assert len(rows) == len(CASES)
    for offset, (value, event_id, match_id, reason) in enumerate(CASES):
        row = rows[offset]
        assert (row.event_id, row.match_id, row.error_reason) == (event_id, match_id, reason), value
        assert row.raw_value == (value if reason else None)


def test_decode_columns(decoded):
    assert decoded.columns == [*EVENT.names, *MESSAGE_META.names, "error_reason", "raw_value"]


def test_valid_and_rejects_split_all_rows(decoded):
    good = {row.kafka_offset for row in msg.valid(decoded).collect()}
    bad = {row.kafka_offset for row in msg.rejects(decoded).collect()}
    assert good == {i for i, case in enumerate(CASES) if case[1] is not None and case[2] is not None}
    assert good | bad == set(range(len(CASES))) and not good & bad


def test_wrong_type_in_an_optional_field_keeps_the_row(decoded):
    row = msg.valid(decoded).where("error_reason = 'wrong_type'").collect()
    assert [(r.match_id, r.matchday) for r in row] == [(1, None)]


def test_delivery_counts(decoded):
    counts = {row.outcome: row.n for row in msg.delivery_counts(decoded).collect()}
    assert counts == {"ok": 4, msg.MALFORMED: 2, msg.EMPTY: 3, msg.MISSING: 3, msg.NOT_OBJECT: 4, msg.WRONG_TYPE: 4}


def test_dead_letters_hold_text_and_reason(decoded):
    letters = [(row.key, json.loads(row.value)) for row in msg.dead_letters(msg.rejects(decoded)).collect()]
    assert len(letters) == 16
    assert {key for key, _ in letters} == {"k"}
    assert {"original_event": "not json", "error_reason": msg.MALFORMED} in [body for _, body in letters]
    assert {"original_event": None, "error_reason": msg.EMPTY} in [body for _, body in letters]


def test_decode_takes_any_schema(spark):
    from layerline.schemas import struct_of

    schema = struct_of({"id": "long", "place": {"x": "double"}})
    sent = as_messages(spark, ['{"id":1,"place":{"x":1.5}}', '{"place":{"x":2}}', '{"id":3,"place":{"x":"far"}}'])
    decoded = msg.decode(sent, schema, required=["id"])
    rows = [(r.id, r.place and r.place.x, r.error_reason) for r in decoded.orderBy("kafka_offset").collect()]
    assert rows == [(1, 1.5, None), (None, 2.0, msg.MISSING), (3, None, msg.WRONG_TYPE)]
    assert [r.kafka_offset for r in msg.rejects(decoded, ["id"]).collect()] == [1]


def test_each_message_is_parsed_once(decoded):
    for frame in (msg.valid(decoded), msg.rejects(decoded), msg.delivery_counts(decoded)):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_encode_keeps_nulls_and_defaults_the_key(spark):
    df = spark.createDataFrame([(1, "x"), (None, None)], "match_id int, status string")
    rows = msg.encode(df).collect()
    assert [(r.key, json.loads(r.value)) for r in rows] == [
        ("1", {"match_id": 1, "status": "x"}),
        ("unknown", {"match_id": None, "status": None}),
    ]


def test_encode_then_decode_gives_the_rows_back(spark):
    from layerline.workload.tables import bronze_events, messages

    bronze = bronze_events(spark, "/root/testdata/sf0.001")
    sent = bronze.select(*EVENT.names, *MESSAGE_META.names)
    back = msg.decode(messages(bronze)).select(*sent.columns)
    assert sent.exceptAll(back).count() == 0 == back.exceptAll(sent).count()


def test_unicode_and_escapes_survive(spark):
    df = spark.createDataFrame([("1-a", 1, 'Łódź "A"\\\n')], "event_id string, match_id int, home_team_name string")
    sent = msg.encode(df).select(
        F.col("key").cast("binary"), F.col("value").cast("binary"), F.lit(0).alias("partition"),
        F.lit(1).cast("long").alias("offset"), F.current_timestamp().alias("timestamp"),
    )
    assert msg.decode(sent).first().home_team_name == 'Łódź "A"\\\n'
