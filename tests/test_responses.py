"""Landed responses: what is readable, what is set aside, and that nothing is lost between the two."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from layerline.operators import messages as msg, responses
from layerline.operators.matches import normalize_matches
from layerline.sources.files import read_landed, stream_landed
from layerline.streaming.batches import folder_sink, start_batches

# A landed line, its reason as a whole, the ids of its documents, the places of documents without an id.
CASES = [
    ('{"matches":[{"id":1,"status":"A"},{"id":2}]}', None, [1, 2], []),
    ('  {"matches":[{"id":3}]}  ', None, [3], []),
    ("{}", None, [], []),
    ('{"matches":null}', None, [], []),
    ('{"matches":[]}', None, [], []),
    ('{"message":"limit","errorCode":429}', None, [], []),
    ('{"matches":[{"id":"x","status":"A"},{"id":4}]}', None, [4], [0]),
    ('{"matches":[null,{"id":5}]}', None, [5], [0]),
    ('{"matches":[{"id":6,"matchday":"first"}]}', None, [6], []),
    ('{"matches":[{"status":"A"}]}', None, [], [0]),
    ('{"matches":[{"id":7,"sta', msg.MALFORMED, [], []),
    ("<html><body>Too Many Requests</body></html>", msg.MALFORMED, [], []),
    ('{"matches":"none"}', msg.WRONG_TYPE, [], []),
    ('{"matches":{"id":8}}', msg.WRONG_TYPE, [], []),
    ('{"matches":[5,{"id":9}]}', msg.WRONG_TYPE, [], []),
    ('[{"matches":[]}]', msg.NOT_OBJECT, [], []),
    ("5", msg.NOT_OBJECT, [], []),
    ("null", msg.NOT_OBJECT, [], []),
]
BLANK = ["", "   ", "\t"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("landed")
    (root / "lines").mkdir(), (root / "files").mkdir()
    for i, half in enumerate((CASES[::2], CASES[1::2])):
        (root / "lines" / f"{i}.json").write_text("\n".join([case[0] for case in half] + BLANK) + "\n")
    (root / "lines" / "empty.json").write_text("")
    pretty = json.dumps({"matches": [{"id": 1, "status": "A"}, {"status": "B"}]}, indent=2)
    for name, text in (("whole", pretty), ("cut", pretty[:-3]), ("html", "<html>\n\n</html>"), ("line", '{"matches":[{"id":2}]}'), ("blank", "\n \n")):
        (root / "files" / f"{name}.json").write_text(text)
    return root


def test_lines(spark, folder):
    decoded = responses.decode_responses(read_landed(spark, str(folder / "lines")))
    found = {row.raw_value: row for row in decoded.collect()}
    assert set(found) == {case[0] for case in CASES}
    unfolded = responses.unfold_responses(decoded)
    documents = unfolded.where("error_reason IS NULL").select("document.id").collect()
    assert sorted(row.id for row in documents) == sorted(i for case in CASES for i in case[2])
    for text, reason, _, _ in CASES:
        assert found[text].error_reason == reason, text
    rejected = responses.document_rejects(unfolded).collect()
    whole = [(r.raw_value, r.error_reason) for r in rejected if r.position is None]
    assert sorted(whole) == sorted((case[0], case[1]) for case in CASES if case[1])
    single = [r for r in rejected if r.position is not None]
    assert len(single) == sum(len(case[3]) for case in CASES) and {r.error_reason for r in single} == {msg.MISSING}
    assert sorted(r.raw_value for r in single) == ["null", '{"status":"A"}', '{"status":"A"}']
    assert {r.source_file.rsplit("/", 1)[1] for r in rejected} == {"0.json", "1.json"}


def test_responses_are_readable_or_rejected(spark, folder):
    for name, whole in (("lines", False), ("files", True)):
        decoded = responses.decode_responses(read_landed(spark, str(folder / name), whole))
        counts = {row.outcome: (row.responses, row.documents) for row in responses.response_counts(decoded).collect()}
        rejected = responses.document_rejects(responses.unfold_responses(decoded)).where("position IS NULL")
        assert sum(n for n, _ in counts.values()) == decoded.count()
        assert sum(n for outcome, (n, _) in counts.items() if outcome != "ok") == rejected.count()
        assert all(documents == 0 for outcome, (_, documents) in counts.items() if outcome != "ok")


def test_whole_files(spark, folder):
    decoded = responses.decode_responses(read_landed(spark, str(folder / "files"), whole_files=True))
    found = {row.source_file.rsplit("/", 1)[1]: row.error_reason for row in decoded.collect()}
    assert found == {"whole.json": None, "cut.json": msg.MALFORMED, "html.json": msg.MALFORMED, "line.json": None}
    unfolded = responses.unfold_responses(decoded)
    assert sorted(r.match_id for r in normalize_matches(responses.good_documents(unfolded)).collect()) == [1, 2]
    # Read by lines, a response over several lines is set aside in pieces and not taken for one without documents.
    lines = responses.decode_responses(read_landed(spark, str(folder / "files")).where("source_file LIKE '%whole.json'"))
    assert lines.where("error_reason IS NULL").where("size(matches) > 0").count() == 0
    assert lines.where("error_reason IS NOT NULL").count() > 0


def test_text_is_parsed_once(spark, folder):
    unfolded = responses.unfold_responses(responses.decode_responses(read_landed(spark, str(folder / "lines"))))
    for frame in (responses.good_documents(unfolded), responses.document_rejects(unfolded)):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_stream_gives_the_same_rows(spark, folder, tmp_path):
    batch = responses.unfold_responses(responses.decode_responses(read_landed(spark, str(folder / "lines"))))
    stream = stream_landed(spark, str(folder / "lines"), maxFilesPerTrigger="1")
    unfolded = responses.unfold_responses(responses.decode_responses(stream))
    sinks = [
        folder_sink(str(tmp_path / "events"), prepare=lambda rows: normalize_matches(responses.good_documents(rows))),
        folder_sink(str(tmp_path / "letters"), prepare=lambda rows: responses.reject_letters(responses.document_rejects(rows))),
    ]
    start_batches(unfolded, sinks, str(tmp_path / "log")).awaitTermination()
    events = spark.read.parquet(str(tmp_path / "events"))
    assert events.select("batch_id").distinct().count() == 2
    assert sorted(r.match_id for r in events.collect()) == sorted(i for case in CASES for i in case[2])
    letters = spark.read.parquet(str(tmp_path / "letters"))
    expected = responses.reject_letters(responses.document_rejects(batch))
    assert letters.where("key IS NOT NULL").count() == 0
    assert sorted(r.value for r in letters.collect()) == sorted(r.value for r in expected.collect())
    body = json.loads(letters.where(F.col("value").contains("html")).first().value)
    assert body["original_event"].startswith("<html>") and body["source_file"].endswith("1.json") and body["position"] is None


def test_envelope_fields_are_carried(spark):
    from layerline.schemas import RESPONSE

    schema = type(RESPONSE)([*RESPONSE.fields]).add("sequence", "long")
    landed = spark.createDataFrame([('{"sequence":4,"matches":[{"id":1},{}]}', "f")], "value string, source_file string")
    unfolded = responses.unfold_responses(responses.decode_responses(landed, schema, keep=["sequence"]), keep=["sequence"])
    assert [(r.sequence, r.position) for r in responses.document_rejects(unfolded, ["sequence"]).collect()] == [(4, 1)]
    assert [(r.sequence, r.id) for r in responses.good_documents(unfolded, ["sequence"]).collect()] == [(4, 1)]
