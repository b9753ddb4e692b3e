from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from layerline import jobs
from layerline.operators.messages import rejects
from layerline.plans.silver import to_silver
from layerline.schemas import BRONZE, FACT_COLUMNS
from layerline.sources.files import read_table
from layerline.streaming.bronze import bronze_rows
from layerline.workload.tables import bronze_events, damaged, messages


@pytest.fixture(scope="module")
def bronze(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("jobs") / "bronze")
    bronze_events(spark, "/root/testdata/sf0.001").write.partitionBy("ingestion_date").parquet(path)
    return path


def expected_teams(spark, bronze):
    rows = to_silver(read_table(spark, bronze, BRONZE)).collect()
    home = {(r.home_team_id, r.home_team_name) for r in rows if r.home_team_id is not None}
    return len(home | {(r.away_team_id, r.away_team_name) for r in rows})


def test_silver_gold_and_check(spark, bronze, tmp_path, capsys):
    silver = str(tmp_path / "silver")
    assert jobs.main(["silver", "--bronze", bronze, "--silver", silver]) == 0
    assert jobs.main(["gold", "--silver", silver, "--schema", "jobs_test", "--path", str(tmp_path / "gold")]) == 0
    assert spark.table("jobs_test.fct_match_events").columns == list(FACT_COLUMNS)
    assert spark.table("jobs_test.dim_teams").count() == expected_teams(spark, bronze)
    assert jobs.main(["check", "--silver", silver]) == 1
    printed = capsys.readouterr().out
    assert "unique_event_id ok" in printed
    assert "accepted_values_status 1 failures" in printed


def test_gold_can_be_built_again(spark, bronze, tmp_path):
    silver = str(tmp_path / "silver")
    jobs.main(["silver", "--bronze", bronze, "--silver", silver])
    for _ in range(2):
        args = ["gold", "--silver", silver, "--schema", "jobs_again", "--path", str(tmp_path / "gold")]
        assert jobs.main(args) == 0
    assert spark.table("jobs_again.dim_teams").count() == expected_teams(spark, bronze)


def test_rejects_of_a_date_range_are_published(spark, tmp_path, monkeypatch):
    sent = damaged(messages(bronze_events(spark, "/root/testdata/sf0.001")))
    landed = bronze_rows(sent, keep_rejects=True).withColumn("ingestion_date", F.col("kafka_timestamp").cast("date"))
    landed.write.partitionBy("ingestion_date").parquet(str(tmp_path / "bronze"))
    published = []
    monkeypatch.setattr(jobs.kafka, "publish", lambda letters, *target: published.append((letters, target)))
    args = ["publish-rejects", "--bronze", str(tmp_path / "bronze"), "--servers", "h", "--topic", "broken"]
    assert jobs.main(args) == jobs.main([*args, "--start", "2024-01-05", "--end", "2024-01-09"]) == 0
    (all_letters, target), (some_letters, _) = published
    assert target == ("h", "broken") and all_letters.columns == ["key", "value"]
    expected = rejects(landed)
    assert all_letters.count() == expected.count() > 0
    days = expected.where("ingestion_date BETWEEN DATE'2024-01-05' AND DATE'2024-01-09'")
    assert some_letters.count() == days.count() > 0


@pytest.mark.parametrize("extra_rows, code, loads", [([0], 0, 1), ([5, 0], 0, 2), ([5, 5, 5], 1, 3)])
def test_load_is_repeated_until_the_counts_agree(spark, bronze, tmp_path, monkeypatch, extra_rows, code, loads):
    silver = str(tmp_path / "silver")
    jobs.main(["silver", "--bronze", bronze, "--silver", silver])
    rows = spark.read.parquet(silver).count()
    written, counts = [], iter(extra_rows)
    monkeypatch.setattr(jobs.jdbc, "write_jdbc", lambda df, *args, **options: written.append((args, options)))
    monkeypatch.setattr(
        jobs.jdbc, "count_jdbc", lambda *args, **options: spark.createDataFrame([(rows + next(counts),)], "n long")
    )
    assert jobs.main(["load", "--silver", silver, "--url", "jdbc:x"]) == code
    assert written == [(("jdbc:x", "raw.match_events", 16), {})] * loads


def test_arguments():
    parse = jobs.parser().parse_args
    args = parse(["ingest", "--landed", "in", "--servers", "h", "--topic", "t", "--checkpoint", "c"])
    assert (args.competitions, args.status) == (["PL", "CL", "BL1"], "SCHEDULED")
    args = parse(["bronze", "--servers", "h", "--topic", "t", "--bronze", "b", "--checkpoint", "c", "--once"])
    assert (args.seconds, args.once, args.keep_rejects) == (30, True, False)
    args = parse(["load", "--silver", "s", "--url", "jdbc:x", "--writers", "4"])
    assert (args.table, args.writers, args.driver) == ("raw.match_events", 4, None)
    with pytest.raises(SystemExit):
        parse(["silver"])


def as_topic(spark, monkeypatch, folder, seen=None):
    """Files stand in for the topic; options that only a broker takes are noted."""
    from layerline.schemas import MESSAGE

    def stream(session, servers, topic, **options):
        if seen is not None:
            seen.update(options)
        return session.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(folder)

    monkeypatch.setattr(jobs.kafka, "stream_topic", stream)


def test_bronze_letters_compaction_and_silver(spark, tmp_path, monkeypatch, capsys):
    sent = damaged(messages(bronze_events(spark, "/root/testdata/sf0.001")))
    root, seen, published = str(tmp_path), {}, []
    as_topic(spark, monkeypatch, f"{root}/topic", seen)
    monkeypatch.setattr(jobs.kafka, "publish", lambda rows, *target, **options: published.append((rows.collect(), target, options)))
    land = ["bronze", "--servers", "h", "--topic", "t", "--bronze", f"{root}/bronze", "--checkpoint", f"{root}/log", "--once",
            "--max-offsets", "1000", "--min-partitions", "64", "--counters", f"{root}/counts",
            "--option", "kafka.security.protocol=SASL_SSL", "failOnDataLoss=true"]
    letters = ["publish-letters", "--letters", f"{root}/bronze_letters", "--servers", "h", "--topic", "d", "--checkpoint", f"{root}/sent",
               "--once", "--option", "acks=all"]
    merge = ["silver", "--bronze", f"{root}/bronze", "--silver", f"{root}/silver", "--checkpoint", f"{root}/merged", "--once",
             "--max-files", "2"]
    expected = 0
    for part in (0, 1):
        sent.where(F.col("offset") % 2 == part).coalesce(1).write.mode("append").parquet(f"{root}/topic")
        assert jobs.main(land) == jobs.main(letters) == jobs.main(merge) == 0
        expected += rejects(bronze_rows(sent.where(F.col("offset") % 2 == part))).count()
        assert sum(len(rows) for rows, _, _ in published) == expected > 0
    assert seen == {"maxOffsetsPerTrigger": "1000", "minPartitions": "64", "kafka.security.protocol": "SASL_SSL", "failOnDataLoss": "true"}
    assert {target for _, target, _ in published} == {("h", "d")} and published[0][2] == {"acks": "all"}
    assert jobs.main(letters) == 0 and sum(len(rows) for rows, _, _ in published) == expected
    assert jobs.main(["publish-rejects", "--bronze", f"{root}/bronze", "--servers", "h", "--topic", "all"]) == 0
    assert len(published[-1][0]) == expected
    assert jobs.main(["compact", "--bronze", f"{root}/bronze"]) == 0

    whole = to_silver(bronze_rows(sent)).count()
    assert jobs.main(["check", "--silver", f"{root}/silver"]) == 1
    assert "unique_team_id 1 failures in 2 rows" in capsys.readouterr().out
    assert jobs.snapshots.read_snapshot(spark, f"{root}/silver", jobs.SILVER).count() == whole
    assert jobs.main(["silver", "--bronze", f"{root}/bronze", "--silver", f"{root}/whole"]) == 0
    assert jobs.snapshots.read_snapshot(spark, f"{root}/whole", jobs.SILVER).count() == whole
    for extra in ([], ["--buckets", "4"]):
        assert jobs.main(["gold", "--silver", f"{root}/silver", "--schema", "jobs_gold", "--path", f"{root}/gold", *extra]) == 0
        assert spark.table("jobs_gold.fct_match_events").columns == list(FACT_COLUMNS)
        assert spark.table("jobs_gold.fct_match_events").count() >= whole


def test_ingest_publishes_matches_and_sets_the_rest_aside(spark, tmp_path, monkeypatch):
    root, published = tmp_path, []
    monkeypatch.setattr(jobs.kafka, "publish", lambda rows, *target, **options: published.extend(rows.collect()))
    (root / "landed").mkdir()
    match = '{"id":%d,"status":"%s","competition":{"code":"%s"}}'
    (root / "landed" / "a.json").write_text('{"matches":[' + match % (1, "SCHEDULED", "PL") + "," + match % (2, "LIVE", "PL") + "]}\n<html>\n")
    (root / "landed" / "b.json").write_text('{"matches":[' + match % (3, "SCHEDULED", "CL") + "," + match % (4, "SCHEDULED", "SA") + ',{}]}\n')
    ingest = ["ingest", "--landed", f"{root}/landed", "--servers", "h", "--topic", "t", "--checkpoint", f"{root}/log", "--once",
              "--max-files", "1", "--archive", f"{root}/archive"]
    for _ in range(2):
        assert jobs.main(ingest) == 0
    assert sorted(row.key for row in published) == ["1", "3"]
    letters = spark.read.parquet(f"{root}/log_letters")
    reasons = [r[0] for r in letters.select(F.get_json_object("value", "$.error_reason")).collect()]
    assert sorted(reasons) == ["malformed_json", "missing_required"]
