from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from layerline.operators import quality
from layerline.plans.gold import DIMENSION_RULES, SILVER_RULES


def test_rules_return_failing_rows(spark):
    df = spark.createDataFrame([("a", "PL"), ("a", None), (None, "XX"), (None, "XX")], "k string, c string")
    assert [tuple(row) for row in quality.unique(df, "k").collect()] == [("a", 2)]
    assert quality.not_null(df, "c").count() == 1
    assert [tuple(row) for row in quality.accepted_values(df, "c", ["PL"]).collect()] == [("XX", 2)]


def test_unknown_kind_is_refused():
    with pytest.raises(ValueError, match="no such kind"):
        quality.Rule("uniq", "k")


def test_declared_rules():
    assert [rule.name for rule in SILVER_RULES] == [
        "unique_event_id", "not_null_event_id", "not_null_match_id", "not_null_competition_code",
        "accepted_values_competition_code", "accepted_values_status",
    ]
    assert [rule.name for rule in DIMENSION_RULES] == ["unique_team_id"]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([1, 2, 3, None]))))
def test_run_checks_against_brute_force(spark, rows):
    rules = [
        quality.Rule("unique", "k"), quality.Rule("not_null", "k"), quality.Rule("not_null", "v"),
        quality.Rule("accepted_values", "k", ("a",)), quality.Rule("accepted_values", "v", (1, 2)),
        quality.Rule("unique", "v"),
    ]
    df = spark.createDataFrame(rows, "k string, v int")
    found = {row.rule: (row.failures, row.rows_affected, row.passed) for row in quality.run_checks(df, rules).collect()}
    keys, values = Counter(k for k, _ in rows), Counter(v for _, v in rows)

    def summary(counts):
        return len(counts), sum(counts), not counts

    def nulls(counter):
        return counter[None], counter[None], not counter[None]

    assert found == {
        "unique_k": summary([n for k, n in keys.items() if k is not None and n > 1]),
        "unique_v": summary([n for v, n in values.items() if v is not None and n > 1]),
        "not_null_k": nulls(keys),
        "not_null_v": nulls(values),
        "accepted_values_k": summary([n for k, n in keys.items() if k not in ("a", None)]),
        "accepted_values_v": summary([n for v, n in values.items() if v not in (1, 2, None)]),
    }
    for rule in rules:
        failing = rule.failing(df).count()
        assert failing == found[rule.name][0]


def test_rules_that_share_a_name_are_refused(spark):
    rules = [quality.Rule("accepted_values", "a", (1,)), quality.Rule("accepted_values", "a", (2,))]
    with pytest.raises(ValueError):
        quality.run_checks(spark.createDataFrame([(1,)], "a int"), rules)


def test_unique_by_hash_gives_the_same(spark):
    from layerline.operators.quality import unique_by_hash

    values = spark.range(0, 3000, 1, 4).select(
        F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("a long common beginning "), (F.col("id") % 2500).cast("string"))).alias("k"), "id")
    plain = {(r.k, r.n) for r in quality.unique(values, "k").collect()}
    assert {(r.k, r.n) for r in unique_by_hash(values, "k").collect()} == plain
    assert ("hot", 980) in plain and len(plain) > 100
    assert unique_by_hash(values.where("id < 2"), "k").count() == 0
    assert unique_by_hash(values.where("k IS NULL"), "k").count() == 0
    rules = [quality.Rule("unique", "k", by_hash=True), quality.Rule("unique", "id", by_hash=True)]
    same = [quality.Rule("unique", "k"), quality.Rule("unique", "id")]
    assert sorted(map(str, quality.run_checks(values, rules).collect())) == sorted(map(str, quality.run_checks(values, same).collect()))


def test_unique_by_hash_shuffles_hashes_and_few_values(spark):
    from layerline.operators.quality import unique_by_hash

    values = spark.range(0, 1000, 1, 4).select(F.concat(F.lit("k"), F.col("id") % 990).alias("k"))
    text = unique_by_hash(values, "k")._jdf.queryExecution().executedPlan().toString()
    # The values are joined where they are read; only those under a repeated hash reach the shuffle.
    assert "BroadcastHashJoin" in text and text.count("Exchange hashpartitioning") == 1
