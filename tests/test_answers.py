"""Every registered query against its SQL answer."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_point
from layerline.workload.answers import ANSWERS
from layerline.workload.queries import QUERIES
from tests.compare import answer_rows, connect, spark_rows

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_an_answer():
    assert set(QUERIES) == set(ANSWERS)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry_returns_rows(spark):
    assert entry_point.entry(spark).take(1)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_answer(spark, con, name):
    expected_names, expected = answer_rows(con, entry_point.oracle_sql()[name])
    names, found = spark_rows(entry_point.queries()[name](spark, SF_DIR))
    assert names == expected_names
    assert found.total() == expected.total() > 0
    assert found - expected == expected - found
