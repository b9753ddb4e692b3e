"""Refinement of buckets by levels, against brute force on texts that share passages around few anchors."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest

from layerline.llm.repeats import Bytes, cells_of, levels, parts_emitter, repeated_strings, repeated_words
from tests.llm import brute


def texts_with_edits(seed: int):
    """Copies of one passage with an edit each, cuts of it at every length, runs of one symbol, and a null id."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(1, 4))) for _ in range(400)]
    passage = " ".join(words)
    rows = [(None, passage[:500]), (0, None), (0, passage[:500])]
    for i in range(1, 60):
        at = draw.randrange(len(passage))
        rows.append((i, passage[:at] + draw.choice(["X", "XY ", ""]) + passage[at + draw.randint(0, 3):]))
    rows += [(100 + i, f"{i} " + passage[i : i + 30 + 4 * i]) for i in range(80)]
    rows += [(200 + i, f"z{i}" + "a" * (190 + i) + f"{i}b") for i in range(20)]
    return rows


@pytest.mark.parametrize("length, gram", [(200, 50), (60, 10), (20, 19), (20, 20), (30, 1)])
def test_strings(spark, length, gram):
    rows = texts_with_edits(length)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(tuple(r) for r in repeated_strings(df, length, gram).collect()) == brute.strings(rows, length)


@pytest.mark.parametrize("length", [50, 12, 2])
def test_words(spark, length):
    rows = [(k if k is not None else -1, t) for k, t in texts_with_edits(length)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(tuple(r) for r in repeated_words(df, length).collect()) == brute.words(rows, length)


@pytest.mark.parametrize("width", [1, 4, 16])
def test_parts_cover_each_window_once(width):
    """Parts split the windows of all cells without a gap, and equal windows always fall into one bucket."""
    length, gram, text = 60, 20, "".join(random.Random(2).choice("ab") for _ in range(3000))
    column = pa.array([text + "-" + text[:900]])
    _, start, n, d, *_ = cells_of(Bytes(column), length, gram)
    opened = [[{"region": i, "start": int(s), "at": 0, "n": int(m), "d": int(x), "mark": 1} for i, (s, m, x) in enumerate(zip(start, n, d))]]
    fields = [(k, pa.int32() if k in ("start", "at", "n", "d") else pa.int64()) for k in ("region", "start", "at", "n", "d", "mark")]
    batch = pa.RecordBatch.from_arrays([column, pa.array(opened, pa.list_(pa.struct(fields)))], names=["text", "opened"])
    parts = [row for out in parts_emitter(Bytes, length, width)(iter([batch])) for row in out.to_pylist()]
    whole, bucket = column[0].as_py(), {}
    for p in parts:
        assert 0 < p["n"] <= width
        for i in range(p["n"]):
            at = int(start[p["region"]]) + p["at"] + i
            assert at not in bucket
            bucket[at] = (p["w1"], p["w2"])
    assert sorted(bucket) == [at for s, m in zip(start, n) for at in range(s, s + m)]
    seen: dict = {}
    for at, key in bucket.items():
        assert seen.setdefault(whole[at : at + length], key) == key


def test_levels():
    assert levels(200, 50) == [16, 1] and levels(50, 25) == [2, 1] and levels(20, 20) == [1]
