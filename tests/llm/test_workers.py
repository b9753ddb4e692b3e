"""What Python workers hold, and what is shuffled beside the rows themselves."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from layerline.llm import common, jaccard, pieces
from layerline.llm.shipping import ship
from tests.llm import brute


@pytest.fixture
def worker(monkeypatch):
    monkeypatch.setattr(common, "KEPT", {})
    return common.KEPT


def test_a_worker_keeps_the_state_of_one_step(worker):
    """The pipeline's steps share the workers: the tokenizer of one does not lie in memory beside the next one's sets."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("piece_bpe_32k.model")
    codec = pieces.codec(path)
    assert pieces.codec(path) is codec and len(worker) == 1
    list(jaccard.cell_emitter(5)(iter([])))
    assert not any(value is codec for value in worker.values())
    assert pieces.codec(path) is not codec


def test_texts_come_in_small_batches_and_the_setting_is_put_back(spark, monkeypatch):
    """Rows of long texts are not gathered by their number alone."""
    name, inside, plain = jaccard.BATCH[0], [], jaccard.weights
    monkeypatch.setattr(jaccard, "weights", lambda *given: (inside.append(spark.conf.get(name)), plain(*given))[1])
    before = spark.conf.get(name, None)
    ship(spark)
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, None)], "doc_id long, text string")
    assert {tuple(r) for r in jaccard.jaccard_classes(docs).collect()} == {(1, 2, 1), (2, 0, 2)}
    assert inside == [jaccard.BATCH[1]] and spark.conf.get(name, None) == before


def test_counters_are_sent_packed():
    """A task has far more cells than shingles."""
    draw = random.Random(6)
    texts = [" ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(200)) for _ in range(500)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    sent = pa.Table.from_batches(jaccard.cell_emitter(5)(iter([batch])))
    assert sent.num_rows == jaccard.CELLS // jaccard.TOGETHER
    assert sum(len(x.as_py()) for x in sent.column("counts")) < jaccard.CELLS // 4
    added = pa.Table.from_batches(jaccard.cell_adder(iter(sent.to_batches())))
    steps = np.frombuffer(b"".join(x.as_py() for x in added.column("counts")), "<u2")
    every = np.concatenate(jaccard.shingle_sets(batch.column("text"), 5))
    counts = np.bincount((every % np.uint64(jaccard.CELLS)).astype(np.int64), minlength=jaccard.CELLS)
    assert (steps == (2048 * np.log2(1 + counts)).astype(np.uint16)).all()


def test_rounds_shuffle_the_matrix_without_marks(spark, monkeypatch):
    """Marks are joined to the pairs of a round, and to what is left of the matrix when classes are opened."""
    draw = random.Random(7)
    base = ["".join(draw.choice("abcdefgh") for _ in range(7)) for _ in range(120)]
    rows = []
    for i in range(24):
        words = list(base)
        for place in draw.sample(range(120), draw.choice((2, 3))):
            words[place] = f"x{i}y{place}"
        rows.append((i, " ".join(words)))
    columns, plain = [], jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, label: (columns.append(df.columns) if label == "matrix" else None, plain(df, label))[1])
    ship(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in jaccard.jaccard_classes(docs).collect()) == brute.classes(rows)
    assert columns[0] == ["token", "node", "n", "bound", "label"]
