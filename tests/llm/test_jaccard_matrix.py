"""The token-group matrix against brute force where its bounds are tight."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from layerline.llm import jaccard
from layerline.llm.jaccard import jaccard_classes, one_of_each
from layerline.llm.shipping import ship
from tests.llm import brute


def documents(spark, rows):
    ship(spark)
    return spark.createDataFrame([(k, t, "x", "y", "z") for k, t in rows], "doc_id long, text string, node string, token string, label string")


def got(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("unique", [10, 24, 45])
def test_a_passage_that_most_of_many_texts_consist_of(spark, unique):
    """Texts just below, about and above the threshold to each other, all by one long passage."""
    draw = random.Random(unique)
    prose = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = prose(180)
    rows = [(i, f"{passage} {prose(unique + draw.randint(0, 6))}") for i in range(60)]
    rows += [(i, f"{prose(draw.randint(5, 60))} {passage}") for i in range(60, 100)]
    rows += [(i, prose(200)) for i in range(100, 120)]
    assert got(jaccard_classes(documents(spark, rows))) == brute.classes(rows)


def test_chains_of_near_copies_and_sizes_at_the_edge(spark):
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    rows = [(1000 - i, " ".join(words[6 * i: 6 * i + 150])) for i in range(40)]
    rows += [(i, " ".join(words[:n])) for i, n in enumerate((100, 104, 108, 114, 120, 129, 130, 145, 180, 181, 182), 1)]
    rows += [(-5, rows[3][1]), (7, rows[5][1]), (7, rows[5][1]), (7, rows[5][1]), (20, "One two THREE four"), (21, "one two three four"), (22, "one two three")]
    assert got(jaccard_classes(documents(spark, rows))) == brute.classes(rows)
    kept = Counter((r.doc_id, r.text) for r in one_of_each(documents(spark, rows)).collect())
    # One row of each component stays; rows equal in id and text stay together.
    assert len(kept) == len({c for _, _, c in brute.classes(rows)})


def rows_of(monkeypatch, labels):
    """How many rows are stored under each of the labels."""
    found, plain = {}, jaccard.stored

    def counting(df, label):
        out = plain(df, label)
        if label in labels:
            found[label] = out.count()
        return out

    monkeypatch.setattr(jaccard, "stored", counting)
    return found


def test_a_passage_that_is_rare_in_each_task_is_frequent(spark, monkeypatch):
    """The order of rarity comes from all tasks: a passage of a quarter of each text stays out of the prefixes."""
    draw = random.Random(4)
    prose = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    passage = prose(40)
    rows = [(i, f"{prose(60)} {passage} {prose(60)}") for i in range(240)]
    found = rows_of(monkeypatch, ["shared_tokens"])
    assert got(jaccard_classes(documents(spark, rows).repartition(60))) == brute.classes(rows)
    assert found["shared_tokens"] == 0


def test_near_copies_below_the_threshold_are_told_by_their_marks(spark, monkeypatch):
    draw = random.Random(5)
    base = ["".join(draw.choice("abcdefgh") for _ in range(7)) for _ in range(170)]
    rows = []
    for i in range(200):
        words = list(base)
        for place in draw.sample(range(170), 5):
            words[place] = f"x{i}y{place}"
        rows.append((i, " ".join(words)))
    found = rows_of(monkeypatch, ["opened", "close"])
    assert got(jaccard_classes(documents(spark, rows))) == brute.classes(rows)
    # Of 19900 pairs.
    assert found["opened"] < 4000 and found["close"] < 2000


def test_classes_merge_before_they_are_opened_for_all_tokens(spark, monkeypatch):
    """Near copies, of which a part links: most pairs of members are in one class before they are listed."""
    draw = random.Random(8)
    base = ["".join(draw.choice("abcdefgh") for _ in range(7)) for _ in range(170)]
    rows = []
    for i in range(300):
        words = list(base)
        for place in draw.sample(range(170), draw.choice((2, 3, 3, 4))):
            words[place] = f"x{i}y{place}"
        rows.append((i, " ".join(words)))
    sizes, plain = {}, jaccard.stored

    def counting(df, label):
        out = plain(df, label)
        sizes.setdefault(label, []).append(out)
        return out

    monkeypatch.setattr(jaccard, "stored", counting)
    monkeypatch.setattr(jaccard, "discard", lambda *tables: None)
    assert got(jaccard_classes(documents(spark, rows))) == brute.classes(rows)
    assert sum(t.count() for t in sizes["opened"]) < 12_000
    # The tokens are shuffled in parts of about the same size.
    parts = [t.count() for t in sizes["shared_tokens"]]
    assert len(parts) == jaccard.PARTS and max(parts) < 0.7 * sum(parts)


def test_texts_are_moved_in_parts(spark, monkeypatch):
    """Where most texts are compared, each part of them is moved alone."""
    draw = random.Random(9)
    prose = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    rows = []
    for i in range(0, 120, 2):
        text = prose(100)
        rows += [(i, text), (i + 1, text + " more")]
    rows += [(3, rows[3][1]), (3, rows[3][1])]
    found = rows_of(monkeypatch, ["texts_groups"])
    monkeypatch.setattr(jaccard, "FEW", 8)
    assert got(jaccard_classes(documents(spark, rows))) == brute.classes(rows)
    assert found["texts_groups"] >= 60


@pytest.mark.parametrize("percent", [50, 95, 100])
def test_other_thresholds(spark, percent):
    draw = random.Random(percent)
    base = [f"w{draw.randint(0, 500)}" for _ in range(150)]
    rows = []
    for i in range(50):
        w = list(base)
        for _ in range(draw.randint(0, 12)):
            w[draw.randrange(len(w))] = f"x{draw.randint(0, 40)}"
        rows.append((i, " ".join(w)))
    assert got(jaccard_classes(documents(spark, rows), percent=percent)) == brute.classes(rows, percent=percent)


def test_mixing_reaches_or_tells(spark):
    """Totals against a plain projected gradient over the same posteriors; a target out of reach is told."""
    import numpy as np

    from layerline.llm.mixing import TOLERANCE, labelled_domains, mix_to_targets

    draw = random.Random(2)
    good, poor = [f"alpha{i}" for i in range(30)], [f"omega{i}" for i in range(30)]
    text = lambda share, n: " ".join(draw.choice(good if draw.random() < share else poor) for _ in range(n))
    rows = [(i, text(draw.random(), draw.randint(1, 80))) for i in range(300)] + [(400, None), (401, "")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(0, 60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    train = documents(spark, [(i, text(0.97 if i % 2 == 0 else 0.03, 40)) for i in range(60)])
    labelled = labelled_domains(train, labels)
    assert labelled.count() == 60 and labelled_domains(train, labels, 20).count() < 60
    for goal in (0.5, 0.8, 0.15):
        out = mix_to_targets(docs, labelled, {"good": goal, "poor": 1 - goal}).collect()
        p = np.array([r.posterior for r in out]) * np.array([[r.n_tokens] for r in out])
        rate = np.array([r.rate for r in out])
        totals, whole = rate @ p, p.sum()
        assert out[0].reached and out[0].miss <= TOLERANCE and min(rate) >= 0
        assert abs(totals[0] / whole - goal) < 2 * TOLERANCE and abs(totals.sum() / whole - 1) < 4 * TOLERANCE
        # The nearest nonnegative rates meet the targets too: no better totals are to be had.
        plain = np.ones(len(out))
        for _ in range(3000):
            plain = np.maximum(0, plain - 0.5 * (p / p.sum(0)) @ ((plain @ p - whole * np.array([goal, 1 - goal])) / p.sum(0)))
        assert np.abs(plain @ p / whole - totals / whole).max() < 5 * TOLERANCE
    mixed_only = documents(spark, [(i, text(0.5, 200)) for i in range(40)])
    out = mix_to_targets(mixed_only, labelled, {"good": 1.0, "poor": 0.0}).collect()
    assert not out[0].reached and out[0].miss > TOLERANCE
