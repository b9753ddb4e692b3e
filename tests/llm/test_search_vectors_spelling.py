"""Ranked search, linked vectors and spelling variants against plain computations."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from layerline.llm.graph import components
from layerline.llm.lexical import lexical_search, term_lists
from layerline.llm.queries import LLM_ANSWERS, LLM_QUERIES
from layerline.llm.shipping import ship
from layerline.llm.spelling import LEADING, one_apart, runs, spelling_variants
from layerline.llm.vectors import linked_vectors
from tests.compare import answer_rows, spark_rows

duckdb = pytest.importorskip("duckdb")
DOCS = "doc_id long, text string, lang string, n string, terms string, block string, word string, low string, size string"


def documents(spark, rows):
    ship(spark)
    return spark.createDataFrame([(k, t, "en", "x", "y", "z", "w", "l", "s") for k, t in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_lexical", "op12_vectors"])
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_sql_answers(spark, name, folder):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    assert spark_rows(LLM_QUERIES[name](spark, folder)) == answer_rows(con, LLM_ANSWERS[name])


# Ranked search


def plain_terms(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small)


def plain_search(docs, items, k):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total, found = len(held), sum(n for _, _, n in held), Counter()
    for item, text in dict.fromkeys(items):
        scored = []
        terms = set(plain_terms(text))
        weight = {}
        for t in terms:
            df = sum(t in c for _, c, _ in held)
            weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        for i, c, n in held:
            m = 10 + 90 * n * n_docs // total
            score = sum(weight[t] * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, -math.inf if i is None else i))
        for rank, (score, i) in enumerate(sorted(scored)[:k], 1):
            found[item, rank, None if i == -math.inf else i, -score] += 1
    return found


@pytest.fixture(scope="module")
def search_rows():
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcXYZ09é漢ß") for _ in range(draw.randint(1, 4))) for _ in range(120)]
    joined = lambda n: "".join(draw.choice(vocabulary) + draw.choice(" \t\n.-_\x00\x7f~") for _ in range(n))
    docs = [(1, None), (2, ""), (3, " .-_\x00"), (None, joined(30)), (None, joined(3)), (5, joined(20000))]
    docs += [(i, joined(draw.randint(1, 60))) for i in range(10, 260)]
    tie = joined(25)
    docs += [(i, tie) for i in range(300, 340)] + [(301, tie), (400, "A" * 5000), (401, "aX" * 4000)]
    items = [(1, None), (2, ""), (3, tie), (3, tie), (3, vocabulary[0]), (None, joined(9)), (4, "no such term here"), (5, "a" * 5000)]
    items += [(i, joined(draw.randint(1, 40))) for i in range(10, 40)]
    return docs, items


def test_search(spark, search_rows):
    docs, items = search_rows
    asked = spark.createDataFrame([(i, t, 7, "x") for i, t in items], "item_id long, text string, doc_id long, rank string")
    expected = plain_search(docs, items, 10)
    assert expected
    for options in ({}, {"item_tile": 3, "term_tile": 5, "doc_tile": 7}, {"block_terms": 40}):
        found = lexical_search(documents(spark, docs).repartition(5), asked, **options)
        assert Counter(tuple(r) for r in found.collect()) == expected
    few = lexical_search(documents(spark, docs), asked, k=1, doc_tile=1)
    assert Counter(tuple(r) for r in few.collect()) == plain_search(docs, items, 1)


def test_search_of_nothing(spark, search_rows):
    docs, items = search_rows
    asked = spark.createDataFrame(items, "item_id long, text string")
    names = ["item_id", "rank", "doc_id", "score"]
    for some, ask in ((documents(spark, []), asked), (documents(spark, docs), asked.limit(0)), (documents(spark, [(1, None)]), asked)):
        found = lexical_search(some, ask)
        assert found.columns == names and found.count() == 0


def test_terms_of_a_long_text_are_not_cut():
    text = " ".join(f"w{i}é" for i in range(5000)).encode()
    assert [t for part in term_lists(text, 100) for t in part] == text.split()
    assert [t for part in term_lists(b"x" * 3000 + b" y", 100) for t in part] == [b"x" * 3000, b"y"]


# Linked vectors


def plain_links(rows, threshold):
    usable = [
        i for i, (_, v) in enumerate(rows)
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    near = defaultdict(set)
    whole = {i: np.array(rows[i][1], np.float64) for i in usable}
    whole = {i: v / np.abs(v).max() for i, v in whole.items()}
    for i in usable:
        for j in usable:
            if i < j and len(whole[i]) == len(whole[j]):
                cosine = whole[i] @ whole[j] / math.sqrt((whole[i] @ whole[i]) * (whole[j] @ whole[j]))
                if cosine >= threshold:
                    near[i].add(j), near[j].add(i)
    smallest, found = {}, Counter()
    least = lambda i: -math.inf if rows[i][0] is None else rows[i][0]
    for i in range(len(rows)):
        if i in smallest:
            continue
        seen, waiting = {i}, [i]
        while waiting:
            for j in near[waiting.pop()] - seen:
                seen.add(j), waiting.append(j)
        low = min(map(least, seen))
        smallest |= dict.fromkeys(seen, low)
    for i, (vec_id, _) in enumerate(rows):
        found[vec_id, len(near[i]), None if smallest[i] == -math.inf else smallest[i], least(i) == smallest[i]] += 1
    return found


@pytest.fixture(scope="module")
def vector_rows():
    draw = np.random.default_rng(4)
    rows, numbers = [], iter(range(10, 10_000))
    for width, centres, spread in ((70, 12, 0.026), (70, 2, 0.02), (20, 6, 0.05), (3, 5, 0.05), (1, 1, 0.0)):
        for _ in range(centres):
            centre = draw.normal(size=width)
            centre /= np.linalg.norm(centre)
            for _ in range(25):
                rows.append((next(numbers), (centre + draw.normal(size=width) * spread * draw.uniform(0.2, 1.6)).tolist()))
    rows += [(next(numbers), draw.normal(size=70).tolist()) for _ in range(150)]
    same = draw.normal(size=70).tolist()
    rows += [(next(numbers), same) for _ in range(60)] + [(next(numbers), [x * 1e3 for x in same]) for _ in range(3)]
    rows += [(5, same), (5, rows[0][1]), (5, draw.normal(size=70).tolist()), (None, rows[30][1]), (None, draw.normal(size=70).tolist())]
    rows += [(1, None), (2, []), (3, [0.0] * 70), (4, [None, 1.0]), (6, [math.nan] * 70), (7, [math.inf, 1.0, 0.0]), (8, [-0.0, 0.0])]
    return rows


def vectors(spark, rows, kind="double"):
    ship(spark)
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, key string, low string")


def test_linked_vectors(spark, vector_rows):
    draw = random.Random(2)
    mixed = draw.sample(vector_rows, len(vector_rows))
    expected = plain_links(vector_rows, 0.95)
    assert sum(n for _, n, _, _ in expected) > 100 and len({c for _, _, c, _ in expected}) > 20
    for options in ({}, {"block_rows": 16, "tile": 7}):
        found = linked_vectors(vectors(spark, mixed), **options)
        assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
        assert Counter(tuple(r) for r in found.collect()) == expected


def test_linked_vectors_of_extreme_length_and_at_the_threshold(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [3.0, 4.0]), (4, [1.0, 0.0]), (5, [0.0, 2.0])]
    assert Counter(tuple(r) for r in linked_vectors(vectors(spark, rows), 0.6).collect()) == plain_links(rows, 0.6)
    single = [(i, np.float32(v).tolist()) for i, v in ((1, [0.1, 0.2]), (2, [0.2, 0.4]), (3, [0.3, -0.1]))]
    assert Counter(tuple(r) for r in linked_vectors(vectors(spark, single, "float")).collect()) == plain_links(single, 0.95)


def test_no_vectors(spark):
    assert linked_vectors(vectors(spark, [])).collect() == []
    assert [tuple(r) for r in linked_vectors(vectors(spark, [(3, None)])).collect()] == [(3, 0, 3, True)]


def test_components(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(i, 500) for i in range(300, 420)]
    zigzag = [(700, 790), (790, 701), (701, 789), (789, 702), (702, 788)]
    both = components(spark.createDataFrame(path + star + zigzag + [(9, 9)], "a long, b long"))
    found = {r.node: r.label for r in both.collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 300 for i in [*range(300, 420), 500]} | dict.fromkeys(
        (700, 790, 701, 789, 702, 788), 700)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Spelling variants


def plain_words(rows, damaged=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damaged == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_variants(rows, damaged=97):
    words = plain_words(rows, damaged)
    letters = set("".join(words))
    near = {}
    for w in words:
        changed = {w[:i] + w[i + 1:] for i in range(len(w))}
        changed |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        changed |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        near[w] = changed & words.keys() - {w}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = top if top is not None and words[top] >= 2 * words[w] else None
    found = Counter()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        found[w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None] += 1
    return found


@pytest.fixture(scope="module")
def spelled_rows():
    draw = random.Random(8)
    letters = "aaeeiostnrmé×ÿq"
    base = ["".join(draw.choice(letters) for _ in range(draw.randint(4, 11))) for _ in range(60)] + ["a" * 90, "ab" * 60]
    words = list(base)
    for w in base * 4:
        at = draw.randrange(len(w))
        words.append(draw.choice([w[:at] + w[at + 1:], w[:at] + draw.choice(letters) + w[at:], w[:at] + draw.choice(letters) + w[at + 1:]]))
    words = [w.upper() if draw.random() < 0.05 and w.isascii() else w for w in words]
    weights = [draw.paretovariate(1) for _ in words]
    text = lambda n: "".join(w + draw.choice(" \n.9_-漢ś") for w in draw.choices(words, weights, k=n))
    rows = [(1, None), (2, ""), (3, " .9"), (None, text(50)), (None, text(40)), (4, text(9000))]
    rows += [(i, text(draw.randint(1, 80))) for i in range(10, 130)]
    return rows + [rows[-1]] * 5


def test_spelling(spark, spelled_rows):
    expected = plain_variants(spelled_rows)
    assert sum(1 for _, form, root, *_ in expected if form and root != form) > 3
    for options in ({}, {"part_words": 3, "batch_words": 2}):
        found = spelling_variants(documents(spark, spelled_rows).repartition(4), **options)
        assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert Counter(tuple(r) for r in found.collect()) == expected


def test_spelling_of_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    found = LLM_QUERIES["op13_spelling"](spark, "/root/testdata/sf0.001")
    assert Counter(tuple(r) for r in found.collect()) == expected


def test_spelling_of_nothing(spark):
    assert spelling_variants(documents(spark, [])).count() == 0
    assert spelling_variants(documents(spark, [(1, "one two"), (2, None)])).count() == 0


def test_one_apart():
    draw = random.Random(1)
    for _ in range(20_000):
        a = bytes(draw.choice(b"ab") for _ in range(draw.choice((0, 1, 2, 3, 4, 60, 61))))
        b = bytearray(a)
        for _ in range(draw.randint(0, 2)):
            at = draw.randrange(len(b) + 1)
            kind = draw.randrange(3)
            b[at:at + (kind > 0)] = b"" if kind == 1 else bytes([draw.choice(b"ab")])
        b = bytes(b)
        expected = (
            len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
            or len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))
            or len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
        )
        assert one_apart(a, b) == expected
    assert LEADING > 0


def test_runs_of_a_long_text_are_not_cut():
    text = " ".join(f"Wörtleinź{i}" for i in range(3000)) + "b" * 5000
    assert [w for part in runs(text, 100) for w in part] == re.findall(rb"[a-z\xc0-\xff]+", text.encode("latin-1", "replace").lower())
