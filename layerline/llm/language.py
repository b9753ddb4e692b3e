"""Language ID by hierarchical discrimination: a family first, then one-versus-one linear support vector machines in it.

Features are hashed byte trigrams of the whole text (A-Z lowered, digits and ASCII punctuation as blanks), as roots of
counts scaled to length one. Families are merged from the languages' mean vectors, the closest first, until the next merge
would be the farthest out of proportion to the one before; one-versus-one machines choose the family, and others the language
within it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from layerline.llm.common import in_worker, record, release, slices, text_bytes, text_key, to_arrow, whole_text

BITS = 11
DIM = 1 << BITS
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:65] = 32
FOLD[65:91] += 32
FOLD[91:97] = 32
FOLD[123:128] = 32


def features(column: pa.Array) -> np.ndarray:
    """One row of ``DIM`` features per text; a text without a trigram has zeros."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, DIM), np.float32)
    folded = FOLD[data].astype(np.uint32)
    code = (folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]
    cell = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    doc = np.repeat(np.arange(n), np.diff(offsets))[: len(cell)]
    inside = (np.arange(len(cell)) + 3 <= offsets[1:][doc]) & (code != 0x202020)
    counts = np.bincount(doc[inside] * DIM + cell[inside], minlength=n * DIM).reshape(n, DIM)
    x = np.sqrt(counts).astype(np.float32)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2 << 20):
        for i in range(0, len(batch), 256):
            yield batch.slice(i, 256)


def sizes_of(batch: pa.RecordBatch) -> np.ndarray:
    """The length of each text in bytes."""
    return np.diff(text_bytes(batch.column("text"))[1]).astype(np.int64)


def train_pair(x: np.ndarray, y: np.ndarray, c: float = 10.0, passes: int = 20) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss by dual coordinate descent; y is 1 or -1."""
    x = np.c_[x, np.ones(len(x), np.float32)].astype(np.float64)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    square = (x * x).sum(1) + 1 / (2 * c)
    order = np.random.RandomState(5)
    for _ in range(passes):
        for i in order.permutation(len(x)):
            step = y[i] * (x[i] @ w) - 1 + alpha[i] / (2 * c)
            new = max(alpha[i] - step / square[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


class Choice:
    """One-versus-one machines over some classes: most votes win, ties by the sum of margins."""

    def __init__(self, labels: list, x: np.ndarray, y: np.ndarray):
        self.labels = labels
        self.pairs = list(combinations(range(len(labels)), 2))
        self.w, self.b = np.zeros((DIM, len(self.pairs))), np.zeros(len(self.pairs))
        for k, (i, j) in enumerate(self.pairs):
            rows = (y == i) | (y == j)
            self.w[:, k], self.b[k] = train_pair(x[rows], np.where(y[rows] == i, 1.0, -1.0))

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the class, and its least probability against any other."""
        n = len(self.labels)
        if n == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = x @ self.w + self.b
        votes, least = np.zeros((len(x), n)), np.full((len(x), n), np.inf)
        for k, (i, j) in enumerate(self.pairs):
            m = margin[:, k]
            votes[:, i] += (m > 0) + 1e-3 * np.tanh(m)
            votes[:, j] += (m <= 0) - 1e-3 * np.tanh(m)
            least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
        best = votes.argmax(1)
        return best, 1 / (1 + np.exp(-2 * np.clip(least[np.arange(len(x)), best], -30, 30)))


def families(means: np.ndarray) -> list[int]:
    """The family of each language, named by its first member, from mean vectors of length one.

    Families are merged by the mean cosine of their members, the closest two first (ties: the first ones). Of the merges that
    leave two families, at least one counts, and the last that counts is the one before the largest relative step in distance.
    One or two languages, and languages of equal means throughout, are a family each.
    """
    n = len(means)
    apart = np.maximum(1 - means @ means.T, 0)
    groups, merges = [[i] for i in range(n)], []
    while len(groups) > 1:
        gap, i, j = min((apart[np.ix_(groups[i], groups[j])].mean(), i, j) for i, j in combinations(range(len(groups)), 2))
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
        merges.append((gap, [min(g) for i in range(n) for g in groups if i in g]))
    if len(merges) < 2 or merges[-1][0] < 1e-6:
        return list(range(n))
    steps = [later / max(gap, 1e-6) for (gap, _), (later, _) in zip(merges, merges[1:])]
    return merges[int(np.argmax(steps))][1]


class Model:
    """Machines for the family and, in each family, for the language.

    With ``evidence`` there are also machines for all pairs of languages. They choose nothing, but tell whether a text fits
    any language, since a family is a mixture that noise may fit.
    """

    def __init__(self, labels: list[str], x: np.ndarray, y: np.ndarray, evidence: bool = False):
        self.labels = labels
        means = np.array([x[y == i].mean(0) for i in range(len(labels))])
        means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
        family = families(means)
        kinds = sorted(set(family))
        self.members = [[i for i, f in enumerate(family) if f == k] for k in kinds]
        of = np.array([kinds.index(f) for f in family])
        self.family = Choice(kinds, x, of[y])
        self.within = []
        for members in self.members:
            rows = np.isin(y, members)
            self.within.append(Choice(members, x[rows], np.array([members.index(v) for v in y[rows]])))
        self.means, self.pairs = means, Choice(labels, x, y) if evidence else None

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its score."""
        family, score = self.family(x)
        out = np.zeros(len(x), int)
        for k, members in enumerate(self.members):
            rows = np.flatnonzero(family == k)
            if len(rows):
                best, own = self.within[k](x[rows])
                out[rows], score[rows] = np.array(members)[best], score[rows] * own
        return out, score

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Of the language that wins most pairs, the least probability against any other and the cosine to its mean."""
        best, least = self.pairs(x)
        return np.c_[least, (x * self.means[best]).sum(1)]


class Known:
    """The least evidence of a text in a learned language, by the length of the text.

    Each fold of the training rows is judged by a model of the others. A limit is the low quantile of the evidence of the
    quarter of the rows closest in length, at most ``NEAR``, with slack towards chance (a probability of a half, a cosine
    of zero). Fewer than ``FEWEST`` rows set no limit.
    """

    FOLDS, NEAR, FEWEST, LOW, SLACK = 3, 300, 30, 0.01, np.array([0.5, 0.8])
    CHANCE = np.array([0.5, 0.0])

    def __init__(self, labels: list[str], x: np.ndarray, y: np.ndarray, size: np.ndarray):
        found, sizes = [np.zeros((0, 2))], [np.zeros(0)]
        # Equal texts are in one fold.
        fold = np.array([zlib.crc32(v.tobytes()) % self.FOLDS for v in x])
        for k in range(self.FOLDS):
            rest = fold != k
            left = np.unique(y[rest])
            test = ~rest & np.isin(y, left)
            if test.any():
                model = Model([labels[i] for i in left], x[rest], np.searchsorted(left, y[rest]), evidence=True)
                found.append(model.evidence(x[test]))
                sizes.append(size[test])
        found, sizes = np.concatenate(found), np.concatenate(sizes)
        order = np.argsort(sizes, kind="stable")
        found, self.sizes = found[order], sizes[order]
        near = self.near = min(self.NEAR, max(self.FEWEST, len(found) // 4))
        self.limits = np.zeros((0, 2))
        if len(found) >= self.FEWEST:
            self.limits = np.array([
                np.quantile(found[a : a + near], self.LOW, axis=0) for a in range(len(found) - near + 1)
            ])
            self.limits = self.CHANCE + self.SLACK * (self.limits - self.CHANCE)

    def __call__(self, evidence: np.ndarray, size: np.ndarray) -> np.ndarray:
        if not len(self.limits):
            return np.ones(len(evidence), bool)
        middle = np.searchsorted(self.sizes, size) - self.near // 2
        return (evidence >= self.limits[np.clip(middle, 0, len(self.limits) - 1)]).all(1)


def train(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, most_languages: int, calibrate: bool = False,
) -> tuple[Model | None, Known | None]:
    """Fit on at most ``per_language`` labelled rows of each language, chosen by hash and described by whole texts."""
    labelled = docs.select(F.col(lang_col).cast("string").alias("label"), F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")).where(
        "label IS NOT NULL AND text RLIKE '\\\\p{L}'"
    )
    chosen = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    sizes = {row["label"]: row["n"] for row in chosen.orderBy(F.desc("n"), "label").limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages: raise most_languages")
    if not sizes:
        return None, None
    # A hash threshold twice as wide as needed leaves a few rows per language for the sort.
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, 2 * per_language / n))])
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) / float(1 << 20)
    drawn = labelled.withColumn("draw", draw).where(F.col("draw") < share[F.col("label")])

    def vectors(batches):
        for batch in blocks(batches):
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("id"), batch.column("draw"), pa.array([v.tobytes() for v in x], pa.binary()),
                 pa.array(sizes_of(batch))],
                names=["label", "id", "draw", "x", "size"],
            )

    from pyspark.sql.window import Window

    first = F.row_number().over(Window.partitionBy("label").orderBy("draw", "id", "x"))
    rows = (
        drawn.mapInArrow(vectors, "label string, id long, draw double, x binary, size long")
        .withColumn("place", first).where(F.col("place") <= per_language).orderBy("label", "place").collect()
    )
    labels = sorted({row["label"] for row in rows})
    x = np.array([np.frombuffer(row["x"], np.float32) for row in rows])
    y = np.array([labels.index(row["label"]) for row in rows])
    known = Known(labels, x, y, np.array([row["size"] for row in rows])) if calibrate else None
    return Model(labels, x, y, evidence=calibrate), known


def predictor(model: Model | None, known: Known | None, ddl: str):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("language")
        schema = to_arrow(ddl)
        for batch in blocks(batches):
            letters = np.array(batch.column("letters").to_pylist(), bool)
            names, score, sure = np.full(len(batch), "und", object), np.zeros(len(batch)), letters.copy()
            if model is not None and letters.any():
                x = features(batch.column("text"))
                best, found = model(x)
                names = np.where(letters, np.array(model.labels, object)[best], "und")
                score = np.where(letters, found, 0.0)
                if known is not None:
                    sure = letters & known(model.evidence(x), sizes_of(batch))
            more = [sure & (names != "und"), batch.column("text_key")] if "known" in schema.names else []
            yield record(schema, batch.column("row"), names.tolist(), score, *more)
        release()

    return emit


def language_id(
    docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = 300, most_languages: int = 100, calibrate: bool = False,
) -> DataFrame:
    """``doc_id, lang_pred, score``, one row per row of ``docs``; with ``calibrate`` also ``known, text_key``.

    The model is fitted on rows of ``training`` with a language and a letter: at most ``per_language`` of each language.
    Texts that are null, empty or without a letter get ``und`` and 0, and so do all when there is nothing to learn from.
    One learned language is predicted always. ``known`` tells texts that are in a learned language by the evidence that
    training texts of like length have for theirs; the score alone is high for any text. More than ``most_languages`` languages are refused.
    """
    model, known = train(training, id_col, text_col, lang_col, per_language, most_languages, calibrate)
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("row"), text.alias("text"), text.rlike(r"\p{L}").alias("letters"), *[text_key(text).alias("text_key")] * calibrate)
    ddl = "row long, lang_pred string, score double" + ", known boolean, text_key binary" * calibrate
    return rows.mapInArrow(predictor(model, known, ddl), ddl).withColumnRenamed("row", "doc_id")


def held_out(id_col: str = "doc_id", folds: int = 5):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))
