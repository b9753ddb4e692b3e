"""Windows of symbols that occur again, found from sampled anchors; shared by the two dedups of repeated strings.

Every window of ``length`` symbols has one anchor: the q-gram in it whose hash is least, the leftmost of equals. Equal
windows have the same anchor at the same offset, so nothing is lost when only anchors are bucketed. A cell is the run of
window starts of one document that share an anchor, and its region is the text that those windows cover.

1. Initial buckets: cells by their anchor, a q-gram. A bucket of one cell holds no repeat and is left.
2. Cells with equal regions agree in all windows; one of them stands for all.
3. Buckets that hold different regions are refined, level by level. At a level of width w the windows of a region are
   parted by their distance to the anchor, w distances to a part. The windows of a part share a core, of ``length - w + 1``
   symbols around the anchor, and the part's bucket is the pair of the identifiers of the core's first half and of the half
   that starts later. A part alone in its bucket holds no repeat; the others are refined again, until w is one and the
   core is the window. Equal windows lie at equal distances of equal anchors, so no pair of them is parted.

Keys of regions and cores have 128 bits. A document's repeated starts are bounded by its own length; a text that very
many documents share is combined before the shuffle, or split by AQE where it meets its documents again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from layerline.llm.common import discard, id_of, keyed, record, slices, stored, text_bytes, to_arrow
from layerline.llm.hashing import BASES, BYTE_VALUES, Windows, mix, sliding_min, word_hashes, word_spans

MOST = 2 << 20
CELLS = "k1 long, k2 binary, start int, n int, d int, anchor long, r1 long, r2 long"
PLACES = "k1 long, k2 binary, start int, n int, r1 long, r2 long"
PARTS = "w1 long, w2 long, region long, at int, n int, d int, mark long"


class Bytes:
    """Symbols are the bytes of the text."""

    unit = "bytes"

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_bytes(column)

    def values(self, which: int) -> np.ndarray:
        return BYTE_VALUES[which][self.data]

    def kept(self, doc: int, stays: np.ndarray) -> bytes:
        return self.data[self.offsets[doc] : self.offsets[doc + 1]][stays].tobytes()


class Words:
    """Symbols are the words of the text; words that stay are joined by one space."""

    unit = "words"

    def __init__(self, column: pa.Array):
        self.data, text_offsets = text_bytes(column)
        self.starts, self.ends, self.offsets = word_spans(self.data, text_offsets)

    def values(self, which: int) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends, which)

    def kept(self, doc: int, stays: np.ndarray) -> bytes:
        at = np.flatnonzero(stays) + self.offsets[doc]
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[at], self.ends[at]))


def cells_of(symbols, length: int, gram: int):
    """Document, first start, number of starts, distance to the anchor, anchor and the two region hashes of every cell."""
    values, offsets = symbols.values(0), symbols.offsets
    n = len(values)
    if n < length:
        return (np.zeros(0, np.int64),) * 7
    one, two = Windows(values, BASES[0]), Windows(symbols.values(1), BASES[1])
    grams = one(np.arange(n - gram + 1), gram)
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(order, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - length + 1]
    start = np.flatnonzero(np.arange(n - length + 1) + length <= offsets[1:][doc])
    if not len(start):
        return (np.zeros(0, np.int64),) * 7
    at = anchor[start]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(start)] - 1
    a, size, at = start[first], last - first + 1, at[first]
    shape = ((size << 32) + (at - a)).astype(np.uint64)
    r1 = one(a, size - 1 + length) ^ mix(shape + np.uint64(1))
    r2 = two(a, size - 1 + length) ^ mix(shape + np.uint64(2))
    return doc[a], a - offsets[doc[a]], size, at - a, grams[at].view(np.int64), r1.view(np.int64), r2.view(np.int64)


def cells_emitter(kind: type, length: int, gram: int, ddl: str = CELLS):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow(ddl)
        for batch in slices(batches, MOST):
            doc, *rest = cells_of(kind(batch.column("text")), length, gram)
            keys = batch.select(["k1", "k2"]).take(pa.array(doc, pa.int64()))
            found = dict(zip(("start", "n", "d", "anchor", "r1", "r2"), rest))
            yield record(schema, keys.column(0), keys.column(1), *(found[name] for name in schema.names[2:]))

    return emit


def parts_emitter(kind: type, length: int, width: int):
    core = length - width + 1
    half = core // 2

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow(PARTS)
        for batch in slices(batches, MOST):
            symbols = kind(batch.column("text"))
            hashes = Windows(symbols.values(0), BASES[0])
            opened = batch.column("opened")
            rows = opened.flatten()
            doc = np.repeat(np.arange(len(batch)), np.diff(opened.offsets.to_numpy()))
            field = {name: rows.field(name).to_numpy(zero_copy_only=False) for name in ("region", "start", "at", "n", "d", "mark")}
            start, n, d = (field[name].astype(np.int64) for name in ("start", "n", "d"))
            anchor = symbols.offsets[doc] + start + d
            many = d // width - (d - n + 1) // width + 1
            ends = np.cumsum(many)
            for i in range(0, len(n), 20_000):
                j = min(i + 20_000, len(n))
                cell = np.repeat(np.arange(i, j), many[i:j])
                part = d[cell] // width - (np.arange(len(cell)) + ends[i] - many[i] - (ends - many)[cell])
                far = np.minimum(d[cell], part * width + width - 1)
                near = np.maximum((d - n + 1)[cell], part * width)
                first = anchor[cell] - part * width
                w1, w2 = hashes(first, half), hashes(first + half, core - half)
                yield record(
                    schema, w1.view(np.int64), w2.view(np.int64), field["region"][cell], field["at"][cell] + d[cell] - far,
                    far - near + 1, far, field["mark"][cell],
                )

    return emit


def remover(kind: type, length: int, ddl: str):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow(ddl)
        for batch in slices(batches, MOST):
            symbols = kind(batch.column("text"))
            lists = batch.column("cells")
            rows = lists.flatten()
            doc = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            start, n = (rows.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("start", "n"))
            start += symbols.offsets[doc]
            offsets = rows.field("offsets")
            whole = offsets.is_null().to_numpy(zero_copy_only=False)
            some = start[~whole].repeat(pc.list_value_length(offsets.drop_null()).to_numpy(zero_copy_only=False))
            some += offsets.drop_null().flatten().to_numpy(zero_copy_only=False)
            # A window ends where its text does at the latest, so the texts of a batch can be counted through at once.
            size = int(symbols.offsets[-1]) + 1
            edges = np.bincount(np.r_[start[whole], some], minlength=size)
            edges -= np.bincount(np.r_[(start + n - 1)[whole], some] + length, minlength=size)
            removed = np.cumsum(edges)[:-1] > 0
            total = np.diff(symbols.offsets)
            gone, runs, digest = [], [], []
            for k, (first, last) in enumerate(zip(symbols.offsets[:-1].tolist(), symbols.offsets[1:].tolist())):
                away = removed[first:last]
                gone.append(int(away.sum()))
                runs.append(int(away[:1].sum() + (away[1:] & ~away[:-1]).sum()))
                digest.append(hashlib.sha256(symbols.kept(k, ~away)).hexdigest())
            yield record(schema, batch.column("k1"), total, gone, runs, digest)

    return emit


def levels(length: int, gram: int) -> list[int]:
    """Widths of the levels of refinement, down to one."""
    width = (length - gram + 1) // 9
    return [width, 1] if width > 1 else [1]


def remove_repeats(
    docs: DataFrame, kind: type, length: int, gram: int, earlier: bool, id_col: str, text_col: str
) -> DataFrame:
    """``doc_id, n_<unit>, n_removed, n_spans, kept_sha256``, one row per row of ``docs``.

    A symbol is removed when a window covers it that starts anywhere else (``earlier`` false), or that starts in a row
    with a smaller id (``earlier`` true).
    """
    if not 0 < gram <= length:
        raise ValueError("the gram must be between 1 and the length")
    rows = keyed(docs, id_col, text_col)
    cells = rows.mapInArrow(cells_emitter(kind, length, gram), CELLS)
    regions = stored(cells.groupBy("anchor", "r1", "r2").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min(F.struct("k1", "k2", "start", "n", "d")).alias("stands"),
    ), "regions")
    buckets = regions.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_regions"), F.sum("copies").alias("n_cells"))
    shared = regions.join(buckets.where("n_cells > 1"), "anchor").select(
        F.monotonically_increasing_id().alias("region"), "r1", "r2", "copies", "n_regions", "stands", F.col("stands.k1").alias("first_id"))
    shared = stored(shared, "shared_regions")
    discard(regions)
    # What decides whether a window goes: the least id that has it, or whether there is one copy only.
    mark = (F.col("first_id") if earlier else F.col("copies")).alias("mark")
    opened = shared.where("n_regions > 1").select("region", "stands.*", mark).withColumn("at", F.lit(0))
    for width in levels(length, gram):
        # Rows equal in id and text have the same windows: one of them is opened.
        lists = opened.groupBy("k1", "k2").agg(F.collect_list(F.struct("region", "start", "at", "n", "d", "mark")).alias("opened"))
        texts = rows.join(lists.select("k1", "k2"), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min("text").alias("text"))
        parts = stored(texts.join(lists, ["k1", "k2"]).mapInArrow(parts_emitter(kind, length, width), PARTS), "parts")
        groups = parts.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n_parts"), F.min("mark").alias("least")).where("n_parts > 1")
        met = parts.join(groups, ["w1", "w2"])
        if width > 1:
            # Parts that need not go themselves stay where a window of another may equal theirs.
            stands = shared.select("region", "stands.k1", "stands.k2", F.col("stands.start").alias("cell_start"))
            opened = stored(
                met.select("region", "at", "n", "d", "mark").join(stands, "region")
                .select("region", "k1", "k2", (F.col("cell_start") + F.col("at")).alias("start"), "at", "n", "d", "mark"),
                "opened_parts",
            )
        else:
            found = met.where("least < mark" if earlier else "mark = 1")
            offsets = found.groupBy("region").agg(F.collect_list("at").alias("offsets"))
            facts = shared.where("copies > 1 OR n_regions > 1").join(offsets, "region", "left")
            gone = F.col("copies") > 1
            facts = stored(facts.where(gone | F.col("offsets").isNotNull()).select("r1", "r2", "copies", "first_id", "offsets"), "repeated_regions")
        discard(parts)
    discard(shared)
    whole = F.col("k1") > F.col("first_id") if earlier else F.col("copies") > 1
    places = rows.mapInArrow(cells_emitter(kind, length, gram, PLACES), PLACES)
    spans = (
        places.join(facts, ["r1", "r2"])
        .where(whole | F.col("offsets").isNotNull())
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("start", "n", F.when(~whole, F.col("offsets")).alias("offsets"))).alias("cells"))
    )
    ddl = f"k1 long, n_{kind.unit} long, n_removed long, n_spans long, kept_sha256 string"
    cut = rows.join(spans, ["k1", "k2"], "left").mapInArrow(remover(kind, length, ddl), ddl)
    return cut.select(id_of().alias("doc_id"), f"n_{kind.unit}", "n_removed", "n_spans", "kept_sha256")


def repeated_strings(docs: DataFrame, length: int = 200, gram: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Suffix-array dedup over UTF-8 bytes: each byte covered by a string that also starts anywhere else is removed.

    Instead of all suffixes, one per cell is bucketed by its q-gram; buckets are refined by the identifiers of wider cores
    at later offsets until ``length`` bytes are told apart. Null texts are empty. Texts shorter than ``length`` lose nothing.
    Equal rows are repeats of each other. An empty table gives no rows; other columns are not looked at.
    """
    return remove_repeats(docs, Bytes, length, gram, False, id_col, text_col)


def repeated_words(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Substring dedup over words by doubling: windows of half the length that repeat are extended to the length.

    A word is removed when a window covers it whose words also start in a row with a smaller id; a null id counts as
    the smallest. Null texts have no words, and texts shorter than ``length`` words lose nothing.
    """
    return remove_repeats(docs, Words, length, length // 2, True, id_col, text_col)
