"""Ranked lexical search: a stated set of items against all documents, by dense tiles of impacts and weights.

Items are taken in blocks of bounded size; each block's distinct terms are its vocabulary. One pass over the documents
stores the occurrences of vocabulary terms and the length of each text. From these come the corpus figures, and each task
then multiplies tiles of documents' impacts with tiles of items' weights in double precision. All factors are integers and
a tile is narrow enough for every partial sum to stay below 2^53, so the products are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from layerline.llm.common import NO_ID, record, slices, stored, to_arrow, whole_text

# Scales of weights, impacts and lengths, and the parts of the length that count.
WEIGHT_SCALE = 1000
IMPACT_SCALE = 1_000_000_000
TIMES_SCALE = 1000
LENGTH_SCALE = 8
LENGTH_SHARE, LENGTH_WHOLE = 90, 100
#: No impact reaches this, as the divisor is more than TIMES_SCALE times the occurrences.
IMPACT_LIMIT = IMPACT_SCALE // TIMES_SCALE
EXACT = 1 << 53

#: Bytes of text that are split into terms at once.
PIECE = 1 << 20
FOUND = "doc_id long, n long, terms array<int>, times array<long>"
RANKED = "node long, item_id long, doc_id long, score long"

# Every byte of a separator becomes a blank and A-Z their small letters; the bytes of other characters are from 0x80 on.
TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def term_lists(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in lists that cover about ``piece`` bytes each; no term is cut."""
    clean = text.translate(TERM_BYTES)
    start = 0
    while start < len(clean):
        end = clean.find(b" ", start + piece)
        end = len(clean) if end < 0 else end
        yield clean[start:end].split()
        start = end


def item_emitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow("item_id long, terms array<binary>")
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1)
            terms = {term for part in term_lists(row.column("text").cast(pa.large_binary())[0].as_py()) for term in part}
            yield record(schema, row.column("item_id"), [sorted(terms)])


def occurrence_emitter(vocabulary: dict[bytes, int]):
    """Rows ``FOUND``: length and vocabulary terms of each text that has a term at all."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, known = to_arrow(FOUND), vocabulary.get
        for batch in slices(batches, 1 << 23):
            ids, lengths, terms, times = [], [], [], []
            texts = batch.column("text").cast(pa.large_binary())
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                n, counts = 0, Counter()
                for part in term_lists(text.as_py()):
                    n += len(part)
                    counts.update(map(known, part))
                if n:
                    counts.pop(None, None)
                    ids.append(doc_id)
                    lengths.append(n)
                    terms.append(list(counts))
                    times.append(list(counts.values()))
            yield record(schema, ids, lengths, terms, times)

    return emit


def length_factors(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """``m`` of each document: its length against the mean length, in hundredths, with the shares of the formula."""
    if not len(n):
        return n
    if LENGTH_SHARE * int(n.max()) * documents < 1 << 63:
        return LENGTH_WHOLE - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // total
    return np.array([LENGTH_WHOLE - LENGTH_SHARE + (LENGTH_SHARE * k * documents) // total for k in n.tolist()], np.int64)


def best(node: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows of each node: highest score first, equal scores by ascending id."""
    order = np.lexsort((doc, -score, node))
    ranked = node[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
    place = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.r_[starts, len(ranked)]))
    return order[place < k]


def rank_emitter(nodes, item_ids, starts, terms, weights, documents, total, k, item_tile, term_tile, doc_tile):
    """Rows ``RANKED``: the k best documents of each item among those of a task.

    ``terms[starts[i]:starts[i + 1]]`` are the vocabulary numbers of item i's terms, ``weights`` the weight of each number.
    """
    width = max(1, min(term_tile, (EXACT - 1) // (IMPACT_LIMIT * max(1, int(weights.max(initial=0))))))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow(RANKED)

        @lru_cache(maxsize=2)
        def tile(first: int) -> tuple[np.ndarray, list[np.ndarray]]:
            """Column of each vocabulary number among the tile's own terms, and weights in tiles of terms by items."""
            last = min(first + item_tile, len(nodes))
            held = terms[starts[first]:starts[last]]
            own = np.unique(held)
            column = np.full(len(weights), -1, np.int32)
            column[own] = np.arange(len(own), dtype=np.int32)
            items = np.repeat(np.arange(last - first), np.diff(starts[first:last + 1]))
            parts = []
            for low in range(0, len(own), width):
                part = np.zeros((min(width, len(own) - low), last - first))
                inside = (column[held] >= low) & (column[held] < low + width)
                part[column[held][inside] - low, items[inside]] = weights[held[inside]]
                parts.append(part)
            return column, parts

        least = np.zeros(len(nodes), np.int64)
        item, score, doc = (np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            if not len(batch):
                continue
            n = batch.column("n").to_numpy()
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            listed, counted = batch.column("terms"), batch.column("times")
            row = np.repeat(np.arange(len(batch)), np.diff(listed.offsets.to_numpy()))
            number, times = listed.flatten().to_numpy(), counted.flatten().to_numpy()
            m = length_factors(n, documents, total)
            impact = (IMPACT_SCALE * times) // (TIMES_SCALE * times + LENGTH_SCALE * m[row])
            for first in range(0, len(nodes), item_tile):
                column, parts = tile(first)
                items = slice(first, first + item_tile)
                for start in range(0, len(batch), doc_tile):
                    low, high = np.searchsorted(row, (start, start + doc_tile))
                    at, place, value = row[low:high] - start, column[number[low:high]], impact[low:high]
                    size = min(doc_tile, len(batch) - start)
                    sums = np.zeros((size, len(least[items])), np.int64)
                    for t, part in enumerate(parts):
                        inside = (place >= t * width) & (place < (t + 1) * width)
                        dense = np.zeros((size, len(part)))
                        dense[at[inside], place[inside] - t * width] = value[inside]
                        sums += (dense @ part).astype(np.int64)
                    # Rows that tie with the k-th best of the tile stay, so that ids decide among them below.
                    if size > k:
                        least[items] = np.maximum(least[items], np.partition(sums, size - k, axis=0)[size - k])
                    where, which = np.nonzero(sums >= np.maximum(least[items], 1))
                    item = np.r_[item, which + first]
                    score = np.r_[score, sums[where, which]]
                    doc = np.r_[doc, ids[start + where]]
                    kept = best(item, score, doc, k)
                    item, score, doc = item[kept], score[kept], doc[kept]
                    full = np.bincount(item, minlength=len(nodes)) >= k
                    lowest = np.full(len(nodes), np.iinfo(np.int64).max)
                    np.minimum.at(lowest, item, score)
                    least[full] = np.maximum(least[full], lowest[full])
        ids = pa.array(item_ids, pa.int64()).take(pa.array(item))
        yield record(schema, nodes[item], ids, pa.array(doc, mask=doc == NO_ID), score)

    return emit


def lexical_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_terms: int = 1 << 20,
    item_tile: int = 256,
    term_tile: int = 4096,
    doc_tile: int = 512,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above 0, ranks from 1.

    Terms are the runs of digits, letters and characters beyond ASCII, with A-Z in lower case, of whole texts. Null and
    empty texts have no terms: such documents are in no figure, and such items have no rows. Equal scores rank by
    ascending id, a null id first. Rows of ``docs`` that share an id are documents of their own and may both be listed.
    Rows of ``items`` that are equal in id and text count once; those that share only the id are ranked apart. Other
    columns of either table are not read. Long texts are split into terms piece by piece.

    About ``block_terms`` terms of items are held at a time, on the driver and in each task, or those of one item
    if it has more; the documents are read once per block.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    asked = items.select(F.col(item_id_col).cast("long").alias("item_id"), whole_text(item_text_col).alias("text")).distinct()
    numbered = stored(
        asked.mapInArrow(item_emitter, "item_id long, terms array<binary>").where("size(terms) > 0")
        .select(F.monotonically_increasing_id().alias("node"), "item_id", "terms"),
        "items",
    )
    held = numbered.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(held / block_terms))
    of_block = F.pmod(F.xxhash64("node"), F.lit(blocks))
    found = [
        _ranked(texts, numbered.where(of_block == block).orderBy("node").collect(), k, item_tile, term_tile, doc_tile)
        for block in range(blocks)
    ]
    found = [part for part in found if part is not None]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    listed = reduce(DataFrame.union, found).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    # In two steps: no task sees the lists of all tasks for an item.
    for keys in (["node", "part"], ["node"]):
        listed = listed.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return listed.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _ranked(texts: DataFrame, block: list, k: int, item_tile: int, term_tile: int, doc_tile: int) -> DataFrame | None:
    if not block:
        return None
    vocabulary = {bytes(term): i for i, term in enumerate(sorted({term for row in block for term in row.terms}))}
    occurrences = stored(texts.mapInArrow(occurrence_emitter(vocabulary), FOUND), "occurrences")
    total = occurrences.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    if not total.documents:
        return None
    weights = np.zeros(len(vocabulary), np.int64)
    # At most one row per term of the block.
    for term, df in occurrences.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[term] = math.floor(WEIGHT_SCALE * math.log((2 * total.documents + 2) / (2 * df + 1)))
    sizes = [len(row.terms) for row in block]
    emitter = rank_emitter(
        np.array([row.node for row in block], np.int64),
        [row.item_id for row in block],
        np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
        np.array([vocabulary[bytes(term)] for row in block for term in row.terms], np.int32),
        weights, total.documents, total.terms, k, item_tile, term_tile, doc_tile,
    )
    return occurrences.mapInArrow(emitter, RANKED)
