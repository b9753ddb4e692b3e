"""Exact dedup by content sort.

Sampled splitters range-partition the rows by content, an external sort places equal texts next to each other, and each
text is compared in full with its neighbour. Rows are ordered by the text's first characters, a 64-bit print of the whole
text, the text itself and the id. The splitters are taken over the short parts and the id, so their sample stays small
whatever the length of the texts, and a text with very many copies spreads over several partitions.

The neighbours decide: a run of equal texts inside a partition gives its size and the id that stays. Only the runs at the
two edges of a partition can go on in another one; these alone, some two per partition, are put together by their SHA-256.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from layerline.llm.common import in_worker, record, stored, to_arrow, whole_text

MARKED = "doc_id long, run_keep long, run_size long, first boolean, repeated boolean, edge boolean, text_hash binary"
MOST_ROWS = 1 << 16


class Run:
    """Rows of one text that lie next to each other: ids in ascending order, the null ones before."""

    def __init__(self, text: pa.Scalar):
        self.text, self.digest = text, hashlib.sha256(text.as_buffer()).digest()
        self.nulls, self.ids = 0, array("q")

    def add(self, ids: pa.Array) -> None:
        self.nulls += ids.null_count
        self.ids.frombytes(ids.drop_null().to_numpy().tobytes())

    def rows(self, largest: bool, edge: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        size = self.nulls + len(self.ids)
        keep = (self.ids[-1] if largest else self.ids[0]) if self.ids else None
        last: object = self
        for start in range(0, size, MOST_ROWS):
            n = min(MOST_ROWS, size - start)
            nulls = max(0, min(self.nulls - start, n))
            ids = [None] * nulls + self.ids[max(0, start - self.nulls) : max(0, start + n - self.nulls)].tolist()
            repeated = [value == before for value, before in zip(ids, [last, *ids])]
            last = ids[-1]
            first = [start == 0] + [False] * (n - 1)
            yield record(schema, ids, [keep] * n, [size] * n, first, repeated, [edge] * n, [self.digest] * n)


def run_marker(largest: bool):
    """Every row with its run's size and the id that stays; repeated: same id and text as the row before it.

    Rows with one print lie together. Their runs may go on elsewhere when they are the first or the last of a partition.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Run]]:
        run, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, ids, prints = batch.column("text"), batch.column("doc_id"), batch.column("print")
            starts = [0, *(i + 1 for i, same in enumerate(pc.equal(texts[1:], texts[:-1]).to_pylist()) if not same), len(texts)]
            for a, b in zip(starts, starts[1:]):
                if run is None or a or not texts[0].equals(run.text):
                    if run is not None:
                        yield held, run
                    run, held = Run(texts[a]), prints[a].as_py()
                run.add(ids[a:b])
        if run is not None:
            yield held, run

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("exact_copies")
        schema, waiting, here, first = to_arrow(MARKED), [], None, True
        for held, run in runs(batches):
            if waiting and held != here:
                yield from gathered(waiting, first, schema)
                waiting, first = [], False
            here = held
            waiting.append(run)
        yield from gathered(waiting, True, schema)

    def gathered(found: list[Run], edge: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        small, rows = [], 0
        for run in found:
            for part in run.rows(largest, edge, schema):
                small.append(part)
                rows += len(part)
                if rows >= MOST_ROWS:
                    yield from pa.Table.from_batches(small).combine_chunks().to_batches()
                    small, rows = [], 0
        if small:
            yield from pa.Table.from_batches(small).combine_chunks().to_batches()

    return emit


def exact_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "smallest",
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per row of ``docs``.

    Texts are equal when they are identical after ``normalise`` (default: unchanged); null counts as empty, and empty
    texts equal each other. ``keep`` is "smallest" or "largest" id. Of rows equal in id and text one is kept, and each
    counts in ``group_size``. A null id stays only where its group has no other. An empty table gives no rows. Other
    columns are not looked at. A task holds two neighbouring texts, and the ids of a run, however long the texts are.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (normalise(text) if normalise else text).alias("text"))
    ordered = (
        rows.withColumns({"head": F.substring("text", 1, 32), "print": F.xxhash64("text")})
        .repartitionByRange("head", "print", "doc_id")
        .sortWithinPartitions("head", "print", "text", "doc_id")
        .select("doc_id", "text", "print")
    )
    marked = stored(ordered.mapInArrow(run_marker(keep == "largest"), MARKED), "content_runs")
    best = F.max("run_keep") if keep == "largest" else F.min("run_keep")
    edges = (
        marked.where("edge AND first").groupBy("text_hash")
        .agg(best.alias("edge_keep"), F.sum("run_size").alias("edge_size"), F.lit(True).alias("met"))
    )
    # One print at each edge of a partition: two rows per partition, whatever the number of copies.
    joined = marked.join(F.broadcast(edges), "text_hash", "left")
    decided = joined.withColumns({
        "keep_id": F.when(F.col("met"), F.col("edge_keep")).otherwise(F.col("run_keep")),
        "group_size": F.coalesce("edge_size", "run_size"),
    })
    return decided.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("repeated")).alias("kept"),
        F.lower(F.hex("text_hash")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows equal in id and text stay once."""
    normalise, text = options.get("normalise"), whole_text(text_col)
    hashed = F.sha2((normalise(text) if normalise else text).cast("binary"), 256)
    kept = exact_copies(docs, id_col, text_col, **options).where("kept")
    kept = kept.select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_key")).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__kept_id")) & (F.col("__text_key") == F.col("__kept_key"))
    stays = docs.withColumn("__text_key", hashed).join(kept, same, "left_semi")
    return stays.dropDuplicates([id_col, "__text_key"]).drop("__text_key")
