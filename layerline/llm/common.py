"""Helpers shared by the operators: row keys, written intermediate tables, and texts as byte arrays."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from layerline.session import scratch_path
from layerline.sources.paths import remove

NO_ID = -(1 << 63)
#: What a worker keeps for its next tasks; see ``in_worker``.
KEPT: dict = {}
#: ASCII white space as a Java and RE2 character class; words are the runs between it.
SPACE = r"[\x20\x09-\x0D]+"


#: Whether the shuffle files of a query go when it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting that holds for what is run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared scratch folder and read back: cuts the lineage, survives lost executors.

    What was shuffled for them is deleted at once, since only the written rows are read again.
    """
    path = scratch_path(df.sparkSession, label)
    with setting(df.sparkSession, CLEAN_UP, "true"):
        df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table.stored_at)


def release() -> None:
    """Give back the memory that a worker has freed. The allocators hold it otherwise, and the worker goes on to other work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        # Only glibc has it.
        pass


def in_worker(key: Hashable, make: Callable | None = None):
    """What a worker has made for this key, kept for its next tasks until a task asks for another key.

    Workers outlive a step, so without that one holds the models and caches of all steps before.
    """
    if key not in KEPT:
        KEPT.clear()
        gc.collect()
        release()
        KEPT[key] = make() if make else None
    return KEPT[key]


def by_key(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Rows with the facts of their key; ``facts`` has one row per key, and in ``n`` how many rows have it.

    Keys of more than a thousandth of all rows are hot. There are fewer than a thousand, so their facts are broadcast and no
    task gathers their rows; the others are joined by key.
    """
    hot = facts.where(F.col(n) > max(1000, total // 1000)).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), keys, "left")
    names = [name for name in marked.columns if name != "_hot"]
    rest = marked.where("_hot IS NULL").select(*rows.columns).join(facts, keys, "left")
    return marked.where("_hot").select(*names).unionByName(rest.select(*names))


def whole_text(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """128 bits of the SHA-256 of the text's UTF-8 bytes."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def same_row(id_col: str, text_col: str) -> Column:
    """Whether a row is the one with ``__kept_id`` and ``__kept_key``, of a table of kept rows."""
    return F.col(id_col).cast("long").eqNullSafe(F.col("__kept_id")) & (text_key(whole_text(text_col)) == F.col("__kept_key"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k1, k2, text``. k1 is the id, with a null id as the smallest; k2 tells rows that share an id but not a text.

    k2 is 128 bits of the text's SHA-256, as 16 bytes.
    """
    text = whole_text(text_col)
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k1"),
        text_key(text).alias("k2"),
        text.alias("text"),
    )


def id_of(key: str = "k1") -> Column:
    return F.nullif(F.col(key), F.lit(NO_ID))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and the offset of each text and of the end."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most that many bytes of text; a longer text has a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def to_arrow(ddl: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "short": pa.int16(), "byte": pa.int8(), "string": pa.string(),
        "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
        "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])
