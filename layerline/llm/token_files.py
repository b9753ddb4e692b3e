"""Token ids in a Re-Pair file format.

Documents are range-partitioned by id, encoded in id order and written in blocks of whole documents. Each block replaces
frequent pairs of neighbouring ids by nonterminals, again and again, and holds its rules, the expansion length of each
rule and the replaced sequence, so a block, or a span of ids within it, is decoded without any other.

A block is one row of a Parquet folder: ``shard, block, ids, n_tokens, rules, expansion, sequence``, and the least and the
largest document id, by which readers of few documents leave blocks out. Integers are little-endian 32-bit; ids holds the
documents' ids as 64-bit integers and n_tokens their lengths.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from layerline.llm.common import NO_ID, id_of, in_worker, record, slices, stored, to_arrow, whole_text

FILE = "shard int, block int, ids binary, n_tokens binary, rules binary, expansion binary, sequence binary, vocabulary int, first_id long, last_id long"
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def compress(ids: np.ndarray, first: int, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The rules (pairs; rule k is symbol ``first + k``) and the sequence in which no pair occurs ``least`` times.

    A rule and its expansion length take three numbers and each occurrence saves one, so that rarer pairs save nothing.
    In a round a symbol is a left or a right one, or doubled, as in its most frequent pair; all such pairs of a left and a
    right symbol are replaced at once, since they never overlap. The most frequent pair is always among them. A pair found to
    be rare stays rare, since new neighbours are new symbols, so a round counts only pairs that were frequent or hold a symbol
    of the round before.
    """
    sequence, rules, symbols = ids.astype(np.int64), [np.zeros((0, 2), np.int32)], first
    live = np.arange(len(sequence) - 1)
    while len(live):
        pair = (sequence[live] << 32) | sequence[live + 1]
        # A pair is in no fewer than ``least`` places only if its cell is: the others need no exact count.
        cell = ((pair.view(np.uint64) * SPREAD) >> np.uint64(46)).astype(np.int32)
        maybe = np.bincount(cell, minlength=1 << 18)[cell] >= least
        live, pair = live[maybe], pair[maybe]
        order = np.argsort(pair)
        ranked = pair[order]
        begin = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]][: len(ranked)])
        count = np.diff(np.r_[begin, len(ranked)])
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        often = often[np.lexsort((ranked[begin[often]], -count[often]))]
        found, rank = ranked[begin[often]], np.arange(len(often))
        left, right = found >> 32, found & 0xFFFFFFFF
        # The rank of the most frequent pair that begins, and that ends, with a symbol: the last one written stays.
        begins, ends = np.full(symbols, len(often)), np.full(symbols, len(often))
        begins[left[::-1]], ends[right[::-1]] = rank[::-1], rank[::-1]
        wins = np.where(left == right, (begins[left] == rank) & (ends[left] == rank), (begins[left] < ends[left]) & (ends[right] < begins[right]))
        name = np.full(len(begin), -1)
        name[often] = np.where(wins, symbols + np.cumsum(wins) - 1, 0)
        names = np.empty(len(live), np.int64)
        names[order] = np.repeat(name, count)
        hit = names > 0
        at, new = live[hit], names[hit]
        # What is replaced overlaps only in runs of one symbol: take every second one of a run.
        run = np.r_[True, np.diff(at) != 1]
        start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        second = (np.arange(len(at)) - start) % 2 == 1
        at, new = at[~second], new[~second]
        sequence[at] = new
        keep = np.ones(len(sequence), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        waiting = live[names == 0]
        sequence = sequence[keep]
        again = np.zeros(len(sequence) + 1, bool)
        again[moved[waiting[keep[waiting]]]] = True
        again[moved[at]] = True
        again[moved[at] - 1] = True
        live = np.flatnonzero(again[: max(len(sequence) - 1, 0)])
        rules.append(np.c_[left[wins], right[wins]].astype(np.int32))
        symbols += int(wins.sum())
    return np.concatenate(rules), sequence.astype(np.int32)


def expansions(rules: np.ndarray, first: int) -> np.ndarray:
    size = np.ones(len(rules), np.int32)
    for k, (a, b) in enumerate(rules.tolist()):
        size[k] = (size[a - first] if a >= first else 1) + (size[b - first] if b >= first else 1)
    return size


def expand(rules: np.ndarray, sequence: np.ndarray, first: int) -> np.ndarray:
    """The ids of a sequence of symbols."""
    while len(sequence):
        rule = sequence >= first
        if not rule.any():
            break
        at = np.cumsum(1 + rule) - 1 - rule
        wider = np.empty(len(sequence) + int(rule.sum()), np.int32)
        wider[at] = np.where(rule, rules[np.where(rule, sequence - first, 0), 0], sequence) if len(rules) else sequence
        wider[at[rule] + 1] = rules[sequence[rule] - first, 1]
        sequence = wider
    return sequence


def span(rules: np.ndarray, expansion: np.ndarray, sequence: np.ndarray, first: int, start: int, end: int) -> np.ndarray:
    """Ids ``start`` to ``end`` of a block: only the symbols that reach into the span are expanded."""
    size = np.where(sequence >= first, expansion[np.maximum(sequence - first, 0)], 1) if len(expansion) else np.ones(len(sequence), int)
    ends = np.cumsum(size)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, end, "left") + 1
    skipped = int(ends[a - 1]) if a else 0
    return expand(rules, sequence[a:b], first)[start - skipped : end - skipped]


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, which is asked once for each distinct chunk.

    A byte-level tokenizer without normaliser never joins what stands on both sides of a lone blank between two other
    characters: the blank begins the next token. Such texts are cut there. Texts of any other tokenizer are one chunk.
    A special token that a text spells out gets its own id, as by the library's default; without a blank it lies in one
    chunk. Where an added token holds a blank or looks at its neighbours, texts are one chunk too.
    """

    BORDER = re.compile(r"(?<=\S)(?=\x20\S)")
    #: Chunks kept in each half, and the longest one kept, so that what is kept has a bounded size.
    MOST_CHUNKS, LONGEST = 100_000, 64
    #: Chunks that the library gets as one text.
    TOGETHER = 1000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        self.cuts = (
            before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
            and not made["normalizer"] and not made["truncation"] and not made["padding"]
            and not any(
                "\x20" in token["content"] or token["lstrip"] or token["rstrip"] or token["single_word"]
                for token in made["added_tokens"])
        )
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Bytes of each id: a byte-level token has one letter for a byte, an added one is spelled out.
        vocabulary = self.tokenizer.get_vocab() if self.cuts else {}
        self.sizes = np.zeros(1 + max(vocabulary.values(), default=0), np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)
        for token in made["added_tokens"] if self.cuts else []:
            self.sizes[token["id"]] = len(token["content"].encode())

    def chunks(self, text: str) -> list[str]:
        return self.BORDER.split(text) if self.cuts else [text]

    def apart(self, chunks: list[str]) -> Iterator[bytes]:
        """Ids of each chunk, asked for alone."""
        return (array("i", found.ids).tobytes() for found in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False))

    def learn(self, chunks: list[str]) -> None:
        """Ask the library for chunks: what begins with a lone blank and ends without one as one text, cut where a chunk ends."""
        joins = [c for c in chunks if self.cuts and c[:1] == "\x20" and not c[1:2].isspace() and not c[-1].isspace()]
        groups = [joins[at : at + self.TOGETHER] for at in range(0, len(joins), self.TOGETHER)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(["".join(group) for group in groups], add_special_tokens=False)):
            ids = np.array(found.ids, np.int32)
            ends = np.cumsum(self.sizes[ids])
            stops = np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in group])
            last = np.minimum(np.searchsorted(ends, stops), len(ends) - 1)
            if len(ends) and ends[-1] == stops[-1] and (ends[last] == stops).all():
                packed, cuts = ids.tobytes(), (4 * (last + 1)).tolist()
                self.known.update(zip(group, (packed[a:b] for a, b in zip([0, *cuts], cuts))))
            else:
                self.known.update(zip(group, self.apart(group)))
        rest = [c for c in chunks if c not in self.known]
        self.known.update(zip(rest, self.apart(rest)))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.chunks(text) for text in texts]
        if len(self.known) > self.MOST_CHUNKS:
            # Chunks that are met again come back from the older half, so frequent ones are not lost.
            self.older, self.known = self.known, {}
        known, older, new = self.known, self.older, []
        for chunk in set(chain.from_iterable(cut)).difference(known):
            if chunk in older:
                known[chunk] = older[chunk]
            else:
                new.append(chunk)
        for at in range(0, len(new), 10_000):
            self.learn(new[at : at + 10_000])
        out = [np.frombuffer(b"".join(map(known.__getitem__, chunks)), np.int32) for chunks in cut]
        for chunk in new:
            if len(chunk) > self.LONGEST:
                del known[chunk]
        return out


def encoder(path: str, end_id: int, block_tokens: int):
    def tokenizer() -> ChunkEncoder:
        # A task has one core: threads of the library would cost their start and each its memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return in_worker(("token_files", path), lambda: ChunkEncoder(path))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, encode = to_arrow(FILE), tokenizer()
        first = max(encode.tokenizer.get_vocab_size(), end_id + 1)
        shard, block = TaskContext.get().partitionId(), 0
        ids, lists, total = [], [], 0

        def written():
            rules, sequence = compress(np.concatenate(lists), first)
            return record(
                schema, [shard], [block], [np.array(ids, np.int64).tobytes()], [np.array([len(x) for x in lists], np.int32).tobytes()],
                [rules.tobytes()], [expansions(rules, first).tobytes()], [sequence.tobytes()], [first], [ids[0]], [ids[-1]],
            )

        for batch in slices(batches, 1 << 20):
            for key, found in zip(batch.column("k1").to_pylist(), encode(batch.column("text").to_pylist())):
                tokens = np.append(found, np.int32(end_id))
                if lists and total + len(tokens) > block_tokens:
                    yield written()
                    block, ids, lists, total = block + 1, [], [], 0
                ids.append(key)
                lists.append(tokens)
                total += len(tokens)
        if lists:
            yield written()

    return emit


def decode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow("shard int, block int, place int, k1 long, n_tokens long, ids_crc32 long")
    for batch in batches:
        for row in batch.to_pylist():
            rules = np.frombuffer(row["rules"], np.int32).reshape(-1, 2)
            ids = expand(rules, np.frombuffer(row["sequence"], np.int32), row["vocabulary"])
            keys, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["n_tokens"], np.int32)
            ends = np.cumsum(sizes, dtype=np.int64)
            crc = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends, sizes)]
            yield record(schema, [row["shard"]] * len(keys), [row["block"]] * len(keys), np.arange(len(keys)), keys, sizes.astype(np.int64), crc)


def decode_documents(wanted: np.ndarray):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow("k1 long, ids array<int>")
        for batch in batches:
            for row in batch.to_pylist():
                keys, ends = np.frombuffer(row["ids"], np.int64), np.cumsum(np.frombuffer(row["n_tokens"], np.int32), dtype=np.int64)
                places = np.flatnonzero(np.isin(keys, wanted)).tolist()
                rules, expansion = np.frombuffer(row["rules"], np.int32).reshape(-1, 2), np.frombuffer(row["expansion"], np.int32)
                sequence, first = np.frombuffer(row["sequence"], np.int32), row["vocabulary"]
                found = [span(rules, expansion, sequence, first, int(ends[p - 1]) if p else 0, int(ends[p])) for p in places]
                yield record(schema, keys[places], [ids.tolist() for ids in found])

    return emit


def write_token_files(
    docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    block_tokens: int = 1 << 18,
) -> None:
    """Encode and write all rows in ascending id order (a null id first). Null texts are empty and have the end id alone.

    Rows equal in id are in order of their texts. An empty table writes no block.
    """
    text = whole_text(text_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k1"), text.alias("text"))
    ordered = rows.repartitionByRange(F.col("k1")).sortWithinPartitions("k1", "text")
    ordered.mapInArrow(encoder(tokenizer_path, end_id, block_tokens), FILE).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files.

    The totals of shards, one row per writing task, meet in one window; blocks are summed within their shard.
    """
    from pyspark.sql.window import Window

    files = spark.read.schema(FILE).parquet(path)
    decoded = stored(files.mapInArrow(decode_blocks, "shard int, block int, place int, k1 long, n_tokens long, ids_crc32 long"), "decoded_blocks")
    blocks = decoded.groupBy("shard", "block").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    in_shard = blocks.select("shard", "block", F.coalesce(before, F.lit(0)).alias("block_before"))
    shards = blocks.groupBy("shard").agg(F.sum("total").alias("total"))
    over = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = in_shard.join(shards.select("shard", F.coalesce(over, F.lit(0)).alias("shard_before")), "shard")
    inside = F.sum("n_tokens").over(Window.partitionBy("shard", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return (
        decoded.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offsets, ["shard", "block"])
        .select(id_of().alias("doc_id"), (F.col("shard_before") + F.col("block_before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def read_documents(spark: SparkSession, path: str, wanted: Sequence[int | None]) -> DataFrame:
    """``doc_id, ids`` of the documents with these ids, a null id among them; ids that no document has give no row.

    Blocks whose ids lie apart are not read, and of the others only the symbols that reach into a document are expanded.
    """
    keys = np.unique(np.array([NO_ID if key is None else key for key in wanted], np.int64))
    files = spark.read.schema(FILE).parquet(path)
    reached = files.where(F.lit(False)) if not len(keys) else files.where((F.col("first_id") <= int(keys[-1])) & (F.col("last_id") >= int(keys[0])))
    return reached.mapInArrow(decode_documents(keys), "k1 long, ids array<int>").select(id_of().alias("doc_id"), "ids")
