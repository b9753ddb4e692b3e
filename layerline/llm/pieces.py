"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct chunks (a run of word marks and the letters up to the next mark; no piece of the model reaches across
that border) are put end to end and their suffixes sorted. Every piece is binary-searched for its range of suffixes; the
occurrences are edges, sorted by position, and a pass over the positions relaxes them.

The model merges the best-ranked pair first, so an edge may extend a path only when the path's last piece and the edge's
piece, encoded together, stay these two: the path with that property is the model's own segmentation, and there is one.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from layerline.llm.common import id_of, in_worker, keyed, record, slices, to_arrow

MARK, BORDER = "▁", "\U0010fffe"
CHUNK = re.compile("▁+[^▁]*")


def inner_start(at: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether positions are among the sorted starts."""
    place = np.searchsorted(start, at)
    return (place < len(start)) & (start[np.minimum(place, len(start) - 1)] == at)


class PieceCodec:
    """Ids of a text and text of ids for a SentencePiece BPE model with byte fallback and no normalisation."""

    #: Letters whose suffixes are sorted at once, chunks kept in each half, and pairs of pieces kept: a worker's memory.
    LETTERS, CHUNKS, PAIRS = 1 << 17, 100_000, 300_000

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        kinds = (model.is_byte, model.is_control, model.is_unknown, model.is_unused)
        every = [(i, model.id_to_piece(i)) for i in range(model.get_piece_size())]
        normal = sorted((p, i) for i, p in every if not any(kind(i) for kind in kinds))
        if any(MARK in p.lstrip(MARK) for p, _ in normal):
            raise ValueError("pieces with a word mark after a letter are not supported")
        if any("\0" in p for p, _ in normal):
            raise ValueError("pieces with a null character are not supported")
        self.piece = dict(every)
        self.id = {p: i for p, i in normal}
        self.score = {p: model.get_score(i) for p, i in normal}
        self.byte = {int(p[3:5], 16): i for i, p in every if model.is_byte(i)}
        self.width = max(map(len, self.id), default=1)
        self.names = np.array([p for p, _ in normal], f"U{self.width}")
        self.sizes = np.array([len(p) for p, _ in normal])
        self.listed, self.numbers = [p for p, _ in normal], np.array([i for _, i in normal])
        # Pairs of pieces that have been looked at, sorted, and whether they stay apart.
        self.pairs, self.stay = np.array([-1]), np.zeros(1, bool)
        self.whole: dict[str, bool] = {}
        self.built: dict[str, tuple] = {}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # A piece's range of suffixes ends where its last character is exceeded.
        self.above = np.array([p[:-1] + chr(ord(p[-1]) + 1) for p, _ in normal], f"U{self.width}")
        spelled = {i: bytes([b]) for b, i in self.byte.items()}
        self.bytes_of = {i: spelled.get(i, p.encode()) for i, p in every}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by the model's own rule: the best pair first, the leftmost of equals."""
        return self.build(text, [])

    def build(self, text: str, steps: list) -> list[str]:
        """``merged``; ``steps`` gets each merge's score and the outer pieces after it. A merge looks up its two new neighbours only."""
        parts, score, none = list(text), self.score.get, -np.inf
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == none:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], none)
            steps.append((best, parts[0], parts[-1]))
        return parts

    def history(self, piece: str) -> tuple:
        """Scores of the merges that build a piece, and its first and last part before each of them and at the end."""
        found = self.built.get(piece)
        if found is None:
            steps: list = []
            self.build(piece, steps)
            scores, firsts, lasts = zip(*steps) if steps else ((), (), ())
            found = self.built[piece] = ((*scores, -np.inf), (piece[0], *firsts), (piece[-1], *lasts))
        return found

    def apart(self, a: str, b: str) -> bool:
        """Whether two pieces, encoded together, stay these two: no merge over their border comes before the merges left and right.

        Merges inside either do not depend on the other, so only the pair at the border is looked up. Of equal scores the
        leftmost goes first.
        """
        score, none, i, j = self.score.get, -np.inf, 0, 0
        (left, _, lasts), (right, firsts, _) = self.history(a), self.history(b)
        while True:
            over = score(lasts[i] + firsts[j], none)
            if left[i] > none and left[i] >= over and left[i] >= right[j]:
                i += 1
            elif over >= right[j]:
                return over == none
            else:
                j += 1

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The end position of each occurrence of a piece and the piece's place in the sorted names, from the sorted suffixes."""
        n = len(text)
        codes = np.frombuffer((text + "\0" * self.width).encode("utf-32-le", "surrogatepass"), np.uint32)
        suffixes = np.lib.stride_tricks.sliding_window_view(codes, self.width)[:n].copy().view(f"U{self.width}").ravel()
        order = np.argsort(suffixes, kind="stable")
        ranked = suffixes[order]
        low = np.searchsorted(ranked, self.names, "left")
        high = np.searchsorted(ranked, self.above, "left")
        count = high - low
        hit = np.flatnonzero(count)
        # What the model cannot build is no edge.
        hit = hit[[self.merged_alone(str(name)) for name in self.names[hit]]] if len(hit) else hit
        which = np.repeat(hit, count[hit])
        within = np.arange(len(which)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
        return order[low[which] + within] + self.sizes[which], which

    def fitting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pieces, encoded together with what follows, stay apart; a character outside the vocabulary merges with nothing."""
        n = len(self.names)
        keys, place = np.unique(left * (n + 1) + right, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        fits, new = self.stay[at], np.flatnonzero(self.pairs[at] != keys)
        if len(new):
            fits[new] = [
                b == n or a == n or self.apart(self.listed[a], self.listed[b])
                for a, b in zip((keys[new] // (n + 1)).tolist(), (keys[new] % (n + 1)).tolist())]
            if len(self.pairs) > self.PAIRS:
                self.pairs, self.stay = self.pairs[:1], self.stay[:1]
            into = np.searchsorted(self.pairs, keys[new])
            self.pairs, self.stay = np.insert(self.pairs, into, keys[new]), np.insert(self.stay, into, fits[new])
        return fits[place]

    def learn(self, chunks: list[str]) -> None:
        """Segment chunks: one suffix array over all, then one relaxing pass over the positions of all chunks together."""
        text, outside = BORDER.join(chunks), len(self.names)
        length = np.array([len(chunk) for chunk in chunks])
        start = np.cumsum(length + 1) - length - 1
        end, which = self.edges(text)
        # A position where no piece ends: a character outside the vocabulary is an edge of its own.
        inner = np.ones(len(text) + 1, bool)
        inner[start] = False
        inner[end] = False
        lone = np.flatnonzero(inner)
        end, which = np.r_[end, lone], np.r_[which, np.full(len(lone), outside)]
        size = np.append(self.sizes, 1)
        home = np.zeros(len(text) + 1, np.int64)
        home[start[1:]] = 1
        level = end - start[np.cumsum(home)[end]]
        order = np.argsort(level, kind="stable")
        end, which = end[order], which[order]
        bounds = np.searchsorted(level[order], np.arange(1, int(length.max()) + 2))
        # The last piece on the path to each position; no path begins inside a chunk.
        last = np.full(len(text) + 1, -1)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            e, piece = end[a:b], which[a:b]
            i = e - size[piece]
            first = inner_start(i, start)
            ready = first | (last[i] >= 0)
            e, piece, i, first = e[ready], piece[ready], i[ready], first[ready]
            fits = first.copy()
            rest = np.flatnonzero(~first)
            fits[rest] = self.fitting(last[i[rest]], piece[rest])
            last[e[fits]] = piece[fits]
        on_path = np.zeros(len(text) + 1, bool)
        at, floor = start + length, start
        while len(at):
            on_path[at] = True
            at = at - size[last[at]]
            more = at > floor
            at, floor = at[more], floor[more]
        ends = np.flatnonzero(on_path)
        found = last[ends]
        ids = np.append(self.numbers, -1)[found].astype(np.int32)
        cuts = np.searchsorted(ends, np.append(start, len(text) + 1) + 1)
        strange = np.add.reduceat(np.append(found == outside, False), cuts[:-1]) > 0
        packed = ids.tobytes()
        for chunk, a, b, odd in zip(chunks, (4 * cuts[:-1]).tolist(), (4 * cuts[1:]).tolist(), strange.tolist()):
            self.chunks[chunk] = self.spelled(text, ends[a // 4 : b // 4], ids[a // 4 : b // 4]) if odd else packed[a:b]

    def spelled(self, text: str, ends: np.ndarray, ids: np.ndarray) -> bytes:
        """Ids of a path, with the bytes of characters outside the vocabulary."""
        out: list[int] = []
        for e, known in zip(ends.tolist(), ids.tolist()):
            out.extend([known] if known >= 0 else [self.byte[b] for b in text[e - 1].encode("utf-8", "surrogatepass")])
        return array("i", out).tobytes()

    def merged_alone(self, piece: str) -> bool:
        """Whether the model can build the piece at all."""
        if piece not in self.whole:
            self.whole[piece] = len(piece) == 1 or self.merged(piece) == [piece]
        return self.whole[piece]

    @staticmethod
    def split(text: str) -> list[str]:
        """Chunks of the marked text: each starts at a mark that does not follow a mark."""
        return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split(text) for text in texts]
        if len(self.chunks) > self.CHUNKS:
            # Chunks that are met again come back from the older half, so frequent ones are not lost.
            self.older, self.chunks = self.chunks, {}
        new = []
        for chunk in set(chain.from_iterable(split)).difference(self.chunks):
            known = self.older.get(chunk)
            if known is None:
                new.append(chunk)
            else:
                self.chunks[chunk] = known
        new.sort()
        size, part = 0, []
        for chunk in new:
            part.append(chunk)
            size += len(chunk)
            if size > self.LETTERS:
                self.learn(part)
                size, part = 0, []
        if part:
            self.learn(part)
        return [np.frombuffer(b"".join(map(self.chunks.__getitem__, chunks)), np.int32) for chunks in split]

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        text = out.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def codec(path: str) -> PieceCodec:
    return in_worker(("pieces", path), lambda: PieceCodec(path))


def piece_ids(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, n_tokens, ids, ids_crc32, round_trip``, one row per row of ``docs``.

    Null texts are empty and have no ids. ``round_trip``: the decoded ids are the text, with the word mark U+2581 read
    as a blank, which the model cannot tell apart. An empty table gives no rows.
    """
    ddl = "k1 long, n_chars long, n_tokens long, ids array<int>, ids_crc32 long, round_trip boolean"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, pieces = to_arrow(ddl), codec(model_path)
        for batch in slices(batches, 1 << 20):
            texts = batch.column("text").to_pylist()
            found = pieces.encode(texts)
            yield record(
                schema, batch.column("k1"), [len(t) for t in texts], [len(x) for x in found], [x.tolist() for x in found],
                [zlib.crc32(x.astype("<u4").tobytes()) for x in found],
                [pieces.decode(x) == t.replace(MARK, " ") for x, t in zip(found, texts)],
            )

    rows = keyed(docs, id_col, text_col).select("k1", "text")
    return rows.mapInArrow(emit, ddl).select(id_of().alias("doc_id"), *[c.split()[0] for c in ddl.split(", ")[1:]])
