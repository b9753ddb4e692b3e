"""Spelling variants: words one letter apart, found in tries of letter-group counts.

A word's counts per group of letters change by at most one surplus and one deficit when one letter is put in, left out or
replaced. Words that agree in length and in the counts of the leading groups share a cell; a cell is cut into tries of
bounded size over the counts of the other groups. Each word visits the cells that its budget reaches, and is searched
there depth first with what is left of the budget. Words at a reached leaf are compared letter by letter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from layerline.llm.common import record, slices, stored, to_arrow, whole_text

# One in so many words of a document loses a letter; least letters and occurrences of a word.
DAMAGED = 97
LEAST_LETTERS = 5
LEAST_TIMES = 3

#: Bytes of text that are split into words, and words of a task that are counted, before they are passed on.
PIECE = 1 << 20
HELD_WORDS = 1 << 19
COUNTED = "word string, n long"
PLACED = "cell binary, part int, member boolean, word string, n long"
NEAR = "word string, n_near long, form_n long, form string"

# In Latin-1, where a letter is one byte. Every byte but those of letters becomes a blank, A-Z their small letters.
LETTER_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256)
)
#: Letters by how often they are used, roughly. The first LEADING of them have a count each in the cell, the next ones up
#: to SINGLE a level each in the trie; the others and the letters beyond z share the last levels.
BY_USE = "etaoinsrhldcumfpgwybvkxjqz"
LEADING, SINGLE, SHARED = 5, 18, 6
LEVELS = SINGLE + SHARED - LEADING
GROUP = np.array([
    BY_USE.index(chr(b)) if chr(b) in BY_USE[:SINGLE] else SINGLE + b % SHARED for b in range(256)
])
#: Nodes of a trie with at most so many different counts are compared with the searched words in one table.
BUSHEL = 24
#: Counters of words by a checksum of their cell; cells that share one only have more parts, or visits in vain.
SLOTS = 1 << 18


def runs(text: str, piece: int = PIECE) -> Iterator[list[bytes]]:
    """Lower-cased runs of letters, in Latin-1, in lists that cover about ``piece`` letters; no run is cut."""
    clean = text.encode("latin-1", "replace").translate(LETTER_BYTES)
    start = 0
    while start < len(clean):
        end = clean.find(b" ", start + piece)
        end = len(clean) if end < 0 else end
        yield clean[start:end].split()
        start = end


def word_emitter(least_letters: int, damaged: int):
    """Rows ``COUNTED``: words of a task with their occurrences, a word possibly in several rows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held = to_arrow(COUNTED), Counter()

        def rows() -> pa.RecordBatch:
            made = record(schema, [word.decode("latin-1") for word in held], list(held.values()))
            held.clear()
            return made

        for batch in slices(batches, 1 << 23):
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                of_text = Counter()
                for part in runs(text.as_py()):
                    of_text.update(part)
                doc_id = doc_id.as_py()
                start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for run, n in of_text.items():
                    if len(run) < least_letters:
                        continue
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if h % damaged == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                        if len(run) < least_letters:
                            continue
                    held[run] += n
                if len(held) >= HELD_WORDS:
                    yield rows()
        yield rows()

    return emit


def group_counts(words: list[bytes]) -> np.ndarray:
    """A row of letter counts per word: first those of the cell, then those of the trie's levels."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    groups = GROUP[np.frombuffer(b"".join(words), np.uint8)]
    width = SINGLE + SHARED
    at = np.repeat(np.arange(len(words)), sizes) * width + groups
    return np.bincount(at, minlength=len(words) * width).reshape(-1, width).astype(np.int32)


def cell_name(length: int, counts: tuple[int, ...]) -> bytes:
    return np.array([length, *counts], np.int32).tobytes()


#: Changes of length and leading counts within the budget, that are above no change in their order: of two cells
#: near each other the words of the lower visit the upper.
STEPS = [
    step
    for change in product((-1, 0, 1), repeat=LEADING)
    if change.count(1) <= 1 and change.count(-1) <= 1
    for longer in (-1, 0, 1)
    # A letter that is put in or left out changes one count in all, a replaced one two or none.
    if (longer == 0 or change.count(-longer) == 0)
    for step in [(longer, *change)]
    if step > (0,) * (LEADING + 1)
]


def slot_of(cell: bytes) -> int:
    return zlib.crc32(cell) % SLOTS


def slot_emitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by the slot of their cell."""
    schema = to_arrow("slot int, n long")
    for batch in batches:
        found = Counter(slot_of(cell) for _, _, _, cell in cells_of(batch.column("word")))
        yield record(schema, list(found), list(found.values()))


def cells_of(column: pa.Array) -> Iterator[tuple[str, bytes, list[int], bytes]]:
    """Each word, also in Latin-1, with its leading counts and its cell."""
    for start in range(0, len(column), 2048):
        words = column.slice(start, 2048).to_pylist()
        raw = [word.encode("latin-1") for word in words]
        for word, short, counts in zip(words, raw, group_counts(raw)[:, :LEADING].tolist()):
            yield word, short, counts, cell_name(len(short), tuple(counts))


def cell_emitter(parts: np.ndarray):
    """Rows ``PLACED``: a word as a member of one part of its cell, and as a searched word in the parts after it and in
    those of the upper cells in reach. ``parts`` are the parts of the cells of each slot, none where no cell has it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow(PLACED)
        for whole in batches:
            for start in range(0, len(whole), 1024):
                batch, out = whole.slice(start, 1024), []
                for (word, short, counts, cell), n in zip(cells_of(batch.column("word")), batch.column("n").to_pylist()):
                    of_cell = int(parts[slot_of(cell)])
                    own = zlib.crc32(short) % of_cell
                    out.append((cell, own, True, word, n))
                    out += [(cell, p, False, word, n) for p in range(own + 1, of_cell)]
                    for longer, *change in STEPS:
                        near = cell_name(len(short) + longer, tuple(x + y for x, y in zip(counts, change)))
                        out += [(near, p, False, word, n) for p in range(parts[slot_of(near)])]
                yield record(schema, *zip(*out))

    return emit


def one_apart(a: bytes, b: bytes) -> bool:
    """Whether one letter put in, left out or replaced makes ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    at = 0
    if len(a) <= 48:
        for x, y in zip(a, b):
            if x != y:
                break
            at += 1
    else:
        # Halve the stretch that holds the first difference.
        low, high = 0, len(a)
        while low < high:
            at = (low + high + 1) // 2
            if a[:at] == b[:at]:
                low = at
            else:
                high = at - 1
        at = low
    if len(a) == len(b):
        return at < len(a) and a[at + 1:] == b[at + 1:]
    return len(b) - len(a) == 1 and a[at:] == b[at + 1:]


class Trie:
    """Members of one part of a cell by the counts of the trie's letter groups, level by level."""

    def __init__(self, members: list[bytes]):
        counts = group_counts(members)[:, LEADING:]
        order = np.lexsort(counts.T[::-1])
        counts = counts[order]
        new = np.r_[True, (counts[1:] != counts[:-1]).any(axis=1)] if len(counts) else np.zeros(0, bool)
        self.counts = counts[new]
        starts = np.flatnonzero(new)
        self.members = np.split(order, starts[1:])

    def search(self, counts: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Pairs of a leaf and the searched words that reach it. ``surplus`` and ``deficit`` are what each word may still
        have in excess of, and less than, the counts of a leaf."""
        if len(self.counts):
            yield from self._below(0, 0, len(self.counts), np.arange(len(counts)), counts, surplus, deficit)

    def _below(self, level, low, high, words, counts, surplus, deficit):
        if high - low <= BUSHEL or level == LEVELS:
            more = counts[words][:, None, level:] - self.counts[None, low:high, level:]
            up, down = np.maximum(more, 0).sum(axis=2), np.maximum(-more, 0).sum(axis=2)
            reached = (up <= surplus[:, None]) & (down <= deficit[:, None])
            for leaf in np.flatnonzero(reached.any(axis=0)):
                yield low + leaf, words[reached[:, leaf]]
            return
        values = self.counts[low:high, level]
        edges = np.r_[0, np.flatnonzero(np.diff(values)) + 1, high - low]
        own = counts[words, level]
        for first, last in zip(edges[:-1], edges[1:]):
            more = own - values[first]
            up, down = np.maximum(more, 0), np.maximum(-more, 0)
            stay = (up <= surplus) & (down <= deficit)
            if stay.any():
                yield from self._below(
                    level + 1, low + first, low + last, words[stay], counts, (surplus - up)[stay], (deficit - down)[stay]
                )


def near_emitter(batch_words: int):
    """Rows ``NEAR`` from rows ``PLACED`` sorted by cell, part and members first: for each word the near words found here,
    their number and the one with the most occurrences."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow(NEAR)
        now, members, trie, waiting = None, [], None, []
        found: dict[str, tuple[int, int, str]] = {}

        def note(word: str, other: str, n: int) -> None:
            count, best_n, best = found.get(word, (0, -1, ""))
            # Latin-1 letters order as their code points.
            better = n > best_n or n == best_n and other < best
            found[word] = (count + 1, n, other) if better else (count + 1, best_n, best)

        def search(searched: list, first_member: int | None = None) -> None:
            """Words against the members; members themselves, from a place on, meet only those behind them."""
            if trie is None:
                return
            counts = group_counts([raw for _, raw, _ in searched])
            home = np.frombuffer(now[0], np.int32)
            lead = counts[:, :LEADING] - home[1:]
            longer = np.array([len(raw) for _, raw, _ in searched]) - home[0]
            surplus, deficit = 1 - np.maximum(lead, 0).sum(axis=1), 1 - np.maximum(-lead, 0).sum(axis=1)
            # A longer word has only a surplus, a shorter one only a deficit.
            surplus, deficit = np.where(longer < 0, 0, surplus), np.where(longer > 0, 0, deficit)
            for leaf, at in trie.search(counts[:, LEADING:], surplus, deficit):
                for m in trie.members[leaf].tolist():
                    word, raw, n = members[m]
                    for w in at.tolist():
                        other, short, k = searched[w]
                        if (first_member is None or first_member + w < m) and one_apart(raw, short):
                            note(word, other, k)
                            note(other, word, n)

        def rows(least: int) -> Iterator[pa.RecordBatch]:
            if len(found) > least:
                n_near, form_n, form = zip(*found.values())
                yield record(schema, list(found), n_near, form_n, form)
                found.clear()

        def grown() -> None:
            """All members of a part are there: they are searched among themselves."""
            nonlocal trie
            if trie is None and members:
                trie = Trie([raw for _, raw, _ in members])
                for start in range(0, len(members), batch_words):
                    search(members[start:start + batch_words], start)

        def flush() -> None:
            if waiting:
                search(waiting)
                waiting.clear()

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("cell", "part", "member", "word", "n")]
            for cell, part, member, word, n in zip(*columns):
                if (cell, part) != now:
                    grown()
                    flush()
                    yield from rows(1 << 16)
                    now, trie = (cell, part), None
                    members.clear()
                entry = (word, word.encode("latin-1"), n)
                if member:
                    members.append(entry)
                    continue
                grown()
                waiting.append(entry)
                if len(waiting) >= batch_words:
                    flush()
                    yield from rows(1 << 16)
        grown()
        flush()
        yield from rows(0)

    return emit


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_letters: int = LEAST_LETTERS,
    least_times: int = LEAST_TIMES,
    damaged: int = DAMAGED,
    part_words: int = 16384,
    batch_words: int = 2048,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: one row per word of at least ``least_letters`` letters and ``least_times``
    occurrences in all texts.

    A run of letters, A-Z in lower case, loses one letter in the documents that its checksum picks: that of
    ``<doc_id>:<run>``, with nothing before the colon where the id is null. ``form`` is the near word, one letter put in,
    left out or replaced, with the most occurrences, of equal ones the smallest in code-point order, where it has at least
    twice those of the word; ``root`` is where the forms lead. Null and empty texts have no words; each of several equal
    rows counts; long texts are split piece by piece; other columns are not read. Without words there are no rows.

    A task holds one trie of about ``part_words`` members and ``batch_words`` searched words.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    counted = texts.mapInArrow(word_emitter(least_letters, damaged), COUNTED).groupBy("word").agg(F.sum("n").alias("n"))
    words = stored(counted.where(F.col("n") >= least_times), "words")
    near = stored(_near(words, part_words, batch_words), "near_words")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    per_word = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    leads = -F.col("best.less") >= 2 * F.col("n")
    formed = stored(
        words.join(per_word, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("best.form")).alias("form"),
            F.when(leads, -F.col("best.less")).alias("form_n")),
        "formed_words",
    )
    roots = _roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _near(words: DataFrame, part_words: int, batch_words: int) -> DataFrame:
    parts = np.zeros(SLOTS, np.int32)
    # At most SLOTS rows.
    for slot, n in words.select("word").mapInArrow(slot_emitter, "slot int, n long").groupBy("slot").agg(F.sum("n")).collect():
        parts[slot] = -(-n // part_words)
    placed = words.select("word", "n").mapInArrow(cell_emitter(parts), PLACED)
    dealt = placed.repartition("cell", "part").sortWithinPartitions("cell", "part", F.desc("member"))
    return dealt.mapInArrow(near_emitter(batch_words), NEAR)


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last of the words that the forms lead to. Occurrences double on the way, so it is short, and
    the pointers are followed by doubling."""
    pointers = forms.select("word", F.col("form").alias("root"))
    while True:
        further = pointers.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        followed = stored(
            pointers.join(further, "root", "left").select(
                "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")),
            "roots",
        )
        pointers = followed.select("word", "root")
        if followed.where("moved").isEmpty():
            return pointers
