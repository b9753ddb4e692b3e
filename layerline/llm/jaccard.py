"""N-gram Jaccard join by a token-group matrix, down to connected classes.

Texts with one set of shingles are one node. A node is queried by its prefix: its rarest shingles, as many as two linked
sets cannot both miss, each with its place in the order of rarity. The first shingle that two sets share bounds their
overlap: to what follows its place in either. The order comes from counts over all texts, not from those of one task. Each
node also has a mark, the parities of its shingles by hash: where two marks differ, one set has a shingle that the other has
not, so marks that differ in more bits than a link's sets may rule the pair out.

1. Nodes are partitioned into groups by their least shingle hash, which similar sets share. Each node is compared with the
   first of its group; the links give classes, the groups of the matrix.
2. The matrix holds for each token the classes whose union of prefixes has it. Tokens that one class alone holds are
   dropped at once: its members are connected already. Some rounds then compare each node with a few of other classes, so
   that classes of near copies merge before they are held against each other.
3. For each node and each other class the overlap is bounded from the places of a token in the node and in the class's
   union, and the difference from the bits that all or none of its members there have. A class whose bounds rule out a link
   with its least member in question is not opened.
4. Of an opened class the members are compared whose own bound, size, mark and number of common prefix tokens allow a link.
   3 and 4 go through the tokens in parts, few of them first: what links there merges, and is not opened for later tokens.

Every pair of nodes that may link is compared or already connected, so no class is split. Sets are sets of 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from layerline.llm.common import by_key, discard, id_of, in_worker, keyed, record, release, same_row, setting, slices, stored, text_bytes, to_arrow
from layerline.llm.graph import components
from layerline.llm.hashing import BASES, LOWER, Windows, mix, word_hashes, word_spans

#: Bytes of text hashed at once: the hashes take some 50 times as many.
MOST = 1 << 20
CELLS = 1 << 22
#: Texts that a worker gets at once; its rows are few where texts are long.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
#: Counters in one row.
TOGETHER = 1 << 12
#: Texts that one task compares with another.
PARTNERS = 512
#: Rounds in which each node meets others, and how many at most in one; classes that have merged by then need not be opened.
#: After two rounds the next one comes only if one in ``PAYING`` of the pairs has linked.
ROUNDS, MEMBERS, PAYING = 3, 4, 4
#: Parts of the tokens that are shuffled one after another, so that a part alone is on disk.
PARTS = 2
#: Where the parts of the tokens end, in 64ths, for which classes are opened one after another.
OPENED = (2, 64)
#: Compared texts are moved in as many parts as hold this share of all texts each, or a few.
SHARE, FEW = 0.125, 1 << 16
#: A mark of 512 bits.
MARK = [f"x{i}" for i in range(8)]
SETS = "k1 long, k2 binary, n long, s1 long, s2 long, group long, prefix array<long>, " + ", ".join(f"{x} long" for x in MARK)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lowered."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, words = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    windows = Windows(hashes, BASES[1])
    out = []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(windows(np.arange(a, b - width + 1), width)))
        else:
            short = windows(np.array([a]), b - a) + np.uint64(b - a) if b > a else np.zeros(0, np.uint64)
            out.append(short)
    return out


def cell_emitter(width: int):
    """Counters of shingles by hash. They only order the shingles by rarity: any order gives the same links."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("jaccard")
        counts = np.zeros(CELLS, np.int32)
        for batch in slices(batches, MOST):
            every = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(batch.column("text"), width)])
            np.add.at(counts, (every % np.uint64(CELLS)).astype(np.int64), 1)
        rows = np.minimum(counts, 0xFFFF).astype("<u2").reshape(-1, TOGETHER)
        held = np.flatnonzero(rows.any(axis=1))
        # Most cells of a task are empty or hold one.
        yield record(to_arrow("at int, counts binary"), held.astype(np.int32), [zlib.compress(rows[i], 1) for i in held])
        release()

    return emit


def cell_adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counters of all tasks added up, as steps of 1/2048 of a doubling."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, counts in zip(batch.column("at").to_pylist(), batch.column("counts")):
            whole = sums.setdefault(at, np.zeros(TOGETHER, np.int64))
            whole += np.frombuffer(zlib.decompress(counts.as_buffer()), "<u2")
    steps = [np.minimum(2048 * np.log2(1 + n), 0xFFFF).astype("<u2").tobytes() for n in sums.values()]
    yield record(to_arrow("at int, counts binary"), list(sums), steps)


def weights(rows: DataFrame, width: int) -> np.ndarray:
    """How frequent the shingles of each cell are in all texts; a fixed number of cells, 8 MB."""
    counted = rows.mapInArrow(cell_emitter(width), "at int, counts binary")
    added = counted.repartition("at").mapInArrow(cell_adder, "at int, counts binary").toArrow()
    weight = np.zeros((CELLS // TOGETHER, TOGETHER), np.uint16)
    for at, counts in zip(added.column("at").to_pylist(), added.column("counts")):
        weight[at] = np.frombuffer(counts.as_buffer(), "<u2")
    return weight.reshape(-1)


def marks(sets: list[np.ndarray]) -> np.ndarray:
    """The parity of each set's shingles in each of 512 parts of the hashes, one row of longs per set."""
    bits = np.zeros((len(sets), 64 * len(MARK)), np.uint8)
    for i, s in enumerate(sets):
        bits[i] = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=bits.shape[1]) & 1
    return np.packbits(bits, axis=1).view(np.int64)


def sets_emitter(width: int, percent: int, weight: np.ndarray):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("jaccard")
        schema = to_arrow(SETS)
        for batch in slices(batches, MOST):
            sets = shingle_sets(batch.column("text"), width)
            with np.errstate(over="ignore"):
                s1 = [int(mix(s ^ np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                s2 = [int(mix(s ^ np.uint64(2)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            group = [int(s[0].view(np.int64)) if len(s) else 0 for s in sets]
            chosen = []
            for s in sets:
                order = np.argsort(weight[(s % np.uint64(CELLS)).astype(np.int64)], kind="stable")
                chosen.append(s[order[: len(s) - -(-percent * len(s) // 100) + 1]].view(np.int64))
            ends = np.cumsum([0, *map(len, chosen)])
            flat = np.concatenate([np.zeros(0, np.int64), *chosen])
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield record(schema, batch.column("k1"), batch.column("k2"), [len(s) for s in sets], s1, s2, group, prefix, *marks(sets).T)
        release()

    return emit


def together(tables: list[DataFrame]) -> DataFrame:
    """The rows of several written tables."""
    return reduce(DataFrame.union, tables)


def link_emitter(width: int, percent: int):
    """Linked nodes, from rows sorted so that each group's own text comes before those it is compared with."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("jaccard")
        schema, now, own = to_arrow("a long, b long"), None, None
        for whole in batches:
            for batch in slices([whole], MOST):
                sets = shingle_sets(batch.column("text"), width)
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                linked = []
                for x, y, part, s in zip(a, b, batch.column("part").to_pylist(), sets):
                    if (x, part) != now:
                        now, own = (x, part), s
                    if x != y:
                        at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                        common = int((own[at] == s).sum())
                        if 100 * common >= percent * (len(own) + len(s) - common):
                            linked.append((x, y))
                yield record(schema, [x for x, _ in linked], [y for _, y in linked])
        release()

    return emit


def jaccard_classes(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per row of ``docs``; see ``keyed_classes``."""
    return keyed_classes(docs, width, percent, id_col, text_col).drop("text_key", "first")


def keyed_classes(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, text_key, first``, one row per row of ``docs``.

    ``first`` tells the row that stands for its class: the least by id, then by text key.

    Two texts link when their distinct ``width``-word shingles have a Jaccard similarity of at least ``percent``/100. A text
    with fewer words has its whole sequence as its one shingle. Without words a row is linked with nothing. Rows equal in
    id are nodes of their own and share the component with the smaller one only by links. A null id is the smallest.
    Equal rows are one node; long texts are whole in the memory of one task; other columns are not read.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be between 1 and 100")
    with setting(docs.sparkSession, *BATCH):
        return _classes(keyed(docs, id_col, text_col), width, percent)


def _classes(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """The same for rows ``k1, k2, text``."""
    weight = weights(rows, width)
    sets = stored(rows.mapInArrow(sets_emitter(width, percent, weight), SETS), "shingle_sets")
    total = sets.count()
    distinct = sets.where("n > 0").groupBy("s1", "s2", "n", "group").agg(
        F.min(F.struct("k1", "k2")).alias("r"), F.count("*").alias("copies"), *[F.first(x).alias(x) for x in MARK])
    # Numbered in the order of ids, so that the smallest number of a class is that of its smallest id.
    nodes = stored(
        distinct.select("r.k1", "r.k2", "s1", "s2", "n", "group", "copies", *MARK).orderBy("k1", "k2")
        .withColumn("node", F.monotonically_increasing_id()),
        "set_nodes",
    )

    count = nodes.count()
    stands = nodes.select("k1", "k2", "node")
    held = stored(sets.where("n > 0").join(stands, ["k1", "k2"]).select("node", "prefix"), "prefixes")
    # Rows that are equal in id and text.
    repeated = held.count() > count
    if repeated:
        held = held.dropDuplicates(["node"])

    def linked(pairs: DataFrame, label: str) -> DataFrame:
        """Those of the pairs ``a, b`` that link; a text that meets many is dealt over several tasks."""
        pairs = pairs if hasattr(pairs, "stored_at") else stored(pairs, f"pairs_{label}")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = nodes.join(ends, "node").select("k1", "k2", "node")
        # Else the texts of all rows are shuffled.
        texts = rows.join(F.broadcast(wanted) if pairs.count() <= FEW else wanted, ["k1", "k2"])
        texts = texts.groupBy("node").agg(F.first("text").alias("text")) if repeated else texts.select("node", "text")
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
        own = parts.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        sent = own.union(pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int")))
        turns = -(-max(1, 2 * pairs.count()) // max(FEW, int(SHARE * count)))
        if turns > 1:
            texts = stored(texts, f"texts_{label}")
        found = []
        for turn in range(turns):
            now = sent.where(F.pmod(F.xxhash64("a", "part", F.lit("turn")), F.lit(turns)) == turn) if turns > 1 else sent
            dealt = now.join(texts.withColumnRenamed("node", "b"), "b").select("a", "b", "part", "text")
            dealt = dealt.repartition("a", "part").sortWithinPartitions("a", "part", F.col("a") != F.col("b"))
            found.append(stored(dealt.mapInArrow(link_emitter(width, percent), "a long, b long"), f"links_{label}"))
        discard(pairs, *([texts] if turns > 1 else []))
        return together(found)

    def sized(n: str, m: str) -> Column:
        return 100 * F.least(n, m) >= percent * F.greatest(n, m)

    def takes(n: Column, m: Column) -> Column:
        """Common shingles that a link of sets of these sizes takes."""
        return F.floor((percent * (n + m) + (99 + percent)) / (100 + percent))

    def smallest_for(n: Column) -> Column:
        """Size of the smallest set that can link with one of n shingles."""
        return F.ceil(percent * n / 100)

    def near(bits: list[Column], n: Column, m: Column) -> Column:
        """Whether so many bits, which at least differ, leave a link of sets of these sizes possible."""
        return (100 + percent) * sum(map(F.bit_count, bits)) <= (100 - percent) * (n + m)

    def unlike(x: str, y: str) -> list[Column]:
        """Bits that differ between the marks below two prefixes."""
        return [F.col(x + i).bitwiseXOR(F.col(y + i)) for i in MARK]

    # The marks are many times a row of the matrix, so they are joined to what is left where they are looked at.
    marked_nodes = nodes.select("node", *MARK)

    def mixed(rows: DataFrame, *marked: str) -> DataFrame:
        """Rows ``token, node, n, bound, label`` of the tokens that several classes hold, and marks if wanted."""
        several = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
        left = rows.join(several.select("token"), "token", "left_semi")
        left = left.join(marked_nodes, "node") if marked else left
        return stored(left.select("token", "node", "n", "bound", "label", *marked), "matrix")

    centres = nodes.groupBy("group").agg(F.min(F.struct("node", "n", *MARK)).alias("c"))
    first = nodes.join(centres, "group").where(
        sized("n", "c.n") & (F.col("node") != F.col("c.node")) & near(unlike("", "c."), F.col("n"), F.col("c.n")))
    links = linked(first.select(F.col("c.node").alias("a"), F.col("node").alias("b")), "groups")
    labels = components(links)

    sizes = nodes.join(labels, "node", "left").select("node", "n", F.coalesce("label", "node").alias("label"))
    prefixes = held.select("node", F.posexplode("prefix").alias("place", "token"))
    # Each part is shuffled once, and what was shuffled is deleted before the next.
    at_token = Window.partitionBy("token")
    marked = prefixes.withColumn("low", F.min("node").over(at_token)).withColumn("high", F.max("node").over(at_token))
    several = marked.where("low != high").select("node", "place", "token")
    tokens = [stored(several.where(F.pmod(F.shiftrightunsigned("token", 20), F.lit(PARTS)) == part), "shared_tokens") for part in range(PARTS)]
    shared = together(tokens)
    # What follows a token's place is all that may be common when it is the first common one.
    matrix = mixed(shared.join(sizes, "node").withColumn("bound", (F.col("n") - F.col("place")).cast("int")))
    discard(*tokens)
    n, bound = F.col("n"), F.col("bound")

    for turn in range(ROUNDS):
        # A token stands for one node of its class of least label, drawn anew in each round. Each node meets those of
        # another class that it shares most tokens with.
        drawn = (F.xxhash64("node", F.lit(turn)) if turn else F.lit(0).cast("long")).alias("drawn")
        firsts = matrix.groupBy("token").agg(F.min(F.struct("label", drawn, "node", "n", "bound")).alias("f"))
        met = matrix.join(firsts, "token").where(
            (F.col("label") != F.col("f.label")) & (F.least(bound, "f.bound") >= takes(n, F.col("f.n"))) & sized("n", "f.n"))
        shared = met.groupBy("node", "n", F.col("f.node").alias("at"), F.col("f.n").alias("m")).agg(F.count("*").alias("shared"))
        theirs = marked_nodes.select(F.col("node").alias("at"), *[F.col(x).alias(f"its_{x}") for x in MARK])
        shared = shared.join(theirs, "at").join(marked_nodes, "node").where(near(unlike("", "its_"), n, F.col("m"))).select("node", "at", "shared")
        ranked = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("shared"), "at"))
        best = shared.withColumn("rank", ranked).where(F.col("rank") <= MEMBERS)
        best = stored(best.select(F.col("at").alias("a"), F.col("node").alias("b")), f"pairs_round_{turn}")
        tried = best.count()
        more = linked(best, f"round_{turn}")
        gained = more.count()
        if not gained:
            break
        links = links.union(more)
        labels = components(links)
        before, relabelled = matrix, matrix.drop("label").join(labels, "node", "left")
        matrix = mixed(relabelled.withColumn("label", F.coalesce("label", "node")))
        discard(before)
        if turn and PAYING * gained < tried:
            break

    def opened(matrix: DataFrame) -> DataFrame:
        """Rows ``token, node, n, bound, other`` and marks: the classes that may hold a link of the node by the token."""
        unions = matrix.groupBy("token", F.col("label").alias("other")).agg(
            F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("bound").alias("most"),
            *[F.bit_and(x).alias(f"all_{x}") for x in MARK], *[F.bit_or(x).alias(f"any_{x}") for x in MARK])
        may_hold = (F.col("most_n") >= smallest_for(n)) & (n >= smallest_for(F.col("least_n")))
        reaches = F.least(bound, "most") >= takes(n, F.greatest("least_n", smallest_for(n)))
        # Bits that all members have and the node has not, and those that it has and no member.
        beyond = [
            F.bitwise_not(F.col(x)).bitwiseAND(F.col(f"all_{x}")).bitwiseOR(F.col(x).bitwiseAND(F.bitwise_not(F.col(f"any_{x}")))) for x in MARK]
        largest = F.least("most_n", F.floor(100 * n / percent))
        met = matrix.join(unions, "token").where((F.col("label") != F.col("other")) & may_hold & reaches & near(beyond, n, largest))
        return stored(met.select("token", "node", "n", "bound", "other", *MARK), "opened")

    final, compared, begin = labels, None, 0
    for end in OPENED:
        # The first token that two sets share passes both bounds, so that nothing else of an opened class is looked at.
        at = F.pmod(F.shiftrightunsigned("token", 20), F.lit(64))
        part = matrix.where((at >= begin) & (at < end)).drop("label").join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
        begin = end
        part = mixed(part, *MARK)
        rows_opened = opened(part)
        members = part.select("token", F.col("node").alias("member"), F.col("n").alias("m"), F.col("bound").alias("its"), F.col("label").alias("other"), *[F.col(x).alias(f"its_{x}") for x in MARK])
        close = (
            rows_opened.join(members, ["token", "other"])
            .where((F.col("node") < F.col("member")) & sized("n", "m") & (F.least(bound, "its") >= takes(n, F.col("m")))
                   & near(unlike("", "its_"), n, F.col("m")))
        )
        close = close.select("node", "n", "member", "m").distinct()
        pairs = stored(close.join(compared, ["node", "member"], "left_anti") if compared is not None else close, "close")
        discard(rows_opened, part)
        if pairs.isEmpty():
            continue
        compared = pairs.select("node", "member") if compared is None else compared.union(pairs.select("node", "member"))
        # The prefix that ends first in the order of rarity holds all it shares with the other set inside the other's prefix,
        # so what it holds beyond is missing there. The prefix of the larger set allows the fewest.
        ends = pairs.select("node").union(pairs.select("member")).distinct()
        own = held.join(F.broadcast(ends) if pairs.count() <= FEW else ends, "node")
        other = own.select(F.col("node").alias("member"), F.col("prefix").alias("theirs"))
        common = pairs.join(own, "node").join(other, "member").withColumn("common", F.size(F.array_intersect("prefix", "theirs")))
        enough = F.col("common") > takes(n, F.col("m")) - smallest_for(F.greatest("n", "m"))
        more = linked(common.where(enough).select(F.col("node").alias("a"), F.col("member").alias("b")), "members")
        if not more.isEmpty():
            links = links.union(more)
            final = components(links)

    smallest = nodes.select(F.col("node").alias("label"), F.col("k1").alias("low"))
    known = stored(
        nodes.join(final, "node", "left").withColumn("label", F.coalesce("label", "node")).join(smallest, "label").select(
            "s1", "s2", "copies", "low", (F.col("label") == F.col("node")).alias("leads"), F.col("k1").alias("f1"), F.col("k2").alias("f2")),
        "classes",
    )
    classed = by_key(sets.select("k1", "k2", "n", "s1", "s2"), known, ["s1", "s2"], "copies", total)
    classed = classed.withColumn("component", F.coalesce("low", "k1")).withColumn(
        "first", F.when(F.col("leads").isNull(), True).otherwise(F.col("leads") & (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2"))))
    return classed.select(
        id_of().alias("doc_id"), F.col("n").alias("n_shingles"),
        id_of("component").alias("component_id"), F.col("k2").alias("text_key"), "first",
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their class, with all columns; of equal rows, each stays."""
    found = keyed_classes(docs, id_col=id_col, text_col=text_col, **options)
    kept = found.where("first")
    kept = kept.select(F.col("doc_id").alias("__kept_id"), F.col("text_key").alias("__kept_key")).distinct()
    return docs.join(kept, same_row(id_col, text_col), "left_semi")
