"""Near copies among embeddings: tiles of vectors compared along their principal axes, leading axes first.

Equal vectors are one class, and only classes are compared. The principal axes and a tree of cuts along them come from a
bounded sample; they place the vectors in blocks and decide which products are tried first, not which links are found. Two
blocks are compared unless their boxes lie too far apart for any pair to reach the threshold. Within two blocks, products
grow by groups of axes, and rows, columns and pairs drop out as soon as the norms of the axes that are left cannot lift
their cosine to the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from layerline.llm.common import NO_ID, id_of, record, stored, to_arrow
from layerline.llm.graph import components

KEY_BYTES = 16
#: A product this near the threshold is taken again from the vectors as they are.
DOUBT = 1e-9
#: Axes that the boxes and the tree of cuts use.
BOX_AXES = 8
#: Numbers of the sample that the axes and cuts are fitted on: vectors times their components.
SAMPLE_NUMBERS = 1 << 22
MOST_LEAVES = 1 << 16
LEAST_SAMPLE_OF_A_CUT = 32
#: Partners that one task compares with a block.
PARTNERS = 4
ROWS = "vec_id long, key binary, vector binary"
SENT = "block long, target long, part int"
FOUND = "low long, key binary, links long, other_low long, other_key binary"


def usable_vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each row's components; None where the row or a component is null, or one is not finite, or all are zero."""
    values = column.flatten()
    lost = values.is_null().to_numpy(zero_copy_only=False)
    numbers = values.to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore"):
        bad = lost | ~np.isfinite(numbers)
        live = ~lost & (numbers != 0)
    found, start = [], 0
    for size in column.value_lengths().to_pylist():
        if size is None:
            found.append(None)
            continue
        end = start + size
        whole = not bad[start:end].any() and live[start:end].any()
        found.append(numbers[start:end] + 0 if whole else None)
        start = end
    return found


def row_emitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``ROWS``; equal vectors have equal keys, unusable ones have none."""
    schema = to_arrow(ROWS)
    for batch in batches:
        held = [None if v is None else v.tobytes() for v in usable_vectors(batch.column("vector"))]
        keys = [None if v is None else hashlib.sha256(v).digest()[:KEY_BYTES] for v in held]
        yield record(schema, batch.column("vec_id"), keys, held)


def matrix(vectors: pa.Array, kind: type) -> np.ndarray:
    """Rows of equal width as doubles, each scaled by a power of two so that no square over- or underflows."""
    rows = np.frombuffer(b"".join(v.as_py() for v in vectors), kind).astype(np.float64).reshape(len(vectors), -1)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


@dataclass
class Axes:
    """Principal axes of vectors of one width, and the tree of cuts along the first of them."""

    basis: np.ndarray
    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    first_leaf: int

    def along(self, rows: np.ndarray) -> np.ndarray:
        return unit(rows) @ self.basis

    def leaves(self, along: np.ndarray) -> np.ndarray:
        node = np.zeros(len(along), np.int64)
        while (inner := self.axis[node] >= 0).any():
            lower = along[np.arange(len(along)), self.axis[node]] < self.cut[node]
            node = np.where(inner, np.where(lower, self.left[node], self.right[node]), node)
        return self.first_leaf + self.left[node]


def fit_axes(sample: np.ndarray, of_all: float, leaf_rows: int, first_leaf: int, most_leaves: int) -> tuple[Axes, int]:
    """Axes from a sample of unit vectors, each of which stands for ``of_all`` vectors; and the number of leaves."""
    values, basis = np.linalg.eigh(sample.T @ sample)
    basis = basis[:, np.argsort(-values)]
    along = sample @ basis[:, :BOX_AXES]
    axis, cut, left, right, leaves = [], [], [], [], 0
    waiting = [(np.arange(len(along)), -1, 0)]
    while waiting:
        rows, parent, side = waiting.pop()
        me = len(axis)
        if parent >= 0:
            (right if side else left)[parent] = me
        spread = np.ptp(along[rows], axis=0) if len(rows) else np.zeros(1)
        wide = int(np.argmax(spread))
        split = (
            len(rows) * of_all > leaf_rows and len(rows) >= LEAST_SAMPLE_OF_A_CUT
            and leaves + len(waiting) + 2 <= most_leaves and spread[wide] > 0
        )
        middle = float(np.median(along[rows, wide])) if split else 0.0
        lower = along[rows, wide] < middle if split else None
        if not split or not lower.any():
            axis.append(-1), cut.append(0.0), left.append(leaves), right.append(leaves)
            leaves += 1
            continue
        axis.append(wide), cut.append(middle), left.append(0), right.append(0)
        waiting += [(rows[~lower], me, 1), (rows[lower], me, 0)]
    return Axes(basis, *(np.array(x) for x in (axis, cut, left, right)), first_leaf), leaves


def placer(axes: dict[int, Axes], kind: type, blocks: tuple[np.ndarray, np.ndarray] | None):
    """Without ``blocks`` the leaf and leading coordinates of each vector, with them its block and all that is compared."""
    item = np.dtype(kind).itemsize
    places = "leaf long, " + ", ".join(f"c{i} double" for i in range(BOX_AXES))
    schema = to_arrow("low long, key binary, size long, vector binary, block long" if blocks else places)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            widths = np.array([len(v.as_py()) // item for v in whole.column("vector")], np.int64)
            for width in np.unique(widths):
                batch = whole.filter(pa.array(widths == width))
                along = axes[int(width)].along(matrix(batch.column("vector"), kind))
                leaf = axes[int(width)].leaves(along)
                if blocks:
                    first, count = blocks
                    keys = np.frombuffer(b"".join(k.as_py() for k in batch.column("key")), np.uint64)[::2]
                    block = first[leaf] + (keys % count[leaf].astype(np.uint64)).astype(np.int64)
                    yield record(schema, *(batch.column(name) for name in ("low", "key", "size", "vector")), block)
                else:
                    led = np.zeros((len(along), BOX_AXES))
                    led[:, :width] = along[:, :BOX_AXES]
                    yield record(schema, leaf, *led.T)

    return emit, ", ".join(f"{f.name} {dict(int64='long', double='double', binary='binary')[str(f.type)]}" for f in schema)


def partner_emitter(leaf_of: np.ndarray, width_of: np.ndarray, low: np.ndarray, high: np.ndarray, far: float):
    """For each block the blocks that are sent to it, and itself once per part. Of two blocks one is sent to the other."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow(SENT)
        numbers = np.arange(len(leaf_of))
        for batch in batches:
            for a in batch.column("id").to_numpy():
                mine = leaf_of[a]
                gap = np.maximum(0, np.maximum(low - high[mine], low[mine] - high))
                near = (np.einsum("ij,ij->i", gap, gap) <= far) & (width_of == width_of[mine])
                goes_to_lower = (numbers + a) % 2 == 0
                partners = numbers[near[leaf_of] & (numbers != a) & (goes_to_lower == (numbers > a))]
                parts = np.arange(max(1, -(-len(partners) // PARTNERS)))
                block = np.r_[np.full(len(parts), a), partners]
                yield record(schema, block, np.full(len(block), a), np.r_[parts, np.arange(len(partners)) // PARTNERS])

    return emit


@dataclass
class Side:
    """Vectors of one side of a comparison; ``tails[s]`` are the norms of what follows the first s groups of axes."""

    rows: np.ndarray
    along: np.ndarray
    tails: list[np.ndarray]
    size: np.ndarray
    low: np.ndarray
    key: np.ndarray

    def part(self, chosen: slice) -> Side:
        return Side(self.rows[chosen], self.along[chosen], [t[chosen] for t in self.tails], self.size[chosen], self.low[chosen], self.key[chosen])


def groups_of_axes(width: int) -> list[int]:
    """Ends of the groups: 16 axes, then as many again as so far."""
    ends, end = [], 16
    while end < width:
        ends.append(end)
        end *= 2
    return [*ends, width]


def side_of(batch: pa.Table, axes: dict[int, Axes], kind: type) -> Side:
    rows = matrix(batch.column("vector").combine_chunks(), kind)
    along = np.ascontiguousarray(axes[rows.shape[1]].along(rows))
    tails = [np.sqrt(np.einsum("ij,ij->i", along[:, e:], along[:, e:])) for e in groups_of_axes(rows.shape[1])]
    number = lambda name: batch.column(name).to_numpy()
    return Side(rows, along, tails, number("size"), number("low"), np.array(batch.column("key").to_pylist(), object))


def linked_pairs(left: Side, right: Side, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs whose cosine is at least the threshold."""
    rows, columns = np.arange(len(left.low)), np.arange(len(right.low))
    sums, start, least = np.zeros((len(rows), len(columns))), 0, threshold - DOUBT
    ends = groups_of_axes(left.along.shape[1])
    for s, end in enumerate(ends):
        sums += left.along[rows, start:end] @ right.along[columns, start:end].T
        tail_l, tail_r = left.tails[s][rows], right.tails[s][columns]
        stay = sums.max(axis=1) >= least - tail_l * tail_r.max()
        if not stay.all():
            rows, sums, tail_l = rows[stay], sums[stay], tail_l[stay]
            if not len(rows):
                return rows, columns[:0]
        stay = sums.max(axis=0) >= least - tail_r * tail_l.max()
        if not stay.all():
            columns, sums, tail_r = columns[stay], sums[:, stay], tail_r[stay]
            if not len(columns):
                return rows[:0], columns
        start = end
        if end < ends[-1]:
            alive = sums >= least - tail_l[:, None] * tail_r
            if np.count_nonzero(alive) * 32 <= alive.size:
                # Few pairs are left: each grows on its own.
                r, c = np.nonzero(alive)
                sums, rows, columns = sums[r, c], rows[r], columns[c]
                for t in range(s + 1, len(ends)):
                    sums = sums + np.einsum("ij,ij->i", left.along[rows, start:ends[t]], right.along[columns, start:ends[t]])
                    start = ends[t]
                    alive = sums >= least - left.tails[t][rows] * right.tails[t][columns]
                    sums, rows, columns = sums[alive], rows[alive], columns[alive]
                return certain(left, right, rows, columns, sums, threshold)
    r, c = np.nonzero(sums >= least)
    return certain(left, right, rows[r], columns[c], sums[r, c], threshold)


def certain(left: Side, right: Side, rows: np.ndarray, columns: np.ndarray, sums: np.ndarray, threshold: float):
    doubt = np.flatnonzero(sums < threshold + DOUBT)
    a, b = left.rows[rows[doubt]], right.rows[columns[doubt]]
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    kept = np.ones(len(rows), bool)
    kept[doubt] = dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))) >= threshold
    return rows[kept], columns[kept]


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of ``a[i]`` and ``b[i]``; ``root`` holds the smallest member of each one's set."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root[:] = root[root]


def compare_emitter(axes: dict[int, Axes], kind: type, threshold: float, tile: int):
    """Rows ``FOUND``: per vector the rows linked with it here, and one vector that it reaches through those."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow(FOUND)
        own, counts, root, now, gathered = None, None, None, None, []

        def result(side: Side, links: np.ndarray, other: Side, reached: np.ndarray) -> pa.RecordBatch:
            some = np.flatnonzero(links)
            to = reached[some]
            return record(schema, side.low[some], side.key[some].tolist(), links[some], other.low[to], other.key[to].tolist())

        def weighed(at: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
            """Sums of ``weight`` by position, exact as long as no sum reaches 2^53."""
            return np.bincount(at, weight, n).astype(np.int64)

        def with_own(side: Side) -> pa.RecordBatch:
            rows, columns = linked_pairs(own, side, threshold)
            counts[:] += weighed(rows, side.size[columns], len(counts))
            first = np.full(len(side.low), len(root))
            np.minimum.at(first, columns, rows)
            merge(root, rows, first[columns])
            return result(side, weighed(columns, own.size[rows], len(side.low)), own, first)

        def open_own(part: int) -> None:
            nonlocal own, counts, root
            own = side_of(pa.Table.from_batches(gathered), axes, kind)
            gathered.clear()
            counts, root = np.zeros(len(own.low), np.int64), np.arange(len(own.low))
            if part:
                return
            for start in range(0, len(root), tile):
                rest, mine = own.part(slice(start, None)), own.part(slice(start, start + tile))
                rows, columns = linked_pairs(rest, mine, threshold)
                later = rows > columns
                rows, columns = rows[later] + start, columns[later] + start
                counts[:] += weighed(rows, own.size[columns], len(counts)) + weighed(columns, own.size[rows], len(counts))
                merge(root, rows, columns)

        def closed() -> pa.RecordBatch:
            return result(own, counts, own, root)

        for batch in batches:
            target, part, is_own = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("target", "part", "own"))
            change = (np.diff(target) != 0) | (np.diff(part) != 0) | (np.diff(is_own.astype(np.int8)) != 0)
            edges = np.r_[0, np.flatnonzero(change) + 1, len(batch)]
            for low, high in zip(edges[:-1], edges[1:]):
                if low == high:
                    continue
                at = (target[low], part[low])
                if at != now:
                    if now is not None:
                        if gathered:
                            open_own(now[1])
                        yield closed()
                    now, own = at, None
                if is_own[low]:
                    gathered.append(batch.slice(low, high - low))
                    continue
                if own is None:
                    open_own(now[1])
                for start in range(low, high, tile):
                    rows = batch.slice(start, min(tile, high - start))
                    yield with_own(side_of(pa.Table.from_batches([rows]), axes, kind))
        if now is not None:
            if gathered:
                open_own(now[1])
            yield closed()

    return emit


def linked_vectors(
    vectors: DataFrame,
    threshold: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = 4096,
    tile: int = 512,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``vectors``.

    Two rows link when the cosine of their vectors, in double precision, is at least ``threshold``; equal vectors always do.
    Null, empty and zero vectors and those with a null or non-finite component link with nothing; vectors of different
    widths do not link. A null id is the smallest: its component has a null id, and ``kept`` compares nulls as equal.
    Rows that share an id but not a vector are rows of their own, connected only by links. Other columns are not read.

    A task holds one block of about ``block_rows`` vectors and a tile of those that are sent to it. The axes and cuts are
    fitted on at most ``SAMPLE_NUMBERS`` numbers, drawn by hash; vectors of a width that the sample lacks are all
    compared. The cost is that of all pairs of blocks whose boxes are near, so it is quadratic where vectors lie close.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = vectors.sparkSession
    kind = np.float32 if vectors.select(vector_col).dtypes[0][1] == "array<float>" else np.float64
    held = F.col(vector_col) if kind is np.float32 else F.col(vector_col).cast("array<double>")
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), held.alias("vector"))
    made = given.mapInArrow(row_emitter, ROWS)
    rows = stored(made.select("vec_id", "key"), "vector_rows")
    classes = stored(
        made.where("key IS NOT NULL").groupBy("key").agg(
            F.min(F.coalesce("vec_id", F.lit(NO_ID))).alias("low"), F.count("*").alias("size"), F.first("vector").alias("vector")),
        "vector_classes",
    )
    found = stored(_compared(classes, kind, threshold, block_rows, tile), "vector_links")
    node = F.struct("low", "key")
    edges = found.select(node.alias("a"), F.struct(F.col("other_low").alias("low"), F.col("other_key").alias("key")).alias("b"))
    labels = components(edges.where("a != b")).select("node.key", F.col("label.low").alias("smallest"))
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = stored(
        classes.select("key", "low", "size").join(counts, "key", "left").join(labels, "key", "left").select(
            "key", "size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
            F.coalesce("smallest", "low").alias("component")),
        "vector_components",
    )
    # A class of more than a thousandth of the rows is hot; fewer than a thousand can be, so they are broadcast.
    hot = known.where(F.col("size") > max(1000, rows.count() // 1000)).select("key", "n_links", "component")
    sent = rows.join(F.broadcast(hot), "key", "left")
    done = sent.where("component IS NOT NULL OR key IS NULL")
    rest = sent.where("component IS NULL AND key IS NOT NULL").select("vec_id", "key")
    rest = rest.join(known.select("key", "n_links", "component"), "key")
    every = done.select("vec_id", "n_links", "component").union(rest.select("vec_id", "n_links", "component"))
    own_id = F.coalesce("vec_id", F.lit(NO_ID))
    labelled = every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", own_id).alias("k"))
    return labelled.select("vec_id", "n_links", id_of("k").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )


def _compared(classes: DataFrame, kind: type, threshold: float, block_rows: int, tile: int) -> DataFrame:
    spark = classes.sparkSession
    item = np.dtype(kind).itemsize
    widths = {int(w): n for w, n in classes.groupBy((F.length("vector") / item).cast("int").alias("w")).count().collect()}
    if not widths:
        return spark.createDataFrame([], FOUND)
    total = sum(widths.values())
    wanted = max(1, SAMPLE_NUMBERS // max(widths))
    share = min(1.0, wanted / total)
    drawn = classes.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000)).select("vector").toArrow()
    sample: dict[int, list] = {w: [] for w in widths}
    for v in drawn.column("vector"):
        sample[len(v.as_py()) // item].append(v)
    axes, leaves = {}, 0
    for w, n in sorted(widths.items()):
        fitted = unit(matrix(sample[w], kind)) if sample[w] else np.zeros((0, w))
        axes[w], more = fit_axes(fitted, n / max(1, len(fitted)), block_rows, leaves, max(1, MOST_LEAVES // len(widths)))
        leaves += more

    emit, ddl = placer(axes, kind, None)
    ends = [f(f"c{i}").alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(BOX_AXES)]
    n_rows = np.zeros(leaves, np.int64)
    low, high = np.full((leaves, BOX_AXES), np.inf), np.full((leaves, BOX_AXES), -np.inf)
    # One row per leaf, of which there are at most MOST_LEAVES and one per width.
    for row in classes.select("vector").mapInArrow(emit, ddl).groupBy("leaf").agg(F.count("*").alias("n"), *ends).collect():
        n_rows[row.leaf] = row.n
        low[row.leaf] = [row[f"low{i}"] for i in range(BOX_AXES)]
        high[row.leaf] = [row[f"high{i}"] for i in range(BOX_AXES)]
    low[n_rows == 0], high[n_rows == 0] = 9.0, 9.0
    blocks = -(-n_rows // block_rows)
    first = np.r_[0, np.cumsum(blocks)[:-1]]
    leaf_of = np.repeat(np.arange(leaves), blocks)
    width_of = np.concatenate([np.full(int((axes[w].axis < 0).sum()), w) for w in sorted(axes)])

    # Squared distance of unit vectors at the threshold.
    far = 2 - 2 * threshold + DOUBT
    sends = stored(
        spark.range(len(leaf_of)).mapInArrow(partner_emitter(leaf_of, width_of, low, high, far), SENT), "vector_partners"
    )
    groups = sends.where("block = target").count()
    emit, ddl = placer(axes, kind, (first, np.maximum(blocks, 1)))
    placed = classes.mapInArrow(emit, ddl)
    sent = placed.join(sends, "block").withColumn("own", F.col("block") == F.col("target"))
    dealt = sent.repartition(groups, "target", "part").sortWithinPartitions("target", "part", F.desc("own"))
    return dealt.mapInArrow(compare_emitter(axes, kind, threshold, tile), FOUND)
