"""Secret scan with corpus-wide ownership.

Patterns find the base spans. The values of these and of bare random-looking tokens are hashed, and each hash is counted
by distinct repositories and distinct owners. A value that one owner alone uses looks live; one that many owners have is a
copied example. Bare tokens equal to an owner-specific value are added as spans of kind ``live``; base spans always stay.
A bare token ends at ``=``, but for padding at its end, so a value counts alike with a name before it and without one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from layerline.llm.common import record, slices, stored, whole_text

# The patterns of the three base kinds and their least lengths.
ASSIGN = re.compile(r"""((?:(?ai:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
BARE = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")


def scan(text: str) -> list[tuple[int, int, int, int]]:
    """Start, rank of kind, end and value hash of each base span, by start and then kind."""
    found = []
    for rank, (_, pattern, group, least) in enumerate(KINDS):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, m.end(), value_hash(m.group(group))))
    return sorted(found)


def bare_tokens(text: str) -> list[tuple[int, int, int]]:
    """Start, end and value hash of tokens of letters and digits with at least three bits per character."""
    out = []
    for m in BARE.finditer(text):
        token = m.group()
        if any(c.isdigit() for c in token) and any(c.isalpha() for c in token):
            n = len(token)
            if -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= 3:
                out.append((m.start(), m.end(), value_hash(token)))
    return out


def outside(bare: list[tuple[int, int, int]], base: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """The bare tokens that no base span covers; both are in order of their starts."""
    out, reach, i = [], 0, 0
    for token in bare:
        while i < len(base) and base[i][0] <= token[0]:
            reach, i = max(reach, base[i][2]), i + 1
        if token[1] > reach:
            out.append(token)
    return out


def value_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("doc_id", pa.int64()), ("repository", pa.string()), ("owner", pa.string()), ("n_assign", pa.int64()),
        ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()),
        ("held", pa.list_(pa.struct([
            ("hash", pa.int64()), ("bare", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]))),
    ])
    for batch in slices(batches, 4 << 20):
        columns = [[] for _ in range(5)]
        for text in batch.column("text").to_pylist():
            found = scan(text)
            places: dict[int, list[dict]] = {h: [] for *_, h in found}
            for s, e, h in outside(bare_tokens(text), found):
                places.setdefault(h, []).append({"start": s, "end": e})
            for i in range(3):
                columns[i].append(sum(rank == i for _, rank, _, _ in found))
            columns[3].append(",".join(f"{KINDS[rank][0]}:{s}:{e}" for s, rank, e, _ in found))
            columns[4].append([{"hash": h, "bare": places[h]} for h in sorted(places)])
        yield record(schema, batch.column("doc_id"), batch.column("repository"), batch.column("owner"), *columns)


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "source", owner_col: str = "source",
    most_repositories: int = 1, most_owners: int = 1,
) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied``, one row per row of ``docs``.

    A value is live when at most ``most_repositories`` repositories and ``most_owners`` owners hold it. ``n_live`` and
    ``n_copied`` count a row's values that are live and the others.
    Null texts are empty, and a text has its base spans whatever its length; a bare token inside one is no span of its own.
    Rows equal in id and text count once per repository and owner. A null owner or repository counts as one more of its kind. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(repository_col).cast("string"), F.lit("")).alias("repository"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        whole_text(text_col).alias("text"),
    )
    ddl = (
        "doc_id long, repository string, owner string, n_assign long, n_access long, n_hex long, base string, "
        "held array<struct<hash: long, bare: array<struct<start: long, end: long>>>>"
    )
    found = stored(rows.mapInArrow(scan_rows, ddl), "secret_candidates")
    none = F.size("held") == 0
    some = found.where(~none).withColumn("row", F.xxhash64("doc_id", "base", "held"))
    values = some.select("row", "doc_id", "repository", "owner", F.explode("held").alias("value")).withColumn("hash", F.col("value.hash"))
    owners = (
        values.select("hash", "owner", "repository").distinct()
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))
        .select("hash", F.expr(f"n_owners <= {int(most_owners)} AND n_repositories <= {int(most_repositories)}").alias("is_live"))
    )
    judged = (
        values.select("row", "doc_id", "hash", "value.bare").distinct().join(owners, "hash").groupBy("doc_id", "row")
        .agg(
            F.flatten(F.collect_list(F.when(F.col("is_live"), F.col("bare")))).alias("live"),
            F.count_if("is_live").alias("n_live"),
            F.count_if(~F.col("is_live")).alias("n_copied"),
        )
        .select(F.col("doc_id").alias("id"), F.col("row").alias("id_row"), "live", "n_live", "n_copied")
    )
    joined = some.join(judged, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("id_row")), "left")
    base = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    spans = F.transform(base, lambda s: F.struct(
        F.split(s, ":")[1].cast("long").alias("start"),
        F.array_position(F.array(*[F.lit(k[0]) for k in KINDS]), F.split(s, ":")[0]).alias("rank"),
        s.alias("span"),
    ))
    added = F.transform(
        "live",
        lambda b: F.struct(b["start"].alias("start"), F.lit(len(KINDS) + 1).cast("long").alias("rank"), F.concat(F.lit("live:"), b["start"], F.lit(":"), b["end"]).alias("span")),
    )
    listed = F.array_join(F.transform(F.sort_array(F.concat(spans, added)), lambda s: s["span"]), ",")
    counts = ("n_assign", "n_access", "n_hex")
    sha = F.sha2(F.col("base"), 256).alias("base_sha256")
    with_values = joined.select("doc_id", *counts, sha, listed.alias("spans"), F.col("n_live").cast("long").alias("n_live"), F.col("n_copied").cast("long").alias("n_copied"))
    zero = F.lit(0).cast("long")
    return with_values.unionByName(found.where(none).select("doc_id", *counts, sha, F.col("base").alias("spans"), zero.alias("n_live"), zero.alias("n_copied")))
