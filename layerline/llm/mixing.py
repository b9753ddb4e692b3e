"""Soft-membership mixing to target weights, in DataFrame functions only.

A naive Bayes classifier over hashed words, counted over the whole labelled table, gives each document its posterior over
domains. Projected-gradient least squares then fits nonnegative document rates whose expected tokens per domain match
the targets; each step is one aggregate over the written posteriors and returns one number per domain to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from layerline.llm.common import stored, text_key, whole_text
from layerline.llm.quality import let, words_of

BUCKETS = 1024
#: Weights of the domains of labelled documents: those of good quality and the others.
TARGETS = {"good": 0.9, "poor": 0.1}
#: A miss of a domain's tokens, as a share of what it has, that counts as none.
TOLERANCE = 1e-3


def labelled_domains(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000) -> DataFrame:
    """``text, domain`` of about ``most_labels`` labelled documents at most, drawn by a hash of their ids.

    The ids drawn are broadcast, so that texts are read where they lie.
    """
    domain = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL")
    share = min(1.0, most_labels / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id").select("text", "domain")


def buckets_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(BUCKETS)).cast("int"))


def weights(labelled: DataFrame, domains: list) -> DataFrame:
    """One row: for each word bucket the log share of it in each domain, and the log priors (bounded: buckets x domains)."""
    exploded = labelled.select("domain", F.explode(buckets_of(words_of(F.col("text")))).alias("bucket"))
    counts = exploded.groupBy("bucket").agg(*[F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)])
    every = labelled.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").fillna(0)
    row = full.agg(
        F.sort_array(F.collect_list(F.struct("bucket", *[f"n{i}" for i in range(len(domains))]))).alias("cells"),
        *[F.sum(f"n{i}").alias(f"t{i}") for i in range(len(domains))],
    )
    priors = labelled.groupBy().agg(*[F.count_if(F.col("domain") == d).alias(f"p{i}") for i, d in enumerate(domains)])
    table = F.transform("cells", lambda c: F.array(*[
        F.log((c[f"n{i}"] + 1.0) / (F.col(f"t{i}") + float(BUCKETS))) for i in range(len(domains))]))
    prior = F.array(*[F.log(F.col(f"p{i}") + 1.0) for i in range(len(domains))])
    one = F.lit(1).alias("one")
    return row.select("*", one).join(priors.select("*", one), "one").select("one", table.alias("weights"), prior.alias("prior"))


def posterior(words: Column, table: Column, prior: Column) -> Column:
    """Posteriors from mean word evidence times the root of the length, so that long texts stay soft."""
    scores = F.aggregate(
        buckets_of(words), F.transform(prior, lambda p: p * 0.0),
        lambda s, b: F.zip_with(s, F.get(table, b), lambda x, w: x + w),
    )
    scale = F.sqrt(F.greatest(F.size(words), F.lit(1)))
    return let(F.zip_with(scores, prior, lambda s, p: s / scale + p), lambda z: let(
        F.array_max(z), lambda top: let(F.transform(z, lambda x: F.exp(x - top)), lambda e: let(
            F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: F.round(x / total, 6))))))


def rates(steps: list[list[float]]) -> Column:
    """A document's rate after the steps taken so far, each clipped at nothing."""
    rate = F.lit(1.0)
    if not steps:
        return rate
    history = F.array(*[F.array(*[F.lit(float(g)) for g in step]) for step in steps])
    return F.aggregate(history, rate, lambda r, g: F.greatest(
        F.lit(0.0), r - F.aggregate(F.zip_with(F.col("posterior"), g, lambda p, x: p * x), F.lit(0.0), lambda s, x: s + x)))


def mix_to_targets(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id",
    text_col: str = "text", steps: int = 100, most_domains: int = 64, with_key: bool = False,
) -> DataFrame:
    """``doc_id, n_tokens, posterior, rate, copies, miss, reached``, one row per row of ``docs``; ``with_key`` adds ``text_key``.

    ``miss`` is the largest miss of a domain's expected tokens as a share of all tokens, alike in all rows, and ``reached``
    whether it is within ``TOLERANCE``. Steps end there, or where they no longer bring the totals nearer, as for targets that
    no nonnegative rates meet, or after ``steps``: the rates of the nearest totals are returned.

    ``labelled`` has ``text, domain``; rows with a null domain are left out. ``targets`` gives each domain's weight
    (default: equal); the token total stays that of the input. A rate's whole part gives copies for sure, and its
    fraction one more by a hash of the row. Texts without words have no tokens, the prior as posterior and a rate by it.
    Without any label all rates are 1. More than ``most_domains`` domains are refused.
    """
    labelled = labelled.where(F.col("domain").isNotNull()).select(F.col("domain").cast("string"), whole_text("text").alias("text"))
    domains = [r[0] for r in labelled.select("domain").distinct().orderBy("domain").limit(most_domains + 1).collect()]
    if len(domains) > most_domains:
        raise ValueError(f"more than {most_domains} domains: raise most_domains")
    text = whole_text(text_col)
    key = ["text_key"] * with_key
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *[text_key(text).alias(k) for k in key])
    draw = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)).alias("draw")
    if not domains:
        return rows.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"),
                           F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"),
                           F.lit(0.0).alias("miss"), F.lit(True).alias("reached"), *key)
    # One row of BUCKETS x domains numbers.
    model = stored(weights(labelled, domains), "mixing_weights")
    scored = stored(
        rows.withColumn("one", F.lit(1)).join(F.broadcast(model), "one").select("doc_id", *key, draw, let(words_of(F.col("text")), lambda w: F.struct(
            F.size(w).cast("long").alias("n_tokens"), posterior(w, F.col("weights"), F.col("prior")).alias("posterior"))).alias("s"))
        .select("doc_id", *key, "draw", "s.*"),
        "posteriors",
    )
    span = range(len(domains))

    def totals(taken: list[list[float]]) -> list[float]:
        weighted = scored.select("n_tokens", "posterior", rates(taken).alias("rate"))
        row = weighted.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col("posterior")[i]).alias(f"s{i}") for i in span]).first()
        return [float(v or 0.0) for v in row]

    have = totals([])
    whole = sum(have)
    share = targets or {d: 1.0 for d in domains}
    wanted = [float(share.get(d, 0.0)) for d in domains]
    if sum(wanted) <= 0 or min(wanted) < 0:
        raise ValueError("targets must be nonnegative and weigh a known domain")
    goal = [whole * w / sum(wanted) for w in wanted]
    taken: list[list[float]] = []
    now, since, best, nearest = have, 0, 0, float("inf")
    while True:
        miss = max((abs(x - g) for x, g in zip(now, goal)), default=0.0) / whole if whole else 0.0
        if miss < nearest * (1 - 1e-3):
            nearest, best, since = miss, len(taken), 0
        else:
            since += 1
        # The objective is the squared miss over each domain's own tokens, which bounds the curvature by one.
        gradient = [round((now[i] - goal[i]) / have[i], 6) if have[i] else 0.0 for i in span]
        if miss <= TOLERANCE or since >= 5 or len(taken) >= steps or not any(gradient):
            break
        taken.append(gradient)
        now = totals(taken)
    taken = taken[:best]
    rate = F.round(rates(taken), 6)
    return scored.withColumn("rate", rate).select(
        "doc_id", "n_tokens", "posterior", "rate",
        (F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("long")).cast("long").alias("copies"),
        F.lit(float(nearest)).alias("miss"), F.lit(nearest <= TOLERANCE).alias("reached"), *key,
    )
