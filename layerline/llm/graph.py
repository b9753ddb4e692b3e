"""Connected components of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from layerline.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that each node of the links ``a, b`` reaches.

    In each round every node points to its smallest neighbour or itself, and the pointers are followed to their ends by
    doubling; the links between different ends are the next round's. Each end has taken in another node, so the number of
    rounds is at most the logarithm of that of the nodes. Minima are combined before the shuffle. A node with most of the
    links makes one partition of the joins large, which AQE splits.
    """
    rounds = []
    pairs = _once(links)
    while not pairs.isEmpty():
        ends = _roots(pairs)
        rounds.append(ends)
        of_a, of_b = (ends.select(F.col("node").alias(x), F.col("label").alias(f"end_{x}")) for x in "ab")
        pairs = _once(pairs.join(of_a, "a").join(of_b, "b").select(F.col("end_a").alias("a"), F.col("end_b").alias("b")))
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    labels = rounds.pop()
    while rounds:
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        labels = stored(
            rounds.pop().join(later, "label", "left").select("node", F.coalesce("beyond", "label").alias("label")), "labels"
        )
    return labels


def _once(links: DataFrame) -> DataFrame:
    ordered = links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return stored(ordered.distinct(), "links")


def _roots(pairs: DataFrame) -> DataFrame:
    """``node, label``: where the pointers to the smallest neighbours end."""
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    pointers = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")),
        "pointers",
    )
    while True:
        further = pointers.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        followed = stored(
            pointers.join(further, "label").select("node", F.col("beyond").alias("label"), (F.col("label") != F.col("beyond")).alias("moved")),
            "pointers",
        )
        pointers = followed.select("node", "label")
        if followed.where("moved").isEmpty():
            return pointers
