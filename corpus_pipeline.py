"""From raw documents to token ids: language, exact copies, near copies, mixture, encoding.

Each stage takes the rows that its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from layerline.llm.common import same_row
from layerline.llm.exact_copies import drop_copies
from layerline.llm.jaccard import one_of_each
from layerline.llm.language import held_out, language_id
from layerline.llm.mixing import TARGETS, labelled_domains, mix_to_targets
from layerline.llm.pieces import piece_ids
from layerline.llm.shipping import ship
from layerline.session import scratch_path

def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; the others go, and so do those without a letter."""
    ship(spark)
    training = spark.read.parquet(f"{sf_dir}/documents.parquet").where(~held_out())
    found = language_id(docs, training, calibrate=True).where("known")
    kept = found.select(F.col("doc_id").alias("__kept_id"), F.col("text_key").alias("__kept_key")).distinct()
    return docs.join(kept, same_row("doc_id", "text"), "left_semi")


def exact_copies_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    ship(spark)
    return drop_copies(docs, keep="largest")


def near_copies_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the smallest id stays."""
    ship(spark)
    return one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: none, one or several rows."""
    ship(spark)
    labelled = labelled_domains(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = mix_to_targets(docs, labelled, TARGETS, with_key=True).where("copies > 0")
    times = found.groupBy(F.col("doc_id").alias("__kept_id"), F.col("text_key").alias("__kept_key")).agg(F.max("copies").alias("__copies"))
    joined = docs.join(times, same_row("doc_id", "text"))
    repeated = joined.withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return repeated.select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with the check that they decode to it."""
    import public_tokenizers

    ship(spark)
    return piece_ids(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", known_language),
    ("exact_dedup", exact_copies_once),
    ("jaccard_join", near_copies_once),
    ("mixing", mixture),
    ("pieces", encoded),
]

#: The classifier, the classes of near copies and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
