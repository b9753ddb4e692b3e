"""One query per operator over its whole table, the pipeline, and the SQL answers where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from layerline.llm.exact_copies import exact_copies
from layerline.llm.jaccard import jaccard_classes
from layerline.llm.language import held_out, language_id
from layerline.llm.lexical import lexical_search
from layerline.llm.mixing import TARGETS, labelled_domains, mix_to_targets
from layerline.llm.pieces import piece_ids
from layerline.llm.quality import quality_rules
from layerline.llm.repeats import repeated_strings, repeated_words
from layerline.llm.secrets import secret_scan
from layerline.llm.shipping import ship
from layerline.llm.spelling import spelling_variants
from layerline.llm.token_files import read_token_files, write_token_files
from layerline.llm.vectors import linked_vectors
from layerline.session import scratch_path

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ANSWERS: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[run.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(documents(spark, sf_dir))


@query
def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_words(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", "n_spans")


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_id(docs, docs.where(~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op6_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(documents(spark, sf_dir), keep="largest")


LLM_ANSWERS["op6_content_sort"] = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


@query
def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = piece_ids(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_chars", "n_tokens", "ids_crc32", "round_trip")


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token_files")
    write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_token_files(spark, path)


@query
def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix_to_targets(docs, labelled_domains(docs, labels), TARGETS)


@query
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


LLM_ANSWERS["op11_lexical"] = r"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
),
item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
lengths AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
times AS (
  SELECT doc_id, term, count(*) AS tf
  FROM doc_terms WHERE term IN (SELECT term FROM item_terms) GROUP BY doc_id, term
),
weights AS (
  SELECT term, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM times, corpus GROUP BY term
),
impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS part
  FROM times JOIN lengths USING (doc_id) JOIN weights USING (term), corpus
),
scores AS (
  SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM item_terms JOIN impacts USING (term) GROUP BY item_id, doc_id
),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""


@query
def op12_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


LLM_ANSWERS["op12_vectors"] = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v
  FROM embeddings
  WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
),
classes AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN classes ON vec_id = classes.a LEFT JOIN counts ON vec_id = counts.a
"""


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
