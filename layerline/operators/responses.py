"""Landed responses: documents of the readable ones, and rejects with their file and text, from one parse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from layerline.operators.messages import MISSING, unreadable
from layerline.schemas import RESPONSE

_CORRUPT = "_corrupt"


def decode_responses(
    landed: DataFrame, schema: StructType = RESPONSE, array: str = "matches", keep: Sequence[str] = ()
) -> DataFrame:
    """One row per response, from ``value`` and ``source_file``; works alike on batch and streaming input. ``keep`` carries
    further fields of the envelope along.

    Adds ``error_reason``, null for a readable response, and ``raw_value``, its text. A response is readable when it is a
    JSON object whose array, if it has one, could be read; fields of the wrong type inside its documents are null. Blank
    lines are no responses.
    """
    text = landed.select("source_file", F.col("value").alias("raw_value")).where(F.col("raw_value").rlike(r"\S"))
    with_corrupt = StructType([*schema.fields]).add(_CORRUPT, "string")
    data = F.from_json("raw_value", with_corrupt, {"columnNameOfCorruptRecord": _CORRUPT})
    # Unfolded from a one-element array, so that no later filter makes Spark parse a text again.
    parsed = text.select("*", F.inline(F.array(data)))
    reason = F.when(F.col(array).isNull(), unreadable(F.col("raw_value"), F.col(_CORRUPT)))
    return parsed.select("source_file", *keep, array, reason.alias("error_reason"), "raw_value")


def unfold_responses(
    decoded: DataFrame, array: str = "matches", required: Sequence[str] = ("id",), keep: Sequence[str] = ()
) -> DataFrame:
    """One row per document and per reject: ``source_file``, ``position``, ``document``, ``error_reason``, ``raw_value``.

    A response that is not readable is one reject without a position, with its text. A document that lacks a required
    field is a reject with its place in the array and its own text. Readable responses without documents give no rows.
    """
    rows = F.transform(F.col(array), lambda document, at: _row(document, at, required))
    document = decoded.schema[array].dataType.elementType.simpleString()
    broken = F.array(F.struct(
        F.lit(None).cast("int").alias("position"), F.lit(None).cast(document).alias("document"),
        F.col("error_reason"), F.col("raw_value"),
    ))
    either = F.when(F.col("error_reason").isNotNull(), broken).otherwise(rows)
    return decoded.select("source_file", *keep, F.inline(either))


def _row(document: Column, at: Column, required: Sequence[str]) -> Column:
    lost = document.isNull()
    for name in required:
        lost = lost | document[name].isNull()
    return F.struct(
        at.alias("position"), document.alias("document"),
        F.when(lost, MISSING).alias("error_reason"),
        F.when(lost, F.coalesce(F.to_json(document), F.lit("null"))).alias("raw_value"),
    )


def good_documents(unfolded: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The documents, as ``normalize_matches`` takes them."""
    return unfolded.where("error_reason IS NULL").select(*keep, "document.*")


def document_rejects(unfolded: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return unfolded.where("error_reason IS NOT NULL").select("source_file", *keep, "position", "error_reason", "raw_value")


def reject_letters(rejected: DataFrame) -> DataFrame:
    """Rejected responses and documents as keyless dead letters with their file, place, text and reason."""
    body = F.struct(F.col("raw_value").alias("original_event"), "error_reason", "source_file", "position")
    return rejected.select(
        F.lit(None).cast("string").alias("key"), F.to_json(body, {"ignoreNullFields": "false"}).alias("value")
    )


def response_counts(decoded: DataFrame, array: str = "matches", by: Sequence[Column] = ()) -> DataFrame:
    """``outcome, responses, documents``: readable responses are ``ok``, the others under their reason."""
    held = F.when(F.col("error_reason").isNull(), F.coalesce(F.size(array), F.lit(0))).otherwise(0)
    return decoded.groupBy(*by, F.coalesce("error_reason", F.lit("ok")).alias("outcome")).agg(
        F.count("*").alias("responses"), F.sum(held).alias("documents")
    )
