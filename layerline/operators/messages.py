"""Keyed JSON messages: encode rows, decode values, set broken ones aside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from layerline.functions import all_present, json_text, message_key
from layerline.schemas import EVENT, MESSAGE_META, REQUIRED

# Reasons given to rows that do not decode in full.
EMPTY = "empty_value"
MALFORMED = "malformed_json"
NOT_OBJECT = "not_an_object"
WRONG_TYPE = "wrong_type"
MISSING = "missing_required"

_CORRUPT = "_corrupt"


def encode(
    df: DataFrame, key: str = "match_id", columns: Sequence[str] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """``key`` and JSON ``value`` columns, as the Kafka sink takes them; ``keep`` carries columns along."""
    return df.select(message_key(key).alias("key"), json_text(*(columns or df.columns)).alias("value"), *keep)


def unreadable(raw: Column, corrupt: Column) -> Column:
    """Why a text did not decode; null for one that did. It is parsed again only where it is corrupt."""
    cause = (
        F.when(F.get_json_object(raw, "$").isNull(), MALFORMED)
        .when(~raw.rlike(r"^\s*\{"), NOT_OBJECT)
        .otherwise(WRONG_TYPE)
    )
    empty = raw.isNull() | ~raw.rlike(r"\S")
    return F.when(empty, EMPTY).when(corrupt.isNotNull(), cause)


def _reason(clean: Column) -> Column:
    # The raw text is looked at only for broken rows.
    return F.when(~clean, F.coalesce(unreadable(F.col("raw_value"), F.col(_CORRUPT)), F.lit(MISSING)))


def decode(messages: DataFrame, schema: StructType = EVENT, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Decode message values; works alike on batch and streaming input.

    Returns every message: the schema's columns, the message metadata, ``error_reason`` (null for a
    clean row) and ``raw_value`` (kept only where there is a reason). A field of the wrong type is
    null and leaves the others; a value that is not a JSON object leaves all of them null.
    """
    text = messages.select(
        F.col("key").cast("string").alias("kafka_key"),
        *[F.col(name).alias(f"kafka_{name}") for name in ("partition", "offset", "timestamp")],
        F.col("value").cast("string").alias("raw_value"),
    )
    with_corrupt = StructType([*schema.fields]).add(_CORRUPT, "string")
    data = F.from_json("raw_value", with_corrupt, {"columnNameOfCorruptRecord": _CORRUPT})
    # Unfolding a one-element array keeps later filters above the parse. Over a plain projection they
    # would be pushed below it, and every message would be parsed again for each filtered field.
    parsed = text.select("*", F.inline(F.array(data)))
    clean = F.col(_CORRUPT).isNull() & all_present(required)
    return parsed.select(
        *schema.names,
        *MESSAGE_META.names,
        _reason(clean).alias("error_reason"),
        F.when(~clean, F.col("raw_value")).alias("raw_value"),
    )


def valid(decoded: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Decoded rows that have their required fields."""
    return decoded.where(all_present(required))


def rejects(decoded: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Decoded rows without their required fields: the complement of ``valid``."""
    return decoded.where(~all_present(required))


def outcome(required: Sequence[str] = REQUIRED, repaired_apart: bool = False) -> Column:
    """``ok`` for valid rows, the reason for the others; ``repaired`` for valid ones that lost a field of the wrong type, if
    they are to be told apart."""
    clean = F.col("error_reason").isNull() if repaired_apart else F.lit(True)
    return F.when(all_present(required), F.when(clean, "ok").otherwise("repaired")).otherwise(F.col("error_reason"))


def delivery_counts(decoded: DataFrame, required: Sequence[str] = REQUIRED, repaired_apart: bool = False) -> DataFrame:
    """Rows per outcome."""
    return decoded.groupBy(outcome(required, repaired_apart).alias("outcome")).agg(F.count("*").alias("n"))


def delivery_metrics(required: Sequence[str] = REQUIRED) -> list[Column]:
    """Counts of all, clean, repaired and failed rows, to be observed while rows pass by."""
    found = outcome(required, repaired_apart=True)
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(found == "ok").alias("ok"),
        F.count_if(found == "repaired").alias("repaired"),
        F.count_if(~all_present(required)).alias("failed"),
    ]


def dead_letters(rejected: DataFrame) -> DataFrame:
    """Rejects as messages holding the original text and the reason. A null key stays null, so that the sink deals such
    letters over all its partitions."""
    body = F.struct(F.col("raw_value").alias("original_event"), "error_reason")
    return rejected.select(F.col("kafka_key").alias("key"), F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))
