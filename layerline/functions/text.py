from __future__ import annotations

from pyspark.sql import Column, functions as F


def version_id(record_id: str, version: str) -> Column:
    """``id-version``; an absent version leaves ``id-``, an absent id gives null."""
    return F.concat(F.col(record_id).cast("string"), F.lit("-"), F.coalesce(F.col(version), F.lit("")))


def message_key(column: str, default: str = "unknown") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(default))


def json_text(*columns: str) -> Column:
    """The columns as one JSON object, with null fields kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def utc_now_text() -> Column:
    """Processing time as ISO-8601 text in UTC, whatever the session zone is."""
    seconds = F.unix_micros(F.current_timestamp()).cast("decimal(18,0)") / F.lit(1_000_000)
    # Counted from a zoneless epoch: through the session zone, its clock changes would show.
    utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    written = F.translate(utc.cast("string"), " ", "T")
    # Text of a time leaves out trailing zeros of its fraction; here it always has six digits.
    whole = F.when(F.length(written) == 19, F.concat(written, F.lit("."))).otherwise(written)
    return F.concat(F.rpad(whole, 26, "0"), F.lit("+00:00"))
