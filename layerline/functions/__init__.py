"""Column expressions of the match model. All are JVM-side built-ins."""

from layerline.functions.outcome import match_result
from layerline.functions.presence import all_present
from layerline.functions.text import json_text, message_key, utc_now_text, version_id
from layerline.functions.times import written_date, written_timestamp

__all__ = [
    "all_present", "json_text", "match_result", "message_key", "utc_now_text", "version_id", "written_date", "written_timestamp",
]
