"""The SQL answer to each query, written for DuckDB over the same tables."""

from __future__ import annotations

# Bronze-shaped match records, by the rules of FIXTURES.md.
M = """
m AS (
  SELECT
    CASE WHEN event_id % 89 <> 0 THEN CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') END AS event_id,
    CASE WHEN event_id % 97 <> 0 THEN CAST(user_id AS INTEGER) END AS match_id,
    CASE user_id % 7 WHEN 0 THEN 'PL' WHEN 1 THEN 'CL' WHEN 2 THEN 'BL1' WHEN 3 THEN 'SA'
                     WHEN 4 THEN 'PD' WHEN 5 THEN 'FL1' ELSE 'XX' END AS competition_code,
    CASE event_type WHEN 'signup' THEN 'SCHEDULED' WHEN 'view' THEN 'LIVE' WHEN 'click' THEN 'FINISHED'
                    WHEN 'purchase' THEN 'POSTPONED' WHEN 'error' THEN 'SUSPENDED' END AS status,
    CASE WHEN event_id % 101 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%dT%H:00:00Z') END AS utc_date,
    CAST(day(ts) AS INTEGER) AS matchday,
    CASE WHEN event_id % 53 <> 0 THEN CAST(user_id % 20 AS INTEGER) END AS home_team_id,
    'Team ' || CAST(user_id % 20 AS VARCHAR) AS home_team_name,
    CAST((user_id * 7 + 3) % 20 AS INTEGER) AS away_team_id,
    'Team ' || CAST((user_id * 7 + 3) % 20 AS VARCHAR)
      || CASE WHEN (user_id * 7 + 3) % 20 = 0 THEN ' FC' ELSE '' END AS away_team_name,
    CASE WHEN event_type IN ('view', 'click') THEN CAST(CAST(floor(value) AS BIGINT) % 4 AS INTEGER) END AS score_home,
    CASE WHEN event_type IN ('view', 'click') AND event_id % 13 <> 0
         THEN CAST(user_id % 4 AS INTEGER) END AS score_away,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ingested_at,
    COALESCE(CASE WHEN event_id % 97 <> 0 THEN CAST(user_id AS VARCHAR) END, 'unknown') AS kafka_key,
    CAST(user_id % 3 AS INTEGER) AS kafka_partition,
    event_id AS kafka_offset,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS kafka_timestamp,
    strftime(ts, '%Y-%m-%d') AS ingestion_date
  FROM events
)"""

EVENT = """event_id, match_id, competition_code, status, utc_date, matchday, home_team_id, home_team_name,
  away_team_id, away_team_name, score_home, score_away, ingested_at"""
META = "kafka_key, kafka_partition, kafka_offset, kafka_timestamp"

TIMES = """
    strftime(try_cast(utc_date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS match_timestamp,
    strftime(try_cast(utc_date AS DATE), '%Y-%m-%d') AS match_date"""


def _silver(source: str) -> str:
    return f"""
silver AS (
  SELECT * EXCLUDE (_rank), {TIMES}
  FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY kafka_offset DESC NULLS LAST) AS _rank
    FROM {source} WHERE event_id IS NOT NULL AND match_id IS NOT NULL
  ) WHERE _rank = 1
)"""


SILVER = _silver("m")

DIM = """
dim AS (
  SELECT home_team_id AS team_id, home_team_name AS team_name FROM silver WHERE home_team_id IS NOT NULL
  UNION
  SELECT away_team_id, away_team_name FROM silver WHERE away_team_id IS NOT NULL
)"""

RESULT = """
    CASE WHEN score_home IS NULL THEN NULL WHEN score_home > score_away THEN 'HOME_WIN'
         WHEN score_home < score_away THEN 'AWAY_WIN' ELSE 'DRAW' END AS result"""


def _fact(extra: str) -> str:
    return f"""
SELECT s.match_id, s.event_id, s.competition_code, s.matchday, s.home_team_id, h.team_name AS home_team_name,
  s.away_team_id, a.team_name AS away_team_name, s.score_home, s.score_away, {RESULT}, s.status,
  s.match_timestamp, s.match_date{extra}
FROM silver s
LEFT JOIN dim h ON s.home_team_id = h.team_id
LEFT JOIN dim a ON s.away_team_id = a.team_id"""


# Documents: the id is built again from the record id and the day; empty responses lie beside the full ones.
DOCUMENTS = f"""
d AS (
  SELECT CAST(match_id AS VARCHAR) || '-' || COALESCE(CASE WHEN event_id IS NOT NULL THEN ingestion_date END, '')
      AS event_id,
    match_id, competition_code, status, utc_date, matchday, home_team_id, home_team_name,
    away_team_id, away_team_name, score_home, score_away, kafka_offset
  FROM m
)"""
DOCUMENT_EVENTS = f"WITH {M}, {DOCUMENTS} SELECT * EXCLUDE (kafka_offset) FROM d"

# What becomes of each damaged message.
OUTCOME = """
    CASE WHEN kafka_offset % 20 = 1 THEN 'malformed_json'
         WHEN kafka_offset % 20 = 2 THEN 'empty_value'
         WHEN kafka_offset % 20 = 3 THEN 'not_an_object'
         WHEN kafka_offset % 20 = 4 AND match_id IS NOT NULL THEN 'wrong_type'
         WHEN event_id IS NULL OR match_id IS NULL THEN 'missing_required'
         ELSE 'ok' END AS outcome"""
JSON_VALUE = f"CAST(to_json(struct_pack({', '.join(f'{c.strip()} := {c.strip()}' for c in EVENT.split(','))})) AS VARCHAR)"

OUTCOMES = f"WITH {M} SELECT outcome, count(*) AS n FROM (SELECT {OUTCOME} FROM m) GROUP BY outcome"
DECODED = f"WITH {M} SELECT {EVENT}, {META} FROM m"

# Landed responses of five records each, and what becomes of them.
LANDED = f"""
r AS (
  SELECT d.*, kafka_offset // 5 AS sequence,
    CAST(row_number() OVER (PARTITION BY kafka_offset // 5 ORDER BY kafka_offset) - 1 AS INTEGER) AS position,
    CASE WHEN (kafka_offset // 5) % 1000 IN (7, 8) THEN 'files' ELSE 'lines' END AS layout,
    CASE WHEN (kafka_offset // 5) % 1000 = 8 THEN 'malformed_json'
         WHEN (kafka_offset // 5) % 20 IN (1, 2) THEN 'malformed_json'
         WHEN (kafka_offset // 5) % 20 = 3 THEN 'wrong_type'
         WHEN (kafka_offset // 5) % 20 = 4 THEN 'not_an_object'
         ELSE 'ok' END AS outcome
  FROM d
)"""
BY_RESPONSE = f"WITH {M}, {DOCUMENTS}, {LANDED}"

LINE = """l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
  l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate"""


def _check(rule: str, failures: str, rows: str, source: str) -> str:
    return f"""
SELECT '{rule}' AS rule, CAST({failures} AS BIGINT) AS failures, CAST(COALESCE({rows}, 0) AS BIGINT) AS rows_affected,
  {failures} = 0 AS passed FROM ({source})"""


def _unique(column: str, source: str) -> str:
    return _check(
        f"unique_{column}", "count(*)", "sum(n)",
        f"SELECT count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} HAVING count(*) > 1",
    )


def _not_null(column: str, source: str) -> str:
    return _check(f"not_null_{column}", "count(*)", "count(*)", f"SELECT 1 FROM {source} WHERE {column} IS NULL")


def _accepted(column: str, values: str, source: str) -> str:
    return _check(
        f"accepted_values_{column}", "count(*)", "sum(n)",
        f"SELECT count(*) AS n FROM {source} WHERE {column} NOT IN ({values}) GROUP BY {column}",
    )


# The accepted codes.
COMPETITIONS = "'PL', 'CL', 'BL1', 'SA', 'PD', 'FL1'"
STATUSES = "'SCHEDULED', 'LIVE', 'IN_PLAY', 'PAUSED', 'FINISHED', 'POSTPONED', 'CANCELLED'"
MATCH_CHECKS = " UNION ALL ".join([
    _unique("event_id", "m"),
    _not_null("event_id", "m"),
    _not_null("match_id", "m"),
    _not_null("competition_code", "m"),
    _accepted("competition_code", COMPETITIONS, "m"),
    _accepted("status", STATUSES, "m"),
])
ORDER_CHECKS = " UNION ALL ".join([
    _unique("o_orderkey", "orders"),
    _unique("o_custkey", "orders"),
    _not_null("o_orderdate", "orders"),
    _accepted("o_orderstatus", "'O', 'F'", "orders"),
])

LETTERS = f"""WITH {M}, sent AS (SELECT *, {JSON_VALUE} AS value, {OUTCOME} FROM m)
        SELECT kafka_key AS key, outcome AS error_reason,
          CASE outcome WHEN 'empty_value' THEN NULL
            WHEN 'malformed_json' THEN left(value, length(value) - 1)
            WHEN 'not_an_object' THEN '[' || value || ']'
            WHEN 'wrong_type' THEN replace(value, '"match_id":' || match_id, '"match_id":"' || match_id || '"')
            ELSE value END AS original_event
        FROM sent WHERE outcome <> 'ok'"""

ANSWERS = {
    "src_scan": f"SELECT {LINE}, CAST(year(l_shipdate) AS INTEGER) AS ship_year FROM lineitem",
    "src_documents": DOCUMENT_EVENTS,
    "norm_matches": DOCUMENT_EVENTS,
    "response_outcomes": f"""{BY_RESPONSE} SELECT layout, outcome, count(DISTINCT sequence) AS responses,
          CASE WHEN outcome = 'ok' THEN count(*) ELSE 0 END AS documents FROM r GROUP BY layout, outcome""",
    "document_rejects": f"""{BY_RESPONSE}
        SELECT DISTINCT layout, CASE WHEN sequence % 20 <> 2 THEN sequence END AS sequence,
          CAST(NULL AS INTEGER) AS position, outcome AS error_reason, CAST(NULL AS VARCHAR) AS utc_date
        FROM r WHERE outcome <> 'ok' AND sequence % 20 <> 2
        UNION ALL
        SELECT 'lines', NULL, NULL, outcome, NULL FROM r WHERE sequence % 20 = 2 GROUP BY sequence, outcome
        UNION ALL
        SELECT layout, sequence, position, 'missing_required', utc_date FROM r
        WHERE outcome = 'ok' AND match_id IS NULL""",
    "norm_several": f"""{BY_RESPONSE} SELECT * EXCLUDE (kafka_offset, sequence, position, layout, outcome)
          REPLACE (CASE WHEN sequence % 20 <> 5 THEN matchday END AS matchday)
        FROM r WHERE outcome = 'ok' AND match_id IS NOT NULL""",
    "select_matches": f"""WITH {M} SELECT {EVENT} FROM m
        WHERE competition_code IN ('PL', 'CL', 'BL1') AND status = 'SCHEDULED'""",
    "select_live": f"WITH {M} SELECT {EVENT} FROM m WHERE status = 'LIVE'",
    "select_match": f"WITH {M} SELECT {EVENT} FROM m WHERE match_id = 8",
    "counts_by_competition": f"WITH {M} SELECT competition_code, count(*) AS n FROM m GROUP BY competition_code",
    "msg_encode": f"WITH {M} SELECT kafka_key AS key, {JSON_VALUE} AS value FROM m",
    "msg_decode": DECODED,
    "rejects": OUTCOMES,
    "dead_letters": LETTERS,
    "clean_required": f"WITH {M} SELECT * FROM m WHERE event_id IS NOT NULL AND match_id IS NOT NULL",
    "dedup_latest": f"WITH {M}, {SILVER} SELECT * EXCLUDE (match_timestamp, match_date) FROM silver",
    "dedup_lineitem": f"""SELECT {LINE} FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC,
          l_linenumber DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC,
          l_linestatus DESC) AS _rank FROM lineitem) WHERE _rank = 1""",
    "silver_typed": f"WITH {M}, {SILVER} SELECT * FROM silver",
    "snk_silver": f"WITH {M}, {SILVER} SELECT * FROM silver",
    "silver_replaced": f"WITH {M}, {SILVER} SELECT * FROM silver",
    "silver_metrics": f"""WITH {M}, {SILVER}, c AS (
          SELECT (SELECT count(*) FROM m) AS rows_read,
            (SELECT count(*) FROM m WHERE event_id IS NOT NULL AND match_id IS NOT NULL) AS rows_clean,
            (SELECT count(*) FROM silver) AS rows_written)
        SELECT rows_read, rows_clean, rows_clean - rows_written AS duplicates_removed, rows_written,
          20 AS columns_written FROM c""",
    "gold_stg": f"""WITH {M}, {SILVER} SELECT event_id, match_id, competition_code, matchday, home_team_id,
          home_team_name, away_team_id, away_team_name, score_home, score_away, status, match_timestamp, match_date,
          ingested_at, kafka_partition, kafka_offset FROM silver""",
    "gold_dim": f"WITH {M}, {SILVER}, {DIM} SELECT team_id, team_name FROM dim ORDER BY team_name NULLS LAST",
    "gold_fct": f"WITH {M}, {SILVER}, {DIM} {_fact(', s.ingested_at')}",
    "gold_fct_buckets": f"WITH {M}, {SILVER}, {DIM} {_fact(', s.ingested_at')}",
    "case_result": f"WITH {M} SELECT kafka_offset, score_home, score_away, {RESULT} FROM m",
    "role_join_nation": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, o_custkey AS custkey,
          c_nationkey AS buyer_key, s_nationkey AS seller_key, b.n_name AS buyer_nation, v.n_name AS seller_nation
        FROM lineitem
        LEFT JOIN orders ON l_orderkey = o_orderkey
        LEFT JOIN customer ON o_custkey = c_custkey
        LEFT JOIN supplier ON l_suppkey = s_suppkey
        LEFT JOIN nation b ON c_nationkey = b.n_nationkey
        LEFT JOIN nation v ON s_nationkey = v.n_nationkey""",
    "dq_unique": f"""WITH {M} SELECT event_id, count(*) AS n FROM m WHERE event_id IS NOT NULL
        GROUP BY event_id HAVING count(*) > 1""",
    "dq_not_null": f"WITH {M} SELECT * FROM m WHERE match_id IS NULL",
    "dq_accepted": f"""WITH {M}
        SELECT 'competition_code' AS field, competition_code AS value, count(*) AS n FROM m
        WHERE competition_code NOT IN ({COMPETITIONS}) GROUP BY competition_code
        UNION ALL
        SELECT 'status', status, count(*) FROM m WHERE status NOT IN ({STATUSES}) GROUP BY status""",
    "dq_orders": ORDER_CHECKS,
    "dq_summary": f"WITH {M} {MATCH_CHECKS}",
    "dq_teams": f"WITH {M}, {SILVER}, {DIM} {_unique('team_id', 'dim')}",
    "st_bronze": DECODED,
    "st_restart": DECODED,
    "st_ingest": f"""WITH {M}, {DOCUMENTS} SELECT * EXCLUDE (kafka_offset),
          COALESCE(CAST(match_id AS VARCHAR), 'unknown') AS key FROM d
        WHERE competition_code IN ('PL', 'CL', 'BL1') AND status = 'SCHEDULED'""",
    "st_rejects": OUTCOMES,
    "st_delivery": LETTERS,
    "st_batches": DECODED,
    "st_counters": f"""WITH {M}, o AS (SELECT kafka_offset, {OUTCOME} FROM m)
        SELECT CAST(3 AS BIGINT) AS batches, count(*) AS total,
          count(*) FILTER (WHERE outcome = 'ok' AND kafka_offset % 20 <> 5) AS ok,
          count(*) FILTER (WHERE outcome = 'ok' AND kafka_offset % 20 = 5) AS repaired,
          count(*) FILTER (WHERE outcome <> 'ok') AS failed FROM o""",
    "st_silver": f"WITH {M}, {SILVER} SELECT * FROM silver",
    "st_documents": f"""{BY_RESPONSE}
        SELECT CAST(match_id AS VARCHAR) AS key, event_id, 'ok' AS outcome FROM r
        WHERE layout = 'lines' AND outcome = 'ok' AND match_id IS NOT NULL
        UNION ALL
        SELECT NULL, NULL, outcome FROM r WHERE layout = 'lines' AND outcome <> 'ok' GROUP BY sequence, outcome
        UNION ALL
        SELECT NULL, NULL, 'missing_required' FROM r WHERE layout = 'lines' AND outcome = 'ok' AND match_id IS NULL""",
    "bronze_compacted": f"WITH {M} SELECT * FROM m",
    "load_table": f"""WITH {M}, {SILVER} SELECT event_id, match_id, competition_code, matchday, home_team_id,
          home_team_name, away_team_id, away_team_name, score_home, score_away, status, match_timestamp, match_date,
          ingested_at, kafka_partition, kafka_offset FROM silver""",
    "end_to_end": f"WITH {M}, {DOCUMENTS}, {_silver('d')}, {DIM} {_fact('')}",
}
