"""Run a query and its SQL answer and compare the rows."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = ("nation", "customer", "supplier", "orders", "lineitem", "events")


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def answer_rows(con, sql: str) -> tuple[list[str], Counter]:
    names = [row[0] for row in con.execute(f"DESCRIBE {sql}").fetchall()]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = con.execute(sql).fetchall()
    return sorted(names), Counter(tuple(row[i] for i in order) for row in rows)


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(row) for row in df.select(*names).collect())
