"""Runs registered queries and their SQL over one folder of tables and compares the rows."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings transcript_turns calls live_assist_state documents_registry chunks bm25_docs known_names mix_targets token_budgets".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def both(spark, query, sql: str, sf_dir: str):
    """(columns, rows) of the query and of the SQL."""
    df = query(spark, sf_dir)
    relation = connection(sf_dir).execute(sql)
    names = [d[0] for d in relation.description]
    return (sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])), (sorted(names), rows_of(names, relation.fetchall()))
