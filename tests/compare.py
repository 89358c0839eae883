"""Compare a query's rows with its SQL twin in DuckDB."""

from __future__ import annotations

import datetime
import decimal

import duckdb

from postmill.plans.views import TABLES


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def differences(spark_df, con, sql: str) -> str:
    """Empty when both give the same columns and rows."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    order = sorted(names)
    at = [names.index(c) for c in order]
    expected = sorted(([plain(r[i]) for i in at] for r in theirs), key=repr)
    got = sorted(([plain(r[c]) for c in order] for r in spark_df.select(*order).collect()), key=repr)
    if len(got) != len(expected):
        more = [r for r in got if r not in expected][:2] if len(got) < 5000 else []
        return f"rows {len(got)} against {len(expected)} {order} {more}"
    for a, b in zip(got, expected):
        if a != b:
            return f"{order}: {str(a)[:400]} against {str(b)[:400]}"
    return ""
