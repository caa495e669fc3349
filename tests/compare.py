"""Row-for-row comparison of a Spark query with its SQL twin."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, float):
        return ("double", repr(value + 0.0))
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, datetime.datetime):
        return ("ts", value.isoformat())
    return (type(value).__name__, value)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when columns, types and the multiset of rows agree."""
    cur = con.execute(sql)
    duck_cols = [d[0] for d in cur.description]
    duck_types = {d[0]: str(d[1]) for d in cur.description}
    duck_rows = cur.fetchall()
    out = []
    if sorted(df.columns) != sorted(duck_cols):
        return [f"columns {sorted(df.columns)} against {sorted(duck_cols)}"]
    for name, kind in df.dtypes:
        if SPARK_TO_DUCK.get(kind, kind) != duck_types[name]:
            out.append(f"type of {name}: {kind} against {duck_types[name]}")
    order = sorted(df.columns)
    spark_rows = df.select(*[f"`{c}`" for c in order]).collect()
    a = sorted(repr(tuple(_plain(v) for v in r)) for r in spark_rows)
    at = [duck_cols.index(c) for c in order]
    b = sorted(repr(tuple(_plain(r[i]) for i in at)) for r in duck_rows)
    if len(a) != len(b):
        out.append(f"{len(a)} rows against {len(b)}")
    if a != b:
        sa, sb = set(a), set(b)
        out.append(f"only spark {sorted(sa - sb)[:3]} only sql {sorted(sb - sa)[:3]} ({len(sa - sb)}/{len(sb - sa)})")
    return out
