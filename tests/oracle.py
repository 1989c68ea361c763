"""Compare a Spark result with its SQL counterpart run by DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(d: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, bool):
        return str(int(x))
    if isinstance(x, float):
        return f"{x:.6g}" if math.isfinite(x) else str(x)
    return str(x)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def _close(a: str, b: str, tol: float) -> bool:
    if a == b:
        return True
    try:
        x, y = float(a), float(b)
    except ValueError:
        return False
    if not (math.isfinite(x) and math.isfinite(y)):
        return False
    return abs(x - y) <= tol * max(1.0, abs(x), abs(y))


def compare(df, con, sql: str, tol: float = 2e-6):
    """None when equal, else a short description of the first difference."""
    got = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {n: str(t) for n, t in zip(names, [c[1] for c in res.description])}
    for n, k in df.dtypes:
        w = kinds[n].upper()
        if KINDS.get(k) != w:
            return f"type of {n}: {k} != {w}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    bad = [(x, y) for x, y in zip(a, b) if not all(_close(p, q, tol) for p, q in zip(x, y))]
    exact = sum(1 for x, y in zip(_exact(df.columns, got), _exact(names, want)) if x != y)
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {sorted(names)}: {bad[0]}"
    return None if exact == 0 else f"ok within {tol}, {exact} rows not bit-equal"


def _exact(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("~" if r[i] is None else repr(r[i]) for i in order) for r in rows)
