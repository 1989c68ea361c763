"""Registration of queries and the shared SQL building blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from resight.session import reuse

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: long integers, doubles to ``digits`` places, dates and flags as text and 0/1."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("tinyint", "smallint", "int"):
            c = c.cast("long")
        elif kind in ("double", "float"):
            c = F.round(c, digits) + F.lit(0.0)
        elif kind == "date":
            c = c.cast("string")
        elif kind == "boolean":
            c = c.cast("int").cast("long")
        cols.append(c.alias(name))
    return df.select(*cols)


def cte(name: str, deps, sql: str) -> None:
    CTES[name] = (tuple(deps.split()), sql.strip())


def with_ctes(needs: str, body: str) -> str:
    """``WITH`` the named blocks and everything they rest on, in order, then the body."""
    done: list[str] = []

    def visit(n):
        for d in CTES[n][0]:
            visit(d)
        if n not in done:
            done.append(n)

    for n in needs.split():
        visit(n)
    parts = [f"{n} AS (\n{CTES[n][1]}\n)" for n in done]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def query(name: str, needs: str = "", sql: str | None = None, digits: int = 6):
    def deco(fn):
        def run(spark, d):
            with reuse():
                return present(fn(spark, d), digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(needs, sql)
        return fn

    return deco


def num(expr: str, name: str, digits: int = 6) -> str:
    """SQL for a rounded double."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def big(expr: str, name: str) -> str:
    """SQL for a long."""
    return f"CAST({expr} AS BIGINT) AS {name}"
