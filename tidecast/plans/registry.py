"""Registry of queries and of the SQL that must give the same rows."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Written tables that parts of one query share; emptied when a query begins.
SHARED: dict = {}
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _plain_dates(df):
    """Dates and timestamps leave a query as ISO text, the same in every client."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string").alias(f.name)
        out.append(c)
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL twin."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            SHARED.clear()
            return _plain_dates(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


_CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, needs: tuple[str, ...] | list[str] = ()) -> None:
    """Name a reusable piece of SQL."""
    _CTE[name] = (tuple(needs), body)


def with_(final: str, *needs: str) -> str:
    """Prefix ``final`` with the named pieces it needs, in dependency order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _CTE[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return final
    parts = ",\n".join(f"{n} AS ({_CTE[n][1]})" for n in order)
    return f"WITH {parts}\n{final}"
