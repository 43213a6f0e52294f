"""Named queries with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def quoted(values) -> str:
    return ", ".join("'{}'".format(str(v).replace("'", "''")) for v in values)


def half_even(n: str, d: int) -> str:
    """SQL for the integer ``n`` divided by ``d``, ties to even."""
    return f"(({n}) // {d} + CASE WHEN 2 * (({n}) % {d}) > {d} OR (2 * (({n}) % {d}) = {d} AND (({n}) // {d}) % 2 = 1) THEN 1 ELSE 0 END)"


def any_of(text: str, words) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, w.replace("'", "''")) for w in words) + ")"
