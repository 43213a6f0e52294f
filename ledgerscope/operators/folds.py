"""Sequential rules over logs: budgets and rate limits, per key.

A rejected call consumes nothing and a late call waits for the one before it,
so each key's log is folded in order.  Keys are dealt over tasks and a key's
rows stream through in batches, sorted, with a few numbers as state: a long log
is never held whole.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(df: DataFrame, key: str, order: list[str], columns: str, step: Callable[[dict, tuple], tuple], value: str) -> DataFrame:
    """``df`` (key, order..., value) with ``columns`` from ``step(state, row)``, in order within each key."""
    names = [c.split()[0] for c in columns.split(",")]
    dealt = df.repartition(key).sortWithinPartitions(key, *order).select(key, *order, value)

    def mapper(frames):
        current, state = None, {}
        for frame in frames:
            made = []
            for row in frame.itertuples(index=False, name=None):
                if current is None or row[0] != current:
                    current, state = row[0], {}
                made.append(step(state, row))
            yield pd.concat([frame, pd.DataFrame(made, columns=names, index=frame.index)], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.mapInPandas(mapper, f"{schema}, {columns}")


def budget(df: DataFrame, key: str, order: list[str], amount: str, most: float) -> DataFrame:
    """Calls in order with ``accepted`` and ``used``: a call that exceeds the budget is refused and costs nothing."""

    def step(state, row):
        used = state.get("used", 0.0)
        fits = used + row[-1] <= most
        state["used"] = used + row[-1] if fits else used
        return fits, state["used"]

    return fold(df, key, order, "accepted boolean, used double", step, amount)


def rate_limit(df: DataFrame, key: str, at: str, row_id: str, seconds: float) -> DataFrame:
    """Requests of each host with ``wait``: the seconds each waits so that ``seconds`` lie between any two."""

    def step(state, row):
        now, last = row[-1], state.get("last")
        wait = max(0.0, last + seconds - now) if last is not None else 0.0
        state["last"] = now + wait
        return (wait,)

    timed = df.withColumn("at_s", F.unix_micros(F.col(at).cast("timestamp")) / 1e6)
    return fold(timed, key, [at, row_id], "wait double", step, "at_s").drop("at_s")
