"""Event streams: replay then live, latest state per run, changes of score, rate limits, windows.

A file stream reads a folder of event files from its earliest one, so a late
subscriber sees all history and then what arrives, each event once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerscope.sources.shared import shared_dir
from ledgerscope import fixed_values as V


def stream(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """Events of all files in ``folder``, from the first on; times as instants for watermarks."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that a stream makes of what is there now, as a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    schema = json.loads(df.schema.json())
    schema["fields"].append({"name": "batch", "type": "integer", "nullable": True, "metadata": {}})
    from pyspark.sql.types import StructType

    return spark.read.schema(StructType.fromJson(schema)).parquet(f"{path}/out")


def newest_batch(drained: DataFrame, key: str) -> DataFrame:
    """Of a stream in update mode, each key's last word."""
    return drained.groupBy(key).agg(F.max_by(F.struct(*[c for c in drained.columns if c not in (key, "batch")]), "batch").alias("last")).select(key, "last.*")


def latest_state(events: DataFrame) -> DataFrame:
    """Each run's newest event as its state, kept up to date."""
    at = F.struct("ts", "event_id")
    return events.groupBy(F.col("user_id").alias("run")).agg(F.max_by("event_type", at).alias("state"), F.max("event_id").alias("last_event"), F.count("*").alias("n"))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events per hour and type; what is later than the watermark is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Stretches of a run's events without a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def changes(scores: DataFrame, floor: float = V.SCORE_NOISE) -> DataFrame:
    """Each score against the company's one before (company_id, ts, id, score; ties by id): the previous one is kept as state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        before = rows["score"].shift(fill_value=state.get[0] if state.exists else float("nan"))
        state.update((float(rows["score"].iloc[-1]),))
        told = pd.DataFrame({"company_id": key[0], "ts": rows["ts"], "id": rows["id"], "before": before, "after": rows["score"]})
        gain = told["after"] - told["before"]
        told["kind"] = gain.gt(floor).map({True: "melhorou", False: "estavel"}).mask(gain.lt(-floor), "piorou")
        yield told[told["before"].notna()]

    return scores.groupBy("company_id").applyInPandasWithState(step, "company_id long, ts timestamp, id long, before double, after double, kind string", "last double", "append", GroupStateTimeout.NoTimeout)


def waits(requests: DataFrame, seconds: float = V.HOST_SECONDS) -> DataFrame:
    """How long each request of a host waits (host, ts), with the time of its last one as state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        free = state.get[0] if state.exists else None
        for frame in frames:
            rows = []
            for ts in frame.sort_values("ts")["ts"]:
                now = ts.timestamp()
                wait = max(0.0, free - now) if free is not None else 0.0
                free = now + wait + seconds
                rows.append((key[0], ts, wait))
            yield pd.DataFrame(rows, columns=["host", "ts", "wait"])
        if free is not None:
            state.update((free,))

    return requests.groupBy("host").applyInPandasWithState(step, "host string, ts timestamp, wait double", "free double", "append", GroupStateTimeout.NoTimeout)
