"""Sinks: keyed upserts, batches that survive a failing company, Markdown and JSON exports."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.text import fold
from ledgerscope.operators.merging import replace_latest
from ledgerscope.sources.readers import NAMELESS, WRITTEN, read_index
from ledgerscope.sources.shared import mounted

#: Tasks a core that write files, a small one each row.
_TASKS = 4
#: What follows each text.
_END = "\n\n"


def append(tables: dict[str, DataFrame], folder: str, order: tuple[str, ...]) -> list[tuple[str, str]]:
    """Append each table in order; what fails is returned with its error and stops none of the others."""
    errors = []
    for name in order:
        try:
            tables[name].write.mode("append").parquet(f"{folder}/{name}")
        except Exception as failed:  # the failure is the result
            errors.append((name, f"{type(failed).__name__}: {failed}"))
    return errors


def upsert(incoming: DataFrame, folder: str, key: str) -> DataFrame:
    """A keyed store with ``incoming`` in place of rows of the same key: written as a new version, the newest of which is read."""
    spark = incoming.sparkSession
    known = current(spark, folder, incoming.schema.simpleString()[7:-1])
    version = f"{folder}/v{uuid.uuid4().hex}"
    replace_latest(known, incoming.dropDuplicates([key]), key).write.parquet(version)
    spark.createDataFrame([(version,)], "version string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    return spark.read.parquet(version)


def current(spark, folder: str, schema: str) -> DataFrame:
    """The newest version of a keyed store, or an empty one."""
    schema = ", ".join(part.replace(":", " ", 1) for part in _fields(schema))
    newest = read_index(spark, f"{folder}/versions", "version string, at timestamp").agg(F.max_by("version", "at")).first()[0]
    return spark.read.parquet(newest) if newest else spark.createDataFrame([], schema)


def _fields(schema: str) -> list[str]:
    """Fields of a struct's text, cut at commas outside of brackets."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[begin:i])
            begin = i + 1
    return [*out, schema[begin:]]


def slug(name) -> "F.Column":
    return F.regexp_replace(F.regexp_replace(fold(F.lower(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def write_markdown(briefings: DataFrame, folder: str) -> None:
    """A folder with a text for each briefing (name, markdown); briefings whose names make the same folder are files of their own.

    Spark's own writer starts several processes for each file of a mounted
    folder (they set its permissions), so there the tasks write files
    themselves: each is put in its place whole, under a name that a repeated
    task gives it again, and the table in ``_written`` lists them once all are
    there.  Elsewhere Spark's writer does the work.
    """
    rows = briefings.select(slug(F.col("name")).alias("slug"), F.col("markdown").alias("value"))
    spark, root = briefings.sparkSession, mounted(briefings.sparkSession, folder)
    tasks = _TASKS * spark.sparkContext.defaultParallelism
    if root is None:
        options = {"lineSep": _END, "maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}
        rows.repartition(tasks, "slug").write.mode("overwrite").partitionBy("slug").options(**options).text(folder)
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def put(batches):
        task, attempt, n = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        for batch in batches:
            files = []
            for name, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                place, n = f"slug={name or NAMELESS}", n + 1
                files.append(f"{place}/part-{task:05d}-{n}.txt")
                os.makedirs(f"{root}/{place}", exist_ok=True)
                unfinished = f"{root}/{place}/.{attempt}-{n}"
                with open(unfinished, "wb") as file:
                    file.write((text or b"") + _END.encode())
                os.replace(unfinished, f"{root}/{files[-1]}")
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], names=["file"])

    dealt = rows.withColumn("value", F.col("value").cast("binary")).repartition(tasks).sortWithinPartitions("slug", "value")
    dealt.mapInArrow(put, "file string").write.parquet(f"{folder}/{WRITTEN}")


def write_json(states: DataFrame, folder: str) -> None:
    """Every row as a JSON object a line."""
    states.select(F.to_json(F.struct(*states.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(folder)


def readiness(tables: dict[str, DataFrame | None]) -> list[tuple[str, bool, int]]:
    """Name, presence and number of rows of what a run needs."""
    return [(name, df is not None, 0 if df is None else df.count()) for name, df in tables.items()]
