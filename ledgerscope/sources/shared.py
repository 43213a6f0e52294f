"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where all of Spark is one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerscope-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def mounted(spark: SparkSession, folder: str) -> str | None:
    """The path at which driver and executors open a folder as their own files; none on other file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


#: Folders that ``materialize`` has written in this process.
_MADE: set[str] = set()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read back: computed once, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _MADE.add(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialize`` gave, once nothing that reads it is still to run."""
    folders = {part for file in df.inputFiles() for part in file.split("/")}
    for name in [path for path in _MADE if path.rsplit("/", 1)[-1] in folders]:
        _MADE.remove(name)
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> int:
    """Remove the intermediate tables of this process, once no result that reads them is still wanted; gives how many there were."""
    removed = 0
    for table in spark.catalog.listTables():
        if re.fullmatch("t[0-9a-f]{32}", table.name):  # bucketed intermediate tables
            location = spark.sql(f"DESCRIBE FORMATTED {table.name}").where("col_name = 'Location'").first()["data_type"]
            spark.sql(f"DROP TABLE {table.name}")
            _MADE.add(location)
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        removed += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return removed
