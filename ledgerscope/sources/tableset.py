"""Several tables that change together, and a sink for points with retries.

A ``TableSet`` is a folder of tables whose parts are written first and named
last: a commit is one row that lists the parts of every table it adds, and
readers take only what commits list.  A job that dies between two tables leaves
parts that nobody sees.  A commit carries who wrote it and the number of its
batch, so that a replayed batch of a stream is recognised and changes nothing.
One writer at a time is assumed, as of a streaming checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ledgerscope.sources.readers import read_index

COMMIT = "number long, writer string, batch long, whole boolean, parts map<string,string>, at timestamp"
Rows = DataFrame | Callable[[dict[str, DataFrame]], DataFrame]


class TableSet:
    """Tables (name and schema) under one folder, with all-or-nothing appends."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str]):
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), schemas

    def commits(self) -> DataFrame:
        return read_index(self.spark, f"{self.folder}/commits", COMMIT)

    def _listed(self) -> list:
        """Commits in order, from the last that replaced everything on: one row a batch since the last ``compact``."""
        commits = self.commits()
        since = commits.where("whole").agg(F.max("number")).first()[0] or 0
        return sorted(commits.where(F.col("number") >= since).collect(), key=lambda c: c["number"])

    def done(self, writer: str, batch: int) -> bool:
        """Whether this batch of this writer is in."""
        return bool(self.commits().where((F.col("writer") == writer) & (F.col("batch") == batch)).limit(1).count())

    def table(self, name: str) -> DataFrame:
        """The rows of all committed parts."""
        parts = [c["parts"][name] for c in self._listed() if name in c["parts"]]
        reader = self.spark.read.schema(self.schemas[name])
        return reader.parquet(*parts) if parts else self.spark.createDataFrame([], self.schemas[name])

    def _commit(self, writer: str, batch: int | None, parts: dict[str, str], *, whole: bool) -> None:
        number = (self.commits().agg(F.max("number")).first()[0] or 0) + 1
        row = self.spark.createDataFrame([(number, writer, batch, whole, parts)], COMMIT.rsplit(",", 1)[0])
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def _write(self, tables: dict[str, Rows]) -> dict[str, str]:
        if set(tables) - set(self.schemas):
            raise ValueError(f"no such tables: {sorted(set(tables) - set(self.schemas))}")
        parts, done = {}, {}
        for name, rows in tables.items():
            df = rows if isinstance(rows, DataFrame) else rows(done)
            parts[name] = f"{self.folder}/{name}/{uuid.uuid4().hex}"
            wanted = self.spark.createDataFrame([], self.schemas[name]).schema
            df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted)).write.option("compression", "zstd").parquet(parts[name])
            done[name] = self.spark.read.schema(wanted).parquet(parts[name])
        return parts

    def append(self, tables: dict[str, Rows], *, writer: str = "job", batch: int | None = None) -> bool:
        """Add rows to several tables at once; false, and nothing changes, if this batch is in already.

        In place of a table's rows a function may stand that makes them of the new rows of the tables before it, as they were written.
        """
        if batch is not None and self.done(writer, batch):
            return False
        self._commit(writer, batch, self._write(tables), whole=False)
        return True

    def replace(self, tables: dict[str, Rows], *, writer: str = "job", batch: int | None = None) -> None:
        """All tables at once anew; tables that aren't named are empty then."""
        self._commit(writer, batch, self._write(tables), whole=True)

    def compact(self) -> None:
        """The same rows in one part a table."""
        self.replace({name: self.table(name) for name in self.schemas}, writer="compaction")


@dataclass
class Written(WriterCommitMessage):
    points: int
    batches: int


def point_sink(put: Callable[[list[dict]], None], finish: Callable[[int, int], None] = lambda points, batches: None, *, name: str = "points", batch: int = 64, size: int | None = None) -> type[DataSource]:
    """A data source that hands points (``id``, ``vector``, other columns as payload) to ``put``, ``batch`` at a time.

    Points are keyed: a retried task puts the same ids again, which replaces
    and doesn't add.  ``finish`` is called once, on the driver, when every task
    has told how many points it wrote.  A vector that is missing or not of
    ``size`` numbers is an error before anything of its batch is put.
    """

    class Sink(DataSourceWriter):
        def write(self, rows: Iterator) -> Written:
            points = batches = 0
            held: list[dict] = []

            def send():
                nonlocal points, batches, held
                for p in held:
                    if p["vector"] is None or size is not None and len(p["vector"]) != size:
                        raise ValueError(f"point {p['id']}: {0 if p['vector'] is None else len(p['vector'])} numbers instead of {size}")
                put(held)
                points, batches, held = points + len(held), batches + 1, []

            for row in rows:
                held.append(row.asDict(recursive=True))
                if len(held) == batch:
                    send()
            if held:
                send()
            return Written(points, batches)

        def commit(self, messages: list[Written | None]) -> None:
            told = [m for m in messages if m is not None]
            finish(sum(m.points for m in told), sum(m.batches for m in told))

        def abort(self, messages: list[Written | None]) -> None:
            """What was put stays: ids make the next try replace it."""

    class Points(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema, overwrite: bool) -> Sink:
            if not {"id", "vector"} <= set(schema.names):
                raise ValueError("points have an id and a vector")
            return Sink()

    return Points


def write_points(points: DataFrame, put: Callable[[list[dict]], None], **options) -> None:
    """Send points to a service by ``point_sink``."""
    kind = point_sink(put, **options)
    points.sparkSession.dataSource.register(kind)
    points.write.format(kind.name()).mode("append").save()
