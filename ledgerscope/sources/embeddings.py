"""A cache of vectors, sharded by the first two digits of their keys.

A lookup knows the shards of its keys (at most 256) before it plans the scan,
so only their folders are read; adding vectors rewrites only the shards that
they fall into.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.sources.readers import provided, read_index
from ledgerscope.sources.shared import materialize

SCHEMA = "key string, vector array<float>, shard string"


def key_of(model: str, kind: str, text: Column) -> Column:
    """Key of a text's vector by a model, as a passage or as a query."""
    return F.sha2(F.concat(F.lit(f"{model}\x00{kind}\x00"), text), 256)


class EmbeddingCache:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _touched(self, keys: DataFrame) -> list[str]:
        return sorted(r[0] for r in keys.select(F.substring("key", 1, 2)).distinct().collect())  # 256 at most

    def rows(self, keys: DataFrame) -> DataFrame:
        """``key, vector, shard`` of the shards that ``keys`` fall into."""
        return read_index(self.spark, self.folder, SCHEMA).where(F.col("shard").isin(*self._touched(keys)))

    def get(self, keys: DataFrame) -> DataFrame:
        """``key, vector`` of the keys that are here; a stored vector without numbers is none."""
        known = self.rows(keys).where(F.size("vector") > 0)
        return known.join(keys.select("key").distinct(), "key", "left_semi").select("key", "vector")

    def put(self, vectors: DataFrame) -> None:
        """Add vectors; those of known keys replace them."""
        new = materialize(vectors.select("key", "vector").dropDuplicates(["key"]), "vectors").withColumn("shard", F.substring("key", 1, 2))
        kept = materialize(self.rows(new).join(new.select("key"), "key", "left_anti").unionByName(new), "shards")
        kept.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(self.folder)

    def embed(self, rows: DataFrame, of: Callable[[list], list], text: str, model: str, kind: str = "passage", batch: int = 32) -> DataFrame:
        """``rows`` with ``vector``: from the cache, or from a provider that is asked once for each different text."""
        keyed = rows.withColumn("key", key_of(model, kind, F.coalesce(F.col(text), F.lit(""))))
        asked = materialize(keyed.groupBy("key").agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("text")), "asked")
        missing = asked.join(self.get(asked), "key", "left_anti")
        fresh = materialize(provided(missing, of, "text", "vector", "array<float>", batch).select("key", "vector"), "fresh")
        if not fresh.isEmpty():
            self.put(fresh)
        return keyed.join(self.get(asked), "key", "left").drop("key")
