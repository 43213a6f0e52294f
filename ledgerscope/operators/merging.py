"""Keyed stores: upserts, entity resolution, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import fixed_values as V


def merge_companies(known: DataFrame, incoming: DataFrame, key: str = "company_id") -> DataFrame:
    """Non-null values overwrite, null ones preserve; an unknown stage never replaces a known one; empty lists replace nothing."""

    def merged(name: str, kind: str) -> Column:
        old, new = F.col(f"k.{name}"), F.col(f"i.{name}")
        if name == "stage":
            new = F.when(new != V.UNKNOWN, new)
            return F.coalesce(new, old, F.col(f"i.{name}"))
        if kind.startswith("array"):
            new = F.when(F.size(new) > 0, new)
        return F.coalesce(new, old)

    joined = known.alias("k").join(incoming.alias("i"), F.col(f"k.{key}") == F.col(f"i.{key}"), "full_outer")
    return joined.select(F.coalesce(f"k.{key}", f"i.{key}").alias(key), *(merged(name, kind).alias(name) for name, kind in known.dtypes if name != key))


def resolve(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """``incoming`` with the ``company_id`` of ``known`` that has its site, or else its name; null for new ones."""
    by_site = known.where(F.col("site").isNotNull()).groupBy("site").agg(F.min("company_id").alias("by_site"))
    by_name = known.groupBy("name_key").agg(F.min("company_id").alias("by_name"))
    return incoming.join(by_site, "site", "left").join(by_name, "name_key", "left").withColumn("company_id", F.coalesce("by_site", "by_name")).drop("by_site", "by_name")


def replace_latest(known: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``known`` with the rows of ``incoming`` in place of those with their keys."""
    return known.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """``children`` without those of deleted parents."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")
