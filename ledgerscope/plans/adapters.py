"""The given tables as companies, score runs, evidence, web pages and logs.

What the tables lack comes from integer arithmetic on their keys, so that any
engine gets the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope import fixed_values as V

#: The day that ages are counted to.
TODAY = "2002-01-01"
STAGES = ("pre_seed", "seed", "serie_a", "serie_b_plus", "bootstrapped", "desconhecido")
KINDS = tuple(V.SOURCE_TRUST)
PROVIDERS = ("api_externa", "open_weights_hospedado", "self_hosted", "modelo_proprio")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index):
    """The value at ``index`` of a short list of literals."""
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").select(key.alias("company_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"), F.col("n_name").alias("country"), pick(STAGES, key % len(STAGES)).alias("stage"), (1 + key % 400).cast("int").alias("headcount"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score runs: four axes each with score (0 to 100) and confidence, and the hashes of its evidence."""
    run, company = F.col("o_orderkey"), F.col("o_custkey")
    axis = lambda i, name: F.struct(F.lit(name).alias("axis"), ((run * (7 + 6 * i) + company * 3) % 101).cast("int").alias("score"), ((run * (11 + 2 * i)) % 101 / 100).cast("decimal(5,2)").alias("confidence"))
    return table(spark, sf_dir, "orders").select(
        company.alias("company_id"),
        run.alias("run_id"),
        F.col("o_orderdate").alias("created_at"),
        F.array(*(axis(i, name) for i, name in enumerate(V.AXES))).alias("axes"),
        F.array(run % 7, run % 11 % 7, company % 7).alias("evidence"),
    )


def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities of four runs of five: capacity from the run's key, in hundredths."""
    run = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where(run % 5 != 0).select(run.alias("run_id"), (run % 101 / 100).alias("capacity"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages with the title that a search would show."""
    title = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").withColumn("title", F.trim(title))
