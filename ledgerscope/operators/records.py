"""Records of a company: the newest of several histories, and saving what belongs together at once.

``as_of`` merges histories by time instead of ranking each and joining them.
The savers fan rows with nested lists out into tables of a ``TableSet`` and add
them all in one commit, so a reader sees a briefing with its score,
recommendations, citations and evidence, or none of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.text import excerpt_hash
from ledgerscope.sources.shared import materialize
from ledgerscope.sources.tableset import TableSet

TABLES = {
    "scores": "company_id long, run_id long, created_at timestamp, total decimal(12,1), axes array<struct<axis:string,score:int,confidence:decimal(5,2)>>",
    "tco": "run_id long, company_id long, scenario string, api_usd double, gpu_usd double",
    "priorities": "run_id long, company_id long, bucket string, urgency double",
    "briefings": "briefing_id long, company_id long, run_id long, created_at timestamp, summary string",
    "recommendations": "recommendation_id string, company_id long, briefing_id long, position int, technology string, axis string",
    "citations": "recommendation_id string, position int, chunk_id long, text string",
    "evidence": "company_id long, content_hash string, url string, excerpt string",
    "links": "recommendation_id string, content_hash string",
}


def as_of(histories: dict[str, DataFrame], key: str = "company_id", at: str = "created_at", row_id: str = "run_id", until: Column | None = None) -> DataFrame:
    """Of each key the newest row of every history (up to ``until``), each as a struct named like its history.

    All histories become one table of events in which a row fills the column of
    its history alone; the last value that isn't null in each column is then
    one aggregation, whatever their number.  A key that a history doesn't have
    is null there; ties in time go to the larger id.
    """
    kinds = {name: df.drop(key).schema for name, df in histories.items()}

    def event(name: str, df: DataFrame) -> DataFrame:
        own = lambda other: F.struct(*(F.col(c) for c in kinds[name].names)) if other == name else F.lit(None).cast(kinds[other])
        return df.select(key, F.col(at).alias("__at"), F.col(row_id).cast("string").alias("__id"), F.col(row_id).alias("__n"), *(own(other).alias(other) for other in histories))

    events = reduce(DataFrame.unionByName, (event(name, df) for name, df in histories.items()))
    if until is not None:
        events = events.where(F.col("__at") <= until)
    place = F.struct("__at", "__n", "__id")
    return events.groupBy(key).agg(*(F.max_by(F.col(name), F.when(F.col(name).isNotNull(), place)).alias(name) for name in histories))


def new_evidence(found: DataFrame, kept: TableSet) -> DataFrame:
    """Evidence (company_id, url, excerpt) that the store doesn't have, each piece once."""
    hashed = found.withColumn("content_hash", excerpt_hash(F.col("url"), F.col("excerpt"))).dropDuplicates(["company_id", "content_hash"])
    return hashed.join(kept.table("evidence").select("company_id", "content_hash"), ["company_id", "content_hash"], "left_anti")


def score_rows(scores: DataFrame) -> dict[str, DataFrame]:
    """Tables of scores (``tco`` an array, ``priority`` a struct or null): an assessment never replaces an earlier one."""
    return {
        "scores": scores.select("company_id", "run_id", "created_at", "total", "axes"),
        "tco": scores.select("run_id", "company_id", F.inline("tco")),
        "priorities": scores.where(F.col("priority").isNotNull()).select("run_id", "company_id", "priority.*"),
    }


def save_scores(scores: DataFrame, kept: TableSet, **commit) -> bool:
    return kept.append(score_rows(scores), **commit)


def recommendation_rows(briefings: DataFrame, kept: TableSet) -> dict[str, DataFrame]:
    """Tables of the recommendations of briefings, in their order; evidence that isn't stored yet is stored with them."""
    each = briefings.select("company_id", "briefing_id", F.posexplode("recommendations").alias("position", "r"))
    named = each.select("company_id", "briefing_id", "position", F.concat_ws("-", "briefing_id", "position").alias("recommendation_id"), "r.*")
    proof = named.select("company_id", "recommendation_id", F.explode("evidence").alias("e")).select("company_id", "recommendation_id", "e.url", "e.excerpt")
    return {
        "recommendations": named.select("recommendation_id", "company_id", "briefing_id", "position", "technology", "axis"),
        "citations": named.select("recommendation_id", F.posexplode("citations").alias("position", "c")).select("recommendation_id", "position", "c.chunk_id", "c.text"),
        "evidence": new_evidence(proof.select("company_id", "url", "excerpt"), kept),
        "links": proof.select("recommendation_id", excerpt_hash(F.col("url"), F.col("excerpt")).alias("content_hash")).distinct(),
    }


def save_briefings(briefings: DataFrame, kept: TableSet, **commit) -> bool:
    """Briefings with their recommendations, and with the score that made them where that isn't stored yet."""
    briefings = materialize(briefings, "briefings")
    missing = briefings.join(kept.table("scores").select("run_id"), "run_id", "left_anti").dropDuplicates(["run_id"])
    return kept.append({"briefings": briefings} | score_rows(missing) | recommendation_rows(briefings, kept), **commit)


def bridge(kept: TableSet) -> DataFrame:
    """Recommendations with the evidence that they rest on: both sides of the bridge."""
    own = kept.table("recommendations").select("recommendation_id", "company_id", "position", "technology")
    return own.join(kept.table("links"), "recommendation_id").join(kept.table("evidence"), ["company_id", "content_hash"])
