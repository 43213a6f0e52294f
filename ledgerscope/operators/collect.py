"""Collecting a company's pages in two waves: its seeds, then the telling links that they have.

``fetch`` is a provider of tables: given addresses (``url``) it gives those that
answered (``url, html``), be it by a cache, a crawl or ``routing.fetched``.
Each wave is fetched once for all companies together and written down, so
nothing is asked for twice, whatever is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.urls import source_kind
from ledgerscope.operators import web
from ledgerscope.sources.shared import materialize

#: Links followed and job titles kept of a company.
FOLLOWED, TITLES = 5, 30
MEDIA, NOTHING = "veiculo_de_midia", "nenhuma_pagina"


@dataclass(frozen=True)
class Collected:
    """``pages`` (company_id, wave, url, kind, title, text, published_at), ``titles`` (company_id, job_titles), ``failures`` (company_id, reason) and ``named`` (company_id, wave, place, url, job_titles), which page names which titles."""

    pages: DataFrame
    titles: DataFrame
    failures: DataFrame
    named: DataFrame


def _answers(asked: DataFrame, fetch: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``company_id, place, url, html`` and what the page links to, of the addresses that answered."""
    got = asked.join(fetch(asked.select("url").distinct()).select("url", "html"), "url").where(F.length("html") > 0)
    rows = materialize(got.select("company_id", "place", "url", "html").withColumn("page_id", F.monotonically_increasing_id()), name)
    return rows.join(web.page_links(rows, same_host=True).select("page_id", "career_links", "signal_links", "job_titles"), "page_id")


def collect(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], followed: int = FOLLOWED, titles: int = TITLES) -> Collected:
    """Seeds (company_id, domain, url, place) and the first ``followed`` new links to vacancies and signals that their pages have, in order.

    A company one of whose seeds has the form of a media outlet is no company:
    it is a failure without pages, and its links aren't followed.  A company
    without any page is a failure too; neither stops another one.
    """
    asked = materialize(seeds.select("company_id", "domain", "url", "place").dropDuplicates(["company_id", "url"]), "asked")
    first = materialize(_answers(asked, fetch, "wave1"), "seeds")
    media = materialize(first.where(web.is_media(F.col("html"), F.col("url"))).select("company_id").distinct(), "media")
    first = first.join(media, "company_id", "left_anti")

    linked = first.select("company_id", "place", F.posexplode(F.concat("career_links", "signal_links")).alias("n", "url"))
    once = linked.groupBy("company_id", "url").agg(F.min(F.struct("place", "n")).alias("at")).join(asked.select("company_id", "url"), ["company_id", "url"], "left_anti")
    order = F.row_number().over(Window.partitionBy("company_id").orderBy("at"))
    more = materialize(once.withColumn("place", order).where(F.col("place") <= followed).select("company_id", "place", "url"), "followed")
    second = _answers(more, fetch, "wave2")

    waves = first.withColumn("wave", F.lit(1)).unionByName(second.withColumn("wave", F.lit(2)))
    whole = materialize(waves, "waves")
    read = web.extracted(whole)
    domains = asked.groupBy("company_id").agg(F.min("domain").alias("domain"))
    told = whole.select("page_id", "wave", "company_id", "url").join(read, "page_id").join(domains, "company_id")
    pages = told.where(F.trim("text") != "").select("company_id", "wave", "url", source_kind(F.col("url"), F.col("domain")).alias("kind"), "title", "text", "published_at")
    named = whole.select("company_id", F.posexplode("job_titles").alias("n", "title"), F.struct("wave", "place").alias("at")).groupBy("company_id", "title").agg(F.min(F.struct("at", "n")).alias("at"))
    placed = named.withColumn("k", F.row_number().over(Window.partitionBy("company_id").orderBy("at"))).where(F.col("k") <= titles)
    kept = placed.groupBy("company_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "title"))), lambda t: t["title"]).alias("job_titles"))
    empty = asked.select("company_id").distinct().join(media, "company_id", "left_anti").join(whole.select("company_id").distinct(), "company_id", "left_anti")
    failures = media.withColumn("reason", F.lit(MEDIA)).unionByName(empty.withColumn("reason", F.lit(NOTHING)))
    return Collected(pages, kept, failures, whole.select("company_id", "wave", "place", "url", "job_titles"))
