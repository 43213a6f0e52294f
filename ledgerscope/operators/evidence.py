"""Evidence: literal excerpts with their source, kept apart from scores."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope import fixed_values as V
from ledgerscope.functions.text import computed, contains_any, excerpt_hash, squeeze, tech_mentions
from ledgerscope.functions.urls import domain_of

#: Whole words inside an excerpt that a text has to have in a row before it is searched.
KEY_WORDS = 4


def paragraphs(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., position, excerpt`` of every line long enough to be an excerpt, cut to the longest.

    The filter on the length is not pushed below ``computed``: no line is cleaned once to be
    judged and once more to be kept.
    """
    lines = docs.select(*keys, F.posexplode(F.split(F.regexp_replace("text", r"[\x00-\x08\x0e-\x1f]", ""), "\n")).alias("position", "line"))
    clean = F.substring(squeeze(F.col("line")), 1, V.EXCERPT_MOST)
    return lines.select(*keys, "position", computed(clean).alias("excerpt")).where(F.length("excerpt") >= V.EXCERPT_LEAST)


def first_of_each(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") == 1).drop("__n")


def keyword_evidence(docs: DataFrame, words, most: int = 5, key: str = "doc_id") -> DataFrame:
    """The first ``most`` different paragraphs of each document that have one of ``words``."""
    found = paragraphs(docs, [key]).where(contains_any(F.lower("excerpt"), [w.lower() for w in words if w.strip()]))
    once = first_of_each(found, [key, "excerpt"], ["position"])
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("position"))).where(F.col("rank") <= most)


def new_signals(pages: DataFrame, known: DataFrame, company: str = "company_id", page: str = "page_id", most: int = 2) -> DataFrame:
    """Technologies that a company's pages (company, page, text) name in a paragraph and that aren't known of it yet: ``technology, rank, page, position, excerpt``.

    Of each, the first ``most`` different paragraphs of the first page that has one.
    """
    named = paragraphs(pages, [company, page]).withColumn("technology", F.explode(tech_mentions(F.col("excerpt"))))
    fresh = named.join(known.select(company, F.lower("technology").alias("technology")).distinct(), [company, "technology"], "left_anti")
    first = fresh.groupBy(company, "technology").agg(F.min(page).alias(page))
    once = first_of_each(fresh.join(first, [company, "technology", page]), [company, "technology", "excerpt"], ["position"])
    rank = F.row_number().over(Window.partitionBy(company, "technology").orderBy("position"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select(company, "technology", "rank", page, "position", "excerpt")


def merged_results(results: DataFrame, per_domain: int = 1) -> DataFrame:
    """Candidates of several searches (query, position, url, score): each address once, where it came first; then the best of each domain, domains by arrival."""
    address = F.lower(F.regexp_replace("url", "/+$", ""))
    once = first_of_each(results.withColumn("address", address), ["address"], ["query", "position"]).drop("address")
    placed = once.withColumn("domain", domain_of(F.col("url")))
    arrival = F.min(F.struct("query", "position")).over(Window.partitionBy("domain"))
    best = F.row_number().over(Window.partitionBy("domain").orderBy(F.col("score").desc(), "query", "position"))
    return placed.withColumn("arrival", arrival).withColumn("place", best).where(F.col("place") <= per_domain)


def literal_matches(texts: DataFrame, excerpts: DataFrame, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """``key, item`` of the excerpts that stand in a text, white space and case aside.

    The words of an excerpt but its first and last are whole words of any text
    that has it, so texts and excerpts meet on a hash of up to ``KEY_WORDS`` of
    them first; excerpts of one or two words, which have none, are compared
    with every text.
    """
    norm = lambda c: F.lower(squeeze(c))
    body = texts.select(key, norm(F.col("text")).alias("body"))
    e = excerpts.select(item, norm(F.col("text")).alias("excerpt")).where(F.col("excerpt") != "").withColumn("w", F.split("excerpt", " "))
    e = e.withColumn("k", F.least(F.size("w") - 2, F.lit(KEY_WORDS)))
    row = lambda words, at, n: F.xxhash64(F.lit(n), *(F.get(words, at + i) for i in range(n)))
    lengths = sorted(r["k"] for r in e.select("k").distinct().collect())  # six numbers at most
    keyed = [k for k in lengths if k > 0]
    found = []
    if keyed:
        of = F.lit(None).cast("long")
        for k in keyed:
            of = F.when(F.col("k") == k, row(F.col("w"), F.lit(1), k)).otherwise(of)
        long = e.where("k > 0").select(item, "excerpt", of.alias("h"))
        words = F.split("body", " ")
        starts = lambda k: F.when(F.size("words") >= k, F.sequence(F.lit(0), F.size("words") - k)).otherwise(F.array().cast("array<int>"))
        of_length = lambda k: F.transform(starts(k), lambda i: row(F.col("words"), i, k))
        hashes = F.concat(*map(of_length, keyed))
        met = body.select(key, words.alias("words")).select(key, F.explode(F.array_distinct(hashes)).alias("h")).join(long.select("h", item), "h").select(key, item).distinct()
        found.append(met.join(long.select(item, "excerpt"), item).join(body, key).where(F.col("body").contains(F.col("excerpt"))).select(key, item))
    if len(keyed) < len(lengths) or not keyed:
        found.append(body.join(e.where("k <= 0").select(item, "excerpt"), F.col("body").contains(F.col("excerpt"))).select(key, item))
    return functools.reduce(DataFrame.unionByName, found)


def prune(fields: DataFrame, literal: DataFrame, by: list[str]) -> DataFrame:
    """``fields`` (by..., value, evidence ids): evidence that isn't literal goes, a value with none left becomes null."""
    each = fields.select(*by, F.explode("evidence").alias("item_id")).join(literal, [*by[:1], "item_id"], "left_semi")
    left = each.groupBy(*by).agg(F.sort_array(F.collect_set("item_id")).alias("evidence"))
    joined = fields.withColumnRenamed("evidence", "__was").join(left, by, "left")
    kept = F.coalesce("evidence", F.array().cast(fields.schema["evidence"].dataType))
    return joined.select(*by, F.when(F.size(kept) > 0, F.col("value")).alias("value"), kept.alias("evidence"), ((F.size("__was") > 0) & (F.size(kept) == 0)).alias("annulled"))


def with_hash(rows: DataFrame, url: Column) -> DataFrame:
    return rows.withColumn("url", url).withColumn("content_hash", excerpt_hash(F.col("url"), F.col("excerpt")))


def new_rows(incoming: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``incoming`` that ``known`` lacks, each key once: an insert that skips conflicts."""
    return incoming.dropDuplicates(by).join(known.select(*by).distinct(), by, "left_anti")


def coverage(grounded: list[Column]) -> Column:
    """Share of the inferred fields that have evidence, to three places."""
    return F.round(sum((F.coalesce(g, F.lit(False)).cast("int") for g in grounded), F.lit(0)) / F.lit(len(grounded)), 3)


def recollect(attempts: Column, share: Column, asked: Column) -> Column:
    """Whether to collect again: attempts are left, and it was asked for or too little is grounded."""
    return (attempts < V.COLLECT_ATTEMPTS) & (asked | (share < V.COVERAGE_LEAST))


def reconcile(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """The retrieved chunk that each citation means: ``citation_id, chunk_id``; citations that mean none have no row.

    Chunks of the cited URL are looked through in order of rank, or all chunks
    of the same request where the URL has none: one matches if either text
    starts within the other.  A URL's only chunk stands for it in any case.
    """
    n = V.RECONCILE_CHARS
    norm = lambda c: F.lower(squeeze(c))
    c = cited.select("citation_id", "request_id", F.col("url").alias("cited_url"), norm(F.col("text")).alias("target")).where(F.col("target") != "")
    r = retrieved.select("request_id", "chunk_id", "rank", F.col("url").alias("chunk_url"), norm(F.col("text")).alias("body"))
    pairs = c.join(r, "request_id").withColumn("same", F.col("cited_url") == F.col("chunk_url"))  # a request retrieves a fixed few chunks
    per = Window.partitionBy("citation_id")
    pairs = pairs.withColumn("n_same", F.sum(F.col("same").cast("int")).over(per)).where((F.col("n_same") == 0) | F.col("same"))
    close = F.col("body").contains(F.substring("target", 1, n)) | F.col("target").contains(F.substring("body", 1, n))
    usable = pairs.withColumn("close", close).where(F.col("close") | (F.col("n_same") == 1))
    first = F.row_number().over(per.orderBy(F.col("close").desc(), "rank"))
    return usable.withColumn("__n", first).where("__n = 1").select("citation_id", "chunk_id")
