"""Web pages: visible text, titles, links, job titles, client names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import fixed_values as V
from ledgerscope.functions import markup
from ledgerscope.functions.text import squeeze, unescaped
from ledgerscope.functions.urls import joined, netloc, path_of


def visible_text(html: Column) -> Column:
    """Text outside of scripts, styles, templates, drawings, comments and tags, with character references decoded."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript|template|svg)\b.*?</(script|style|noscript|template|svg)\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, "(?s)<!--.*?-->", " "), "(?s)<[^>]*>", " ")
    return squeeze(unescaped(text))


def needs_rendering(html: Column) -> Column:
    return F.length(visible_text(html)) < V.RENDER_CHARS


def page_title(html: Column) -> Column:
    return squeeze(unescaped(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)))


def article_links(html: Column, url: Column) -> Column:
    """Number of different article-shaped paths that a page links to on its own host."""
    bare = lambda u: F.regexp_replace(netloc(u), r"^www\.", "")
    links = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?i)href=[\"']([^\"']+)[\"']"), 1)
    here = F.filter(F.transform(links, lambda h: joined(url, F.trim(h))), lambda h: bare(h).isin("") | (bare(h) == bare(url)))
    paths = F.transform(here, lambda h: F.lower(path_of(h)))

    def article(path):
        shaped = path.rlike(V.DATED_PATH)
        for mark in V.ARTICLE_PATHS:
            shaped = shaped | path.contains(mark)
        return shaped

    return F.size(F.array_distinct(F.filter(paths, article)))


def is_media(html: Column, url: Column) -> Column:
    return article_links(html, url) >= V.ARTICLE_LINKS


#: What ``page_links`` finds on a page.
LINKS = ("career_links", "signal_links", "job_titles", "client_names")


def page_links(pages: DataFrame, *, same_host: bool = False) -> DataFrame:
    """``page_id, career_links, signal_links, job_titles, client_names`` of each page (page_id, url, html), by one pass over its tags."""

    @F.arrow_udf(", ".join(f"{name} array<string>" for name in LINKS))
    def found(html: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, urls in html:
            rows = [markup.extracted(h.as_py(), u.as_py(), same_host=same_host) for h, u in zip(pages, urls, strict=True)]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.list_(pa.string())) for k in range(len(LINKS))], list(LINKS))

    return pages.select("page_id", found("html", "url").alias("found")).select("page_id", "found.*")


#: Where a block of text begins or ends, and what isn't text.
_BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>"
_NOT_TEXT = ("script", "style", "noscript", "template", "svg", "head", "nav", "footer", "aside")


def main_text(html: Column) -> Column:
    """The densest stretch of a page's blocks, one a line.

    A block gains its words outside of links and loses those inside, and a
    little for being one more; the stretch of neighbours with the largest sum is
    found in one fold that keeps six numbers.  Blocks in the stretch that are
    mostly links are left out.
    """
    body = F.regexp_replace(F.coalesce(html, F.lit("")), "(?s)<!--.*?-->", " ")
    for tag in _NOT_TEXT:
        body = F.regexp_replace(body, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    words = lambda t: F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))
    plain = lambda t: squeeze(F.regexp_replace(t, "(?s)<[^>]*>", " "))

    told = lambda part: F.struct(plain(part).alias("text"), plain(F.regexp_replace(part, r"(?is)<a\b.*?</a\s*>", " ")).alias("free"))
    texts = F.filter(F.transform(F.split(body, _BLOCK), told), lambda b: b["text"] != "")
    blocks = F.transform(texts, lambda b: F.struct(b["text"].alias("text"), words(b["text"]).alias("words"), words(b["free"]).alias("free")))
    kind = "struct<i:int,sum:bigint,from:int,best:bigint,first:int,end:int>"

    def step(a: Column, b: Column) -> Column:
        gain = (b["free"] - V.LINK_COST * (b["words"] - b["free"]) - V.BLOCK_COST).cast("long")
        fresh = a["sum"] <= 0
        total, start = F.when(fresh, gain).otherwise(a["sum"] + gain), F.when(fresh, a["i"]).otherwise(a["from"])
        better = total > a["best"]
        return F.struct((a["i"] + 1).alias("i"), total.alias("sum"), start.alias("from"), F.greatest(total, a["best"]).alias("best"), F.when(better, start).otherwise(a["first"]).alias("first"), F.when(better, a["i"] + 1).otherwise(a["end"]).alias("end")).cast(kind)

    nothing = F.struct(*(F.lit(0).alias(n) for n in ("i", "sum", "from", "best", "first", "end"))).cast(kind)
    kept = lambda bs, at: F.filter(F.slice(bs, at["first"] + 1, at["end"] - at["first"]), lambda b: 2 * b["free"] >= b["words"])
    lines = lambda bs, at: F.array_join(F.transform(kept(bs, at), lambda b: unescaped(b["text"])), "\n")
    once = lambda x, of: F.transform(F.array(x), of)[0]  # noqa: E731  evaluates x a single time
    return once(blocks, lambda bs: once(F.aggregate(bs, nothing, step), lambda at: lines(bs, at)))


#: A day as pages write it: with or without a time.
_DAY = r"((?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?)"
#: Where a page says when it was published, the surest place first.
DATE_PLACES = (
    r"(?is)<meta\b(?=[^>]*\b(?:property|name|itemprop)\s*=\s*[\"'](?:article:published_time|og:published_time|datepublished|date|dc\.date|pubdate)[\"'])[^>]*\bcontent\s*=\s*[\"']\s*" + _DAY,
    r"(?is)\"datePublished\"\s*:\s*\"" + _DAY,
    r"(?is)<time\b[^>]*\bdatetime\s*=\s*[\"']\s*" + _DAY,
)
URL_DAY = r"/((?:19|20)[0-9]{2})/(0[1-9]|1[0-2])/(0[1-9]|[12][0-9]|3[01])(?:/|$)"


def published_at(html: Column, url: Column) -> Column:
    """When a page was published, as an instant: from its head, its data, its first dated time, or its address; null if none says so."""
    told = [F.nullif(F.regexp_extract(F.coalesce(html, F.lit("")), place, 1), F.lit("")) for place in DATE_PLACES]
    day = F.nullif(F.concat_ws("-", *(F.nullif(F.regexp_extract(url, URL_DAY, k), F.lit("")) for k in (1, 2, 3))), F.lit(""))
    return F.coalesce(*(F.try_to_timestamp(F.replace(t, F.lit(" "), F.lit("T"))) for t in told), F.try_to_timestamp(day))


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, title, text, fallback, published_at``: main text, or all visible text where that is too short to be cited."""
    html = F.col("html")
    rows = pages.select("page_id", page_title(html).alias("title"), main_text(html).alias("main"), visible_text(html).alias("all"), published_at(html, F.col("url")).alias("published_at"))
    short = F.length(F.trim("main")) < V.EXCERPT_LEAST
    return rows.select("page_id", F.nullif("title", F.lit("")).alias("title"), F.when(short, F.col("all")).otherwise(F.col("main")).alias("text"), short.alias("fallback"), "published_at")
