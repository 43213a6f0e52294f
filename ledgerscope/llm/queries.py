"""The text operators applied to whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, contamination, divergence, hmm, html_text, language, licenses, manifest, media, ngram_join, quality, substring_dedup, token_counts
from .common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op3_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ranking = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, ranking).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


@_query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"))


@_query
def op8_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(_table(spark, sf_dir, "documents"), held_out(7, 2))


@_query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


@_query
def op5_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.stored(_table(spark, sf_dir, "documents")))


@_query
def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each shot of each stored text, with its times."""
    return media.clips(media.stored(_table(spark, sf_dir, "documents").select("doc_id", "text")))


@_query
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@_query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


@_query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


@_query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@_query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.tampered_rows(_table(spark, sf_dir, "documents"))


ORACLES["op1_license_scan"] = licenses.scan_sql()

ORACLES["op11_source_divergence"] = divergence.audit_sql()

ORACLES["op13_merkle_manifest"] = manifest.manifest_sql()


ORACLES["op4_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, pos, list_aggregate(w[pos + 1:pos + 13], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS pos FROM d WHERE len(w) >= 13)),
least AS (SELECT g, min(doc_id) AS low FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, pos + k AS spot FROM win JOIN least USING (g), range(0, 13) r(k) WHERE doc_id > low),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS spot FROM d),
kept AS (SELECT doc_id, count(*) FILTER (WHERE g.spot IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY w.spot) FILTER (WHERE g.spot IS NULL), '') AS t FROM words w LEFT JOIN gone g USING (doc_id, spot) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

ORACLES["op7_ngram_jaccard"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(0, len(w) - 3), lambda i: list_aggregate(w[i + 1:i + 4], 'string_agg', ' ')) WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE [] END) AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT doc_id, len(g) AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM s"""

ORACLES["op8_benchmark_containment"] = r"""
WITH words AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL
 UNION ALL SELECT 'b', item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') FROM benchmark WHERE item_id IS NOT NULL),
sizes AS (SELECT DISTINCT least(len(w), 5) AS n FROM words WHERE kind = 'b' AND len(w) > 0 UNION SELECT 5),
g AS (SELECT DISTINCT kind, id, n, unnest(list_transform(range(0, len(w) - n + 1), lambda i: list_aggregate(w[i + 1:i + n], 'string_agg', ' '))) AS x FROM words, sizes WHERE len(w) >= n AND (kind = 'd' OR n = least(len(w), 5))),
n AS (SELECT id AS item_id, count(*) AS n_item FROM g WHERE kind = 'b' GROUP BY id),
m AS (SELECT a.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM g a JOIN g b ON a.x = b.x AND a.n = b.n AND a.kind = 'd' AND b.kind = 'b' GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM m JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item"""
