"""Queries over documents, vectors and answers: tokens, search, fusion, chunks, evidence, citations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope import fixed_values as V
from ledgerscope.functions import scores as S
from ledgerscope.functions import text as T
from ledgerscope.operators import chunking, evidence, ingest, merging, retrieval
from ledgerscope.plans import adapters as A
from ledgerscope.plans.registry import any_of, query, quoted
from ledgerscope.sources.shared import materialize, shared_dir

TOP = 30
_STOP = f"[{quoted(V.STOPWORDS)}]"
_FOLD = "regexp_replace(strip_accents(lower({})), '[\\x{{300}}-\\x{{36f}}]', '', 'g')"


def _terms(table: str, key: str) -> str:
    """SQL: ``terms(key, term)`` rows of all tokens and parts of tokens, and ``lists`` with lengths."""
    kept = f"list_filter(regexp_extract_all({_FOLD.format('text')}, '{V.TOKEN}'), lambda t: NOT list_contains({_STOP}, t))"
    parts = f"flatten(list_transform(list_filter(kept, lambda t: regexp_matches(t, '[-_./]')), lambda t: list_filter(regexp_split_to_array(t, '[-_./]'), lambda p: p <> '' AND NOT list_contains({_STOP}, p))))"
    return f"SELECT {key}, list_concat(kept, {parts}) AS terms, len(list_concat(kept, {parts})) AS length FROM (SELECT {key}, {kept} AS kept FROM {table} WHERE text IS NOT NULL) UNION ALL SELECT {key}, [], 0 FROM {table} WHERE text IS NULL"


_BM25 = f"""lists AS MATERIALIZED ({_terms('documents', 'doc_id')}),
postings AS MATERIALIZED (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, length, unnest(terms) AS term FROM lists) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln((SELECT count(*) FROM lists) - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN {V.BM25_EPSILON}::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(terms) AS term FROM ({_terms('(SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 20 = 0)', 'query_id')})) GROUP BY ALL),
bm25 AS (SELECT query_id, doc_id, round(sum(times * idf * tf * {V.BM25_K1 + 1}::DOUBLE / (tf + {V.BM25_K1}::DOUBLE * ({1 - V.BM25_B}::DOUBLE + {V.BM25_B}::DOUBLE * length / (SELECT avg(length) FROM lists)))), 6) AS score FROM asked JOIN idf USING (term) JOIN postings USING (term) GROUP BY ALL),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25 QUALIFY rank <= {TOP})"""
_DENSE = f"""cosines AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, v.label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
dense AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cosines QUALIFY rank <= {TOP})"""
_FUSED = f"""both_lists AS (SELECT coalesce(d.query_id, x.query_id) AS query_id, coalesce(d.doc_id, x.doc_id) AS doc_id, d.score AS dense_score, d.rank AS dense_rank, x.score AS bm25_score, x.rank AS bm25_rank,
 round(coalesce(1.0::DOUBLE / ({V.RRF_K} + d.rank), 0) + coalesce(1.0::DOUBLE / ({V.RRF_K} + x.rank), 0), 9) AS rrf_score FROM (SELECT * FROM dense WHERE query_id IN (SELECT item_id FROM benchmark)) d FULL JOIN lexical x ON d.query_id = x.query_id AND d.doc_id = x.doc_id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS rank FROM both_lists QUALIFY rank <= {TOP})"""


def _docs(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _questions(spark, sf_dir):
    """Texts to search for: benchmark items whose id is divisible by 20."""
    return A.table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark, sf_dir):
    return A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _asked(vectors):
    return vectors.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding")


@query(f"WITH lists AS ({_terms('documents', 'doc_id')}) SELECT doc_id, length, len(list_distinct(terms)) AS different, coalesce(list_min(terms), '') AS least FROM lists")
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = retrieval.term_lists(_docs(spark, sf_dir))
    return lists.select("doc_id", F.col("length").cast("long").alias("length"), F.size(F.array_distinct("terms")).cast("long").alias("different"), F.coalesce(F.array_min("terms"), F.lit("")).alias("least"))


@query(
    f"""WITH lists AS ({_terms('documents', 'doc_id')}), n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(terms) AS term FROM lists) GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df, n), mean AS (SELECT avg(raw) AS mean FROM raw)
SELECT term, df, round(CASE WHEN raw < 0 THEN {V.BM25_EPSILON}::DOUBLE * mean ELSE raw END, 6) AS idf FROM raw, mean"""
)
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.term_stats(retrieval.index_once(_docs(spark, sf_dir))).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM lexical")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_k(retrieval.bm25_scores(retrieval.index_once(_docs(spark, sf_dir)), _questions(spark, sf_dir)), TOP)


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM lexical")
def bm25_after_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over an index that was saved, loaded, and given a fourth of the documents anew."""
    docs = _docs(spark, sf_dir)
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    stale = docs.withColumn("text", F.when(F.col("doc_id") % 4 == 1, F.lit("stale words")).otherwise(F.col("text")))
    retrieval.save_index(retrieval.index_of(stale.where("doc_id % 4 <> 0")), path)
    index = retrieval.upsert(retrieval.load_index(spark, path), docs.where("doc_id % 4 <= 1"))
    return retrieval.top_k(retrieval.bm25_scores(index, _questions(spark, sf_dir)), TOP)


@query(
    f"WITH {_BM25}, wide AS (SELECT * FROM bm25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 30), part_of AS (SELECT wide.* FROM wide JOIN documents USING (doc_id) WHERE lang IN ('en', 'fr')) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM part_of QUALIFY rank <= 10"
)
def bm25_filtered_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty best, then those in two languages, then ten best: in this order."""
    docs = _docs(spark, sf_dir)
    return retrieval.bm25_filtered(retrieval.index_once(docs), docs, _questions(spark, sf_dir), 10, F.col("lang").isin("en", "fr")).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {_DENSE} SELECT query_id, doc_id, score, rank FROM dense")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return retrieval.dense_top_k(vectors, _asked(vectors), TOP)


@query(f"WITH {_DENSE} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cosines WHERE label IN (1, 3) QUALIFY rank <= 10")
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter reaches the scan; an empty list would restrict nothing."""
    vectors = _vectors(spark, sf_dir)
    return retrieval.dense_top_k(retrieval.restrict(vectors, label=[1, 3]), _asked(vectors), 10)


def _fused(spark, sf_dir) -> DataFrame:
    questions, vectors = _questions(spark, sf_dir), _vectors(spark, sf_dir)
    asked = _asked(vectors).join(A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")), "query_id", "left_semi")
    dense = retrieval.dense_top_k(vectors, asked, TOP)
    lexical = retrieval.top_k(retrieval.bm25_scores(retrieval.index_once(_docs(spark, sf_dir)), questions), TOP)
    return retrieval.fuse(dense, lexical, TOP)


@query(f"WITH {_BM25}, {_DENSE}, {_FUSED} SELECT query_id, doc_id, dense_score, dense_rank, bm25_score, bm25_rank, rrf_score, rank FROM fused")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question i by words over documents, and vector i over vectors, fused by rank."""
    return _fused(spark, sf_dir)


@query(f"WITH {_BM25}, {_DENSE}, {_FUSED} SELECT query_id, doc_id, rrf_score, CAST(NULL AS DOUBLE) AS rerank_score, rank FROM fused WHERE rank <= 5")
def rerank_fallback_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rerank(_fused(spark, sf_dir), 5).select("query_id", "doc_id", "rrf_score", "rerank_score", "rank")


_ESTIMATE = f"CASE WHEN trim({{0}}, ' \n\t\r') = '' THEN 0 ELSE greatest(CAST(ceil(length(trim({{0}}, ' \n\t\r')) / 4.0::DOUBLE) AS BIGINT), CAST(ceil(len(regexp_split_to_array(trim({{0}}, ' \n\t\r'), '\\s+')) * {V.TOKENS_PER_WORD}::DOUBLE) AS BIGINT)) END"


@query(f"SELECT doc_id, {_ESTIMATE.format('text')} AS tokens FROM documents")
def estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(f"WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents) SELECT doc_id, count(*) AS units, CAST(sum({_ESTIMATE.format('unit')}) AS BIGINT) AS tokens, max({_ESTIMATE.format('unit')}) AS most FROM lines WHERE trim(unit, ' \n\t\r') <> '' GROUP BY doc_id")
def paragraph_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("unit")).where(F.trim("unit") != "")
    tokens = T.token_estimate(F.col("unit"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("units"), F.sum(tokens).alias("tokens"), F.max(tokens).alias("most"))


def _chunks(spark, sf_dir) -> DataFrame:
    docs = _docs(spark, sf_dir)
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("lang"))
    return chunking.chunk(docs.select("doc_id", url.alias("url"), F.col("lang").alias("category"), "text"), target=256)


@query()
def structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their identity and their text under its headings."""
    c = _chunks(spark, sf_dir)
    return c.select("doc_id", "position", T.chunk_id(F.col("url"), F.col("chunk")).alias("chunk_id"), "token_estimate", F.sha2(chunking.contextualized(F.col("url"), F.col("heading_path"), F.col("chunk")), 256).alias("text_sha256"))


_LINES = f"""lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS position FROM documents),
paras AS (SELECT doc_id, position, 'https://' || source || '.example.com/' || lang AS url, left(trim(regexp_replace(regexp_replace(line, '[\\x00-\\x08\\x0e-\\x1f]', '', 'g'), '\\s+', ' ', 'g')), {V.EXCERPT_MOST}) AS excerpt FROM lines),
ev AS (SELECT *, left(sha256(url || '|' || excerpt), 16) AS content_hash FROM paras WHERE length(excerpt) >= {V.EXCERPT_LEAST})"""


def _evidence(spark, sf_dir) -> DataFrame:
    docs = _docs(spark, sf_dir)
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("lang"))
    rows = evidence.paragraphs(docs.withColumn("u", url), ["doc_id", "u"])
    return evidence.with_hash(rows, F.col("u")).drop("u")


@query(f"WITH {_LINES} SELECT content_hash, doc_id, position FROM ev QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id, position) = 1")
def evidence_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first appearance of each piece of evidence."""
    once = _evidence(spark, sf_dir).groupBy("content_hash").agg(F.min(F.struct("doc_id", F.col("position").cast("long").alias("position"))).alias("at"))
    return once.select("content_hash", "at.doc_id", "at.position")


@query(f"WITH {_LINES} SELECT DISTINCT content_hash FROM ev WHERE doc_id % 3 <> 0 AND content_hash NOT IN (SELECT content_hash FROM ev WHERE doc_id % 3 = 0)")
def evidence_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an insert that skips conflicts adds to the evidence of every third document."""
    rows = _evidence(spark, sf_dir)
    return evidence.new_rows(rows.where("doc_id % 3 <> 0").select("content_hash"), rows.where("doc_id % 3 = 0"), ["content_hash"])


_INGEST = f"""{_LINES}, known AS (SELECT DISTINCT content_hash FROM ev WHERE doc_id % 4 = 0), pending AS (SELECT content_hash, min(doc_id) AS doc_id FROM ev WHERE doc_id % 4 <> 0 GROUP BY 1)"""


@query(f"WITH {_INGEST} SELECT content_hash, doc_id FROM pending WHERE content_hash NOT IN (SELECT content_hash FROM known)")
def chunk_dedupe_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces that an incremental ingest still has to embed."""
    rows = _evidence(spark, sf_dir)
    pending = rows.where("doc_id % 4 <> 0").groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    return pending.join(rows.where("doc_id % 4 = 0").select("content_hash").distinct(), "content_hash", "left_anti")


@query(f"WITH {_INGEST} SELECT (SELECT count(*) FROM ev WHERE doc_id % 4 <> 0) AS collected, count(*) AS different, count(*) FILTER (WHERE content_hash IN (SELECT content_hash FROM known)) AS skipped, count(*) FILTER (WHERE content_hash NOT IN (SELECT content_hash FROM known)) AS added FROM pending")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evidence(spark, sf_dir)
    pending = rows.where("doc_id % 4 <> 0").groupBy("content_hash").agg(F.count("*").alias("times"))
    known = rows.where("doc_id % 4 = 0").select("content_hash").distinct().withColumn("known", F.lit(True))
    return pending.join(known, "content_hash", "left").agg(F.coalesce(F.sum("times"), F.lit(0)).alias("collected"), F.count("*").alias("different"), F.count_if("known").alias("skipped"), F.count_if(F.col("known").isNull()).alias("added"))


def _by_lines(docs: DataFrame) -> DataFrame:
    """Lines as pieces: what SQL can cut too."""
    rows = evidence.paragraphs(docs, ["url", "technology", "category"])
    return rows.select("url", F.col("position").cast("long").alias("position"), F.col("excerpt").alias("context"), F.col("excerpt").alias("chunk"), "technology", "category")


def _letters(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: how often each of eight letters is in a text."""
    return [[float(t.count(c)) for c in "aeinorst"] for t in texts]


def _as_sources(docs: DataFrame) -> DataFrame:
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("lang"))
    return docs.select(url.alias("url"), F.col("source").alias("title"), "text", F.col("lang").alias("technology"), F.col("source").alias("category"))


_STORE = f"""{_LINES}, pieces AS (SELECT doc_id % 4 = 0 AS early, url, excerpt, left(sha256(url || '|' || excerpt), 24) AS chunk_id FROM ev),
first AS (SELECT chunk_id, bool_or(early) AS early, min(excerpt) AS text FROM pieces GROUP BY 1),
words AS (SELECT early, unnest(terms) AS term, chunk_id FROM ({_terms('first', 'chunk_id')}) JOIN first USING (chunk_id)),
postings AS (SELECT early, count(*) AS n FROM (SELECT DISTINCT early, chunk_id, term FROM words) GROUP BY 1)"""


@query(
    f"""WITH {_STORE}
SELECT 'early' AS stage, (SELECT count(DISTINCT (source, lang)) FROM documents WHERE doc_id % 4 = 0) AS documents, (SELECT count(*) FROM pieces WHERE early) AS collected, count(*) AS different, 0 AS skipped, count(*) AS added, count(*) AS chunks, count(*) AS vectors, (SELECT n FROM postings WHERE early) AS postings FROM first WHERE early
UNION ALL SELECT 'stream', (SELECT count(DISTINCT (source, lang)) FROM documents), (SELECT count(*) FROM pieces), count(*), count(*) FILTER (WHERE early), count(*) FILTER (WHERE NOT early), count(*), count(*), (SELECT sum(n) FROM postings) FROM first"""
)
def ingest_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents as a job, then all of them as a stream: what each step adds to the store."""
    docs = A.table(spark, sf_dir, "documents")
    kept = ingest.store(spark, f"{shared_dir(spark)}/knowledge-{uuid.uuid4().hex}")
    ingest.ingest(_as_sources(docs.where("doc_id % 4 = 0")), kept, _letters, cut=_by_lines)
    sizes = lambda: tuple(kept.table(name).count() for name in ("chunks", "vectors", "postings"))
    early = sizes()
    arriving = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parque[t]")  # a pattern may be a file or a folder
    ingest.ingest_stream(_as_sources(arriving), kept, _letters, cut=_by_lines)
    known = [("early", *early), ("stream", *sizes())]
    reports = kept.table("reports").withColumn("stage", F.when(F.col("batch").isNull(), "early").otherwise("stream"))
    told = reports.groupBy("stage").agg(*(F.sum(c).alias(c) for c in ("documents", "collected", "different", "skipped", "added")))
    return told.join(spark.createDataFrame(known, "stage string, chunks long, vectors long, postings long"), "stage")


@query("WITH n AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS body FROM documents), b AS (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS excerpt FROM benchmark) SELECT doc_id, item_id FROM n JOIN b ON contains(body, excerpt)")
def literal_evidence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.literal_matches(_docs(spark, sf_dir), A.table(spark, sf_dir, "benchmark"))


_MATCH = "match AS (SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g')))))"


@query(
    f"WITH {_MATCH}, fields AS (SELECT doc_id, 'sector' AS field, doc_id % 40 AS i, (doc_id + 1) % 40 AS j FROM documents UNION ALL SELECT doc_id, 'market', item_id, NULL FROM match), e AS (SELECT doc_id, field, i AS item_id FROM fields UNION ALL SELECT doc_id, field, j FROM fields WHERE j IS NOT NULL), kept AS (SELECT doc_id, field, count(DISTINCT item_id) AS n FROM e JOIN match USING (doc_id, item_id) GROUP BY ALL) SELECT f.doc_id, f.field, CASE WHEN n IS NULL THEN NULL ELSE f.field END AS value, coalesce(n, 0) AS n_evidence, n IS NULL AS annulled FROM (SELECT DISTINCT doc_id, field FROM fields) f LEFT JOIN kept k USING (doc_id, field)"
)
def prune_non_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields whose evidence isn't literal become null, not false."""
    docs = _docs(spark, sf_dir)
    match = materialize(evidence.literal_matches(docs, A.table(spark, sf_dir, "benchmark")), "matches")
    sector = docs.select("doc_id", F.lit("sector").alias("field"), F.array(F.col("doc_id") % 40, (F.col("doc_id") + 1) % 40).alias("evidence"))
    market = match.groupBy("doc_id").agg(F.collect_set("item_id").alias("evidence")).select("doc_id", F.lit("market").alias("field"), "evidence")
    fields = sector.unionByName(market).withColumn("value", F.col("field"))
    pruned = evidence.prune(fields, match, ["doc_id", "field"])
    return pruned.select("doc_id", "field", "value", F.size("evidence").cast("long").alias("n_evidence"), "annulled")


_WORDS = ("the", "license", "worthless", "ción", "und")


@query(f"WITH {_LINES}, found AS (SELECT doc_id, excerpt, min(position) AS position FROM ev WHERE {any_of('lower(excerpt)', _WORDS)} GROUP BY ALL) SELECT doc_id, position, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS rank, left(sha256(excerpt), 16) AS excerpt_hash FROM found QUALIFY rank <= 5")
def keyword_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.keyword_evidence(_docs(spark, sf_dir), _WORDS)
    return found.select("doc_id", F.col("position").cast("long").alias("position"), "rank", F.substring(F.sha2("excerpt", 256), 1, 16).alias("excerpt_hash"))


_TERMS = ", ".join(f"'{t}'" for t in V.TECH_TERMS)


_N_TERMS = len(V.TECH_TERMS)


@query(
    f"""WITH t AS (SELECT unnest([{_TERMS}]) AS term), x AS (SELECT conv_id, turn, left(trim(regexp_replace(regexp_replace('usa ' || [{_TERMS}][CAST((conv_id * 7 + turn) % {_N_TERMS} + 1 AS INT)] || ' com ' || [{_TERMS}][CAST((conv_id + turn * 3) % {_N_TERMS} + 1 AS INT)] || ' em producao', '[\\x00-\\x08\\x0e-\\x1f]', '', 'g'), '\\s+', ' ', 'g')), {V.EXCERPT_MOST}) AS excerpt FROM conversations),
m AS (SELECT conv_id, turn, term, excerpt FROM x JOIN t ON regexp_matches(excerpt, '(^|[^\\w-])' || regexp_escape(term) || '([^\\w-]|$)') WHERE length(excerpt) >= {V.EXCERPT_LEAST}),
fresh AS (SELECT * FROM m WHERE term <> [{_TERMS}][CAST(conv_id * 7 % {_N_TERMS} + 1 AS INT)])
SELECT conv_id AS company_id, term AS technology, min(turn) AS page_id FROM fresh GROUP BY ALL"""
)
def new_tech_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technologies that a thread's turns name literally and that aren't known of it: the first turn that does."""
    term = lambda n: A.pick(V.TECH_TERMS, n % _N_TERMS)
    conv, turn = F.col("conv_id"), F.col("turn")
    rows = A.table(spark, sf_dir, "conversations").select(conv.alias("company_id"), turn.alias("page_id"), F.concat(F.lit("usa "), term(conv * 7 + turn), F.lit(" com "), term(conv + turn * 3), F.lit(" em producao")).alias("text"))
    known = rows.select("company_id").distinct().select("company_id", term(F.col("company_id") * 7).alias("technology"))
    return evidence.new_signals(rows, known, most=1).select("company_id", "technology", "page_id")


@query(
    """WITH r AS (SELECT page_id % 7 AS query, page_id AS position, CASE WHEN page_id % 3 = 0 THEN upper(url) || '/' ELSE url END AS url, page_id * 7919 % 100 AS score FROM pages UNION ALL SELECT 7, page_id, url, 100 FROM pages WHERE page_id % 2 = 0),
a AS (SELECT *, lower(rtrim(url, '/')) AS address FROM r), once AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY address ORDER BY query, position) = 1),
d AS (SELECT *, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') AS domain FROM once)
SELECT query, position, domain, CAST(row_number() OVER (PARTITION BY domain ORDER BY score DESC, query, position) AS INTEGER) AS place FROM d QUALIFY place <= 2"""
)
def merged_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of eight searches as one list: an address once, two of each domain."""
    pages = A.table(spark, sf_dir, "pages")
    page = F.col("page_id")
    first = pages.select((page % 7).alias("query"), page.alias("position"), F.when(page % 3 == 0, F.concat(F.upper("url"), F.lit("/"))).otherwise(F.col("url")).alias("url"), (page * 7919 % 100).alias("score"))
    again = pages.where("page_id % 2 = 0").select(F.lit(7).cast("long").alias("query"), page.alias("position"), "url", F.lit(100).cast("long").alias("score"))
    return evidence.merged_results(first.unionByName(again), per_domain=2).select("query", "position", "domain", "place")


@query(
    f"WITH t AS (SELECT unnest([{_TERMS}]) AS term), x AS (SELECT conv_id, turn, lower(text || ' ' || CASE WHEN (conv_id + turn) % 4 = 0 THEN 'with' ELSE 'pre' END || CASE WHEN (conv_id + turn) % 2 = 0 THEN ' ' ELSE '-' END || [{_TERMS}][CAST((conv_id * 7 + turn) % {len(V.TECH_TERMS)} + 1 AS INT)] || '.') AS low FROM conversations), m AS (SELECT conv_id, turn, term FROM x JOIN t ON contains(low, term) WHERE regexp_matches(low, '(^|[^\\w\\x{{80}}-\\x{{10FFFF}}-])' || regexp_escape(term) || '([^\\w\\x{{80}}-\\x{{10FFFF}}-]|$)')) SELECT conv_id, turn, count(*) AS n, min(term) AS first_term FROM m GROUP BY ALL"
)
def tech_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("conv_id") + F.col("turn")
    told = F.concat(F.col("text"), F.lit(" "), F.when(key % 4 == 0, "with").otherwise("pre"), F.when(key % 2 == 0, " ").otherwise("-"), A.pick(V.TECH_TERMS, (F.col("conv_id") * 7 + F.col("turn")) % len(V.TECH_TERMS)), F.lit("."))
    found = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(T.tech_mentions(told)).alias("term"))
    return found.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.min("term").alias("first_term"))


_FOLDED = _FOLD.format("text")
_first = lambda table, default: "CASE " + " ".join(f"WHEN {any_of('f', words)} THEN '{name}'" for name, words in table) + f" {default} END"


@query(f"WITH d AS (SELECT doc_id, {_FOLDED} AS f FROM documents) SELECT doc_id, {_first(V.CATEGORY_WORDS, f'ELSE {chr(39)}{V.UNKNOWN}{chr(39)}')} AS category FROM d")
def product_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.category(T.fold(F.lower("text"))).alias("category"))


@query(
    f"WITH d AS (SELECT doc_id, {_FOLDED} AS f, CASE doc_id % 5 WHEN 0 THEN 'api_externa' WHEN 1 THEN 'open_weights_hospedado' WHEN 2 THEN 'self_hosted' WHEN 3 THEN 'modelo_proprio' END AS provider FROM documents) SELECT doc_id, provider, CASE WHEN provider IN ('self_hosted', 'modelo_proprio') THEN NULL ELSE {_first(V.PROVIDER_WORDS, f'WHEN provider IS NOT NULL THEN {chr(39)}{V.UNKNOWN}{chr(39)}')} END AS price_key FROM d"
)
def provider_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = F.when(F.col("doc_id") % 5 < 4, A.pick(A.PROVIDERS, F.col("doc_id") % 5 % 4))
    return _docs(spark, sf_dir).withColumn("provider", provider).select("doc_id", "provider", T.provider_key(T.fold(F.lower("text")), F.col("provider")).alias("price_key"))


_TRUST = f"""e AS (SELECT doc_id, [{quoted(V.SOURCE_TRUST)}][doc_id % 8 + 1] AS kind, [{', '.join(map(str, V.SOURCE_TRUST.values()))}][doc_id % 8 + 1] AS base, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE (doc_id * 37) % 1500 END AS age, doc_id % 97 AS company FROM documents),
trusted AS (SELECT *, base * CASE WHEN age IS NULL OR age <= 180 THEN 100 WHEN age <= 365 THEN 85 WHEN age <= 730 THEN 65 ELSE 40 END / 10000.0::DOUBLE AS trust FROM e)"""


def _trusted(spark, sf_dir) -> DataFrame:
    """Documents as evidence of companies: kind, age in days and trust from their keys."""
    key = F.col("doc_id")
    rows = _docs(spark, sf_dir).select("doc_id", A.pick(A.KINDS, key % 8).alias("kind"), F.when(key % 10 != 0, key * 37 % 1500).alias("age"), (key % 97).alias("company"))
    return rows.withColumn("trust", S.source_trust(F.col("kind"), F.col("age")) / F.lit(10000.0))


@query(f"WITH {_TRUST} SELECT doc_id, kind, age, trust FROM trusted")
def source_trust_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trusted(spark, sf_dir).select("doc_id", "kind", "age", "trust")


@query(f"WITH {_TRUST}, top AS (SELECT company, trust FROM trusted QUALIFY row_number() OVER (PARTITION BY company ORDER BY trust DESC, doc_id) <= 5) SELECT company, round(1 - product(1 - trust), 4) AS confidence FROM top GROUP BY company")
def noisy_or_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint confidence of each company's five most trusted sources; only those reach the last step."""
    from pyspark.sql import Window

    best = F.row_number().over(Window.partitionBy("company").orderBy(F.col("trust").desc(), "doc_id"))
    top = _trusted(spark, sf_dir).withColumn("n", best).where(F.col("n") <= V.TRUST_TOP)
    return top.groupBy("company").agg(S.noisy_or(F.collect_list("trust")).alias("confidence"))


_GROUNDED = " + ".join(f"CASE WHEN doc_id % {i + 2} = 0 THEN 1 ELSE 0 END" for i in range(V.PROFILE_FIELDS))


@query(f"SELECT doc_id, round(({_GROUNDED}) / 7.0::DOUBLE, 3) AS coverage, doc_id % 3 < 2 AND (doc_id % 11 = 0 OR round(({_GROUNDED}) / 7.0::DOUBLE, 3) < 0.4) AS recollect FROM documents")
def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of seven inferred fields that have evidence, and whether to collect again."""
    key = F.col("doc_id")
    share = evidence.coverage([key % (i + 2) == 0 for i in range(V.PROFILE_FIELDS)])
    rows = _docs(spark, sf_dir).select("doc_id", share.alias("coverage"))
    return rows.withColumn("recollect", evidence.recollect(key % 3, F.col("coverage"), key % 11 == 0))


_ANSWERS = "answers AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN text ELSE text || ' [' || (conv_id % 7) || ']. ' || text || ' [' || (turn % 9) || '][' || (conv_id % 7) || ']' END AS answer, 5 AS n FROM conversations WHERE text IS NOT NULL)"


def _answers(spark, sf_dir) -> DataFrame:
    c = A.table(spark, sf_dir, "conversations").where(F.col("text").isNotNull())
    mark = lambda x: F.concat(F.lit("["), x.cast("string"), F.lit("]"))
    marked = F.concat(F.col("text"), F.lit(" "), mark(F.col("conv_id") % 7), F.lit(". "), F.col("text"), F.lit(" "), mark(F.col("turn") % 9), mark(F.col("conv_id") % 7))
    return c.select("conv_id", "turn", F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.col("text")).otherwise(marked).alias("answer"))


_CITED = r"list_transform(regexp_extract_all(answer, '\[([0-9]{1,3})\]', 1), lambda x: CAST(x AS INT))"


@query(
    f"WITH {_ANSWERS}, c AS (SELECT conv_id, turn, n, list_distinct({_CITED}) AS cited FROM answers) SELECT conv_id, turn, len(list_filter(cited, lambda x: x BETWEEN 1 AND n)) AS n_cited, len(list_filter(cited, lambda x: x < 1 OR x > n)) AS n_invalid, n - len(list_filter(cited, lambda x: x BETWEEN 1 AND n)) AS n_uncited, len(list_filter(cited, lambda x: x BETWEEN 1 AND n)) / n::DOUBLE AS coverage FROM c"
)
def citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers' marks against five retrieved chunks."""
    cited = F.col("cited")
    rows = _answers(spark, sf_dir).select("conv_id", "turn", T.citations(F.col("answer")).alias("cited"))
    good = F.size(F.filter(cited, lambda i: (i >= 1) & (i <= 5))).cast("long")
    return rows.select("conv_id", "turn", good.alias("n_cited"), (F.size(cited) - good).alias("n_invalid"), (5 - good).alias("n_uncited"), (good / F.lit(5.0)).alias("coverage"))


@query(
    f"WITH {_ANSWERS}, s AS (SELECT conv_id, turn, trim(unnest(string_split(regexp_replace(trim(answer), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))) AS sentence FROM answers) SELECT conv_id, turn, count(*) AS n, min(sentence) AS first_sentence FROM s WHERE length(sentence) >= {V.CLAIM_CHARS} AND NOT regexp_matches(sentence, '^[#*-]') AND NOT regexp_matches(sentence, '{V.CITATION}') GROUP BY conv_id, turn"
)
def unsupported_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of answers that claim something and cite nothing."""
    rows = _answers(spark, sf_dir).select("conv_id", "turn", F.explode(T.unsupported_sentences(F.col("answer"))).alias("sentence"))
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.min("sentence").alias("first_sentence"))


@query(
    f"WITH {_ANSWERS}, c AS (SELECT conv_id, turn, {_CITED} AS marks FROM answers), u AS (SELECT conv_id, turn, list_filter(list_filter(marks, lambda x, i: list_position(marks, x) = i), lambda x: x BETWEEN 1 AND 5) AS used FROM c) SELECT conv_id, turn, array_to_string(list_transform(used, lambda x: 'c' || x), ',') AS chunks FROM u"
)
def cited_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that an answer really cites, in order of citation."""
    used = F.filter(T.citations(F.col("answer")), lambda i: (i >= 1) & (i <= 5))
    return _answers(spark, sf_dir).select("conv_id", "turn", F.array_join(F.transform(used, lambda i: F.concat(F.lit("c"), i.cast("string"))), ",").alias("chunks"))


@query(
    """WITH n AS (SELECT doc_id, source, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS body FROM documents),
r AS (SELECT doc_id // 5 AS request_id, doc_id AS chunk_id, doc_id % 5 AS rank, source AS url, body FROM n),
c AS (SELECT doc_id AS citation_id, doc_id // 5 AS request_id, CASE WHEN doc_id % 4 = 0 THEN 'other' ELSE source END AS url, CASE WHEN doc_id % 3 = 0 THEN substr(body, 11) ELSE left(body, 200) END AS target FROM n),
p AS (SELECT c.citation_id, r.chunk_id, r.rank, c.url = r.url AS same, contains(r.body, left(target, 80)) OR contains(target, left(r.body, 80)) AS close, sum(CASE WHEN c.url = r.url THEN 1 ELSE 0 END) OVER (PARTITION BY c.citation_id) AS n_same FROM c JOIN r USING (request_id) WHERE trim(target) <> ''),
u AS (SELECT * FROM p WHERE (n_same = 0 OR same) AND (close OR n_same = 1))
SELECT citation_id, chunk_id FROM u QUALIFY row_number() OVER (PARTITION BY citation_id ORDER BY close DESC, rank) = 1"""
)
def citation_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cited, some by a wrong URL or a cut text, against requests of five documents each."""
    docs = _docs(spark, sf_dir)
    key, norm = F.col("doc_id"), F.lower(T.squeeze(F.col("text")))
    request = F.floor(key / 5).alias("request_id")
    retrieved = docs.select(request, key.alias("chunk_id"), (key % 5).alias("rank"), F.col("source").alias("url"), "text")
    cited = docs.select(key.alias("citation_id"), request, F.when(key % 4 == 0, "other").otherwise(F.col("source")).alias("url"), F.when(key % 3 == 0, F.substring(norm, 11, 1 << 30)).otherwise(F.substring(norm, 1, 200)).alias("text"))
    return evidence.reconcile(cited, retrieved)


@query(
    "WITH c AS (SELECT doc_id, left(sha256('https://' || source || '.example.com/' || lang || '|' || text), 24) AS chunk_id FROM documents WHERE text IS NOT NULL), h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id)) AS d FROM c) SELECT doc_id, chunk_id, d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' || substr('89ab89ab89ab89ab', CAST('0x' || d[17:17] AS INT) + 1, 1) || d[18:20] || '-' || d[21:32] AS point_id FROM h"
)
def chunk_point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point ids of a vector store: version 5 UUIDs of the documents' chunk ids."""
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("lang"))
    ids = _docs(spark, sf_dir).select("doc_id", T.chunk_id(url, F.col("text")).alias("chunk_id"))
    return ids.withColumn("point_id", T.uuid5("6ba7b8119dad11d180b400c04fd430c8", F.col("chunk_id")))


@query(f"WITH {_LINES}, v AS (SELECT content_hash, max(doc_id) AS doc_id FROM ev GROUP BY 1) SELECT doc_id % 10 AS shard, count(*) AS points FROM v GROUP BY 1")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after two upserts by key: later rows replace earlier ones."""
    rows = _evidence(spark, sf_dir).groupBy("content_hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    store = merging.replace_latest(rows.select("content_hash", F.col("first").alias("doc_id")), rows.where("last > first").select("content_hash", F.col("last").alias("doc_id")), "content_hash")
    return store.groupBy((F.col("doc_id") % 10).alias("shard")).agg(F.count("*").alias("points"))
