"""Lexical, dense and fused retrieval over documents and vectors.

Search runs a stated set of queries against all rows: lexical search joins the
queries' terms with an index of the documents' terms, which is made once and can
be saved, loaded and upserted; dense search takes a bounded number of queries to
the vectors, or lets blocks of both meet, and passes on the best of each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope import fixed_values as V
from ledgerscope.functions.text import tokens
from ledgerscope.sources.readers import read_index
from ledgerscope.sources.shared import materialize

#: Vectors and queries of a block.
ROWS, QUERIES = 8192, 4096


def term_lists(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, terms, length`` of each document."""
    return docs.select(key, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("terms")).withColumn("length", F.size("terms"))


@dataclass(frozen=True)
class Index:
    """A lexical index: ``postings`` (doc_id, term, tf, length), ``documents`` (doc_id, length), those without terms too, and ``terms`` (term, df)."""

    postings: DataFrame
    documents: DataFrame
    terms: DataFrame

    def stored(self) -> "Index":
        return Index(*(materialize(df, name) for df, name in ((self.postings, "postings"), (self.documents, "documents"), (self.terms, "terms"))))


def counted(terms: Column) -> Column:
    """``term, tf`` of a list of terms: the list is sorted, and each stretch of equal terms told by where it begins."""

    def stretches(x: Column) -> Column:
        s = x["s"]
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        placed = F.transform(F.array(F.struct(s.alias("s"), begins.alias("b"))), lambda y: F.transform(y["b"], lambda i, k: F.struct(F.get(y["s"], i).alias("term"), (F.coalesce(F.get(y["b"], k + 1), F.size(y["s"])) - i).cast("long").alias("tf"))))[0]
        return F.when(F.size(s) > 0, placed).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))

    return F.transform(F.array(F.struct(F.sort_array(terms).alias("s"))), stretches)[0]


def term_rows(lists: DataFrame, key: str) -> DataFrame:
    """``key, term, tf, length`` for each different term of each list (key, terms): a sorted list's stretches of equal terms are told apart by a pattern; terms hold no line ends."""
    lines = F.concat(F.array_join(F.sort_array("terms"), "\n"), F.lit("\n"))
    rows = lists.select(key, F.size("terms").cast("long").alias("length"), F.explode(F.regexp_extract_all(lines, F.lit(r"([^\n]++\n)\1*+"), 0)).alias("stretch"))
    term = F.substring_index("stretch", "\n", 1)
    return rows.select(key, term.alias("term"), (F.length("stretch") / (F.length(term) + 1)).cast("long").alias("tf"), "length")


def _terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def index_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Terms are counted where their document is read: no text moves, and what is shuffled is a count a term."""
    lists = materialize(docs.select(F.col(key).alias("doc_id"), counted(F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))).alias("terms")), "lists")
    length = F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + t["tf"])
    sized = lists.select("doc_id", "terms", length.alias("length"))
    postings = sized.select("doc_id", "length", F.explode("terms").alias("t")).select("doc_id", "t.term", "t.tf", "length")
    return Index(postings, sized.select("doc_id", "length").distinct(), materialize(_terms(postings), "terms"))


_KNOWN: dict[tuple, Index] = {}


def _is_there(index: Index) -> bool:
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        index.documents.limit(1).collect()
        index.terms.limit(1).collect()
    except (Py4JJavaError, PySparkException):  # somebody has cleared the shared folder
        return False
    return True


def index_once(docs: DataFrame) -> Index:
    """The index of a table's documents (doc_id, text), made the first time that this application asks for it, or when it is gone; the table's files are its name."""
    name = (docs.sparkSession.sparkContext.applicationId, tuple(sorted(docs.inputFiles())))
    if name not in _KNOWN or not _is_there(_KNOWN[name]):
        _KNOWN[name] = index_of(docs)
    return _KNOWN[name]


def save_index(index: Index, path: str) -> None:
    index.postings.write.mode("overwrite").parquet(f"{path}/postings")
    index.documents.write.mode("overwrite").parquet(f"{path}/documents")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")


def load_index(spark, path: str) -> Index:
    """A saved index, or an empty one where nothing was saved."""
    return Index(read_index(spark, f"{path}/postings", "doc_id long, term string, tf long, length long"), read_index(spark, f"{path}/documents", "doc_id long, length long"), read_index(spark, f"{path}/terms", "term string, df long"))


def upsert(index: Index, docs: DataFrame) -> Index:
    """``index`` with ``docs``, which replace those of the same id; only the terms of replaced and new documents are counted again."""
    new = index_of(docs)
    old = lambda df: df.join(new.documents.select("doc_id"), "doc_id", "left_anti")
    gone = _terms(index.postings.join(new.documents.select("doc_id"), "doc_id", "left_semi")).select("term", (-F.col("df")).alias("df"))
    terms = index.terms.unionByName(new.terms).unionByName(gone).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    return Index(old(index.postings).unionByName(new.postings), old(index.documents).unionByName(new.documents), terms)


def term_stats(index: Index) -> DataFrame:
    """``term, df, idf``: in how many documents a term is, and its weight; a negative weight becomes a share of the mean weight."""
    return _weighed(index, index.terms)


def _weighed(index: Index, terms: DataFrame) -> DataFrame:
    """``term, df, idf`` of some of the index' terms; the mean that common terms fall back to is that of all."""
    n = index.documents.count()
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = index.terms.agg(F.avg(raw)).first()[0]
    return terms.select("term", "df", F.when(raw < 0, V.BM25_EPSILON * F.lit(mean)).otherwise(raw).alias("idf"))


def top_k(scored: DataFrame, k: int, query: str = "query_id", key: str = "doc_id", score: str = "score") -> DataFrame:
    """The ``k`` best rows of each query with their ``rank``; ties by key."""
    best = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def bm25_scores(index: Index, queries: DataFrame) -> DataFrame:
    """``query_id, doc_id, score`` (six places) of the documents that share a term with a query (query_id, text)."""
    n, total = index.documents.agg(F.count("*"), F.sum("length")).first()
    mean = (total or 0) / max(n, 1)
    asked = term_lists(queries, "query_id").select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    wanted = asked.join(_weighed(index, index.terms.join(asked.select("term").distinct(), "term", "left_semi")), "term")
    norm = V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("length") / F.lit(mean))
    part = F.col("times") * F.col("idf") * F.col("tf") * (V.BM25_K1 + 1) / (F.col("tf") + norm)
    return index.postings.join(wanted, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def restrict(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns equal a value or are one of a list; an empty list restricts nothing."""
    for column, value in wanted.items():
        if value is None or (not isinstance(value, str) and hasattr(value, "__len__") and not len(value)):
            continue
        values = [value] if isinstance(value, str) or not hasattr(value, "__len__") else list(value)
        df = df.where(F.col(column).isin(*values))
    return df


def bm25_filtered(index: Index, docs: DataFrame, queries: DataFrame, k: int, condition: Column) -> DataFrame:
    """The best ``3 k`` of each query, then those that meet ``condition``, then the best ``k``: in this order, which changes the result."""
    wide = top_k(bm25_scores(index, queries), 3 * k).drop("rank")
    return top_k(wide.join(docs.where(condition).select("doc_id"), "doc_id"), k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors as columns, in doubles; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unit(vectors) -> np.ndarray:
    """Vectors (an Arrow list column) as rows of length one."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _nearest(queries: np.ndarray, keys: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and cosines (six places) of the ``k`` nearest vectors of each query; ``keys`` ascend, so ties go to the smallest."""
    near_keys, near_scores = [], []
    for at in range(0, len(queries), 256):
        scores = np.round(queries[at : at + 256] @ vectors.T, 6)
        near = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        near_keys.append(keys[near])
        near_scores.append(np.take_along_axis(scores, near, 1))
    return np.concatenate(near_keys), np.concatenate(near_scores)


NEAR = "query_id long, doc_id long, score double"


def _near_table(ids: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.repeat(ids, keys.shape[1])), pa.array(keys.ravel()), pa.array(scores.ravel())]


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", vector: str = "embedding", most: int = QUERIES) -> DataFrame:
    """``query_id, doc_id, score, rank`` of the ``k`` nearest vectors by cosine (six places) of each query (query_id, vector).

    Up to ``most`` queries go to the tasks, which read vectors where they are
    and pass on the best ``k`` of each query: no vector moves.  More queries
    are dealt into blocks, and so are vectors; each two blocks meet in one task.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(vector).alias("v"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col(vector).alias("v"))
    held = asked.limit(most + 1).toArrow()
    if held.num_rows > most:
        return top_k(_between_blocks(rows, asked, k), k)
    if not held.num_rows:
        return top_k(rows.sparkSession.createDataFrame([], NEAR), k)
    ids, left = held.column("query_id").to_numpy(), _unit(held.column("v").combine_chunks())

    def best(batches):
        keys, scores = np.empty((len(ids), 0), np.int64), np.empty((len(ids), 0))
        for batch in batches:
            own = batch.column(0).to_numpy()
            order = np.argsort(own, kind="stable")
            found = _nearest(left, own[order], _unit(batch.column(1))[order], k) if len(own) else (keys[:, :0], scores[:, :0])
            keys, scores = np.concatenate([keys, found[0]], axis=1), np.concatenate([scores, found[1]], axis=1)
            by = np.lexsort((keys, -scores), axis=1)[:, :k]
            keys, scores = np.take_along_axis(keys, by, 1), np.take_along_axis(scores, by, 1)
        yield pa.RecordBatch.from_arrays(_near_table(ids, keys, scores), names=["query_id", "doc_id", "score"])

    return top_k(rows.mapInArrow(best, NEAR), k)


def _between_blocks(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each block of vectors for each query, however many queries there are."""
    many = lambda df, size: max(1, -(-df.count() // size))
    of_rows, of_asked = many(rows, ROWS), many(asked, QUERIES)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    placed = rows.withColumn("r", F.pmod(F.xxhash64("doc_id"), F.lit(of_rows)).cast("int")).withColumn("q", every(of_asked))
    sought = asked.withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(of_asked)).cast("int")).withColumn("r", every(of_rows))

    def best(asked: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["query_id", "doc_id", "score"]
        if not asked.num_rows or not rows.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        rows = rows.sort_by("doc_id")
        found = _nearest(_unit(asked.column("v").combine_chunks()), rows.column("doc_id").to_numpy(), _unit(rows.column("v").combine_chunks()), k)
        return pa.table(_near_table(asked.column("query_id").to_numpy(), *found), names=names)

    return sought.groupBy("q", "r").cogroup(placed.groupBy("q", "r")).applyInArrow(best, NEAR)


def fuse(dense: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, doc_id, score, rank), ties by document."""
    d = dense.select("query_id", "doc_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    x = lexical.select("query_id", "doc_id", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    part = lambda rank: F.coalesce(1.0 / (V.RRF_K + F.col(rank)), F.lit(0.0))
    both = d.join(x, ["query_id", "doc_id"], "full_outer").withColumn("rrf_score", F.round(part("dense_rank") + part("bm25_rank"), 9))
    return top_k(both, k, score="rrf_score")


def rerank(fused: DataFrame, n: int, scorer=None, *, strict: bool = False) -> DataFrame:
    """The ``n`` best by a provider's ``rerank_score``; without a provider those by fused score with a null score, or an error."""
    if scorer is None:
        if strict:
            raise ValueError("no reranker")
        return top_k(fused.drop("rank").withColumn("rerank_score", F.lit(None).cast("double")), n, score="rrf_score")
    return top_k(scorer(fused.drop("rank")), n, score="rerank_score")


def positional(chunks: DataFrame, ranking: DataFrame) -> DataFrame:
    """A reranker's answer (query_id, index, rerank_score) joined with the list that it was given (query_id, rank from 1): by position; an index outside of the list is an error, not a row less."""
    sizes = chunks.groupBy("query_id").agg(F.count("*").alias("__n"))
    known = ranking.join(sizes, "query_id", "left")
    wrong = F.col("index").isNull() | (F.col("index") < 0) | (F.col("index") >= F.coalesce("__n", F.lit(0)))
    message = F.format_string("rank %s outside of the list of query %s", F.col("index"), F.col("query_id"))
    placed = known.withColumn("rank", F.when(wrong, F.raise_error(message).cast("int")).otherwise(F.col("index") + 1).cast("int"))
    return placed.select("query_id", "rank", "rerank_score").join(chunks, ["query_id", "rank"])


def rerank_or_half(chunks: DataFrame, ranking: DataFrame, unavailable: DataFrame, n: int) -> DataFrame:
    """``query_id, doc_id, place``: the ``n`` best of each query by the reranker; of queries that it failed (``unavailable``) the upper half of the fused list, one at least."""
    answered = positional(chunks.join(unavailable, "query_id", "left_anti"), ranking.join(unavailable, "query_id", "left_anti"))
    best = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    ranked = answered.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)
    failed = chunks.join(unavailable, "query_id", "left_semi").withColumn("__n", F.count("*").over(Window.partitionBy("query_id")))
    half = failed.where(F.col("rank") <= F.greatest(F.floor(F.col("__n") / 2), F.lit(1))).withColumn("rerank_score", F.lit(None).cast("double")).withColumn("place", F.col("rank"))
    columns = ["query_id", "doc_id", "rerank_score", "place"]
    return ranked.select(*columns).unionByName(half.select(*columns))


def by_company(found: DataFrame, axes: DataFrame) -> DataFrame:
    """``company_id, doc_id, axis_order, place``: what the queries of a company's axes (query_id, company_id, axis_order) found, each chunk where it came first."""
    first = F.min(F.struct("axis_order", "place")).alias("at")
    return found.join(axes, "query_id").groupBy("company_id", "doc_id").agg(first).select("company_id", "doc_id", "at.axis_order", "at.place")
