"""Lexical counts without a shuffle, the index of a table made once, dense search by both ways."""

import random
import shutil
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerscope.operators import retrieval


def test_terms_are_counted_where_they_are(spark):
    r = random.Random(3)
    lists = [[r.choice("abcdefg") for _ in range(r.randint(0, 40))] for _ in range(50)] + [[], None, ["x"] * 9]
    got = spark.createDataFrame(list(enumerate(lists)), "i int, t array<string>").select("i", retrieval.counted(F.col("t")).alias("c")).collect()
    assert all({x["term"]: x["tf"] for x in row["c"] or []} == Counter(lists[row["i"]] or []) for row in got)
    plan = retrieval.index_of(spark.createDataFrame([(1, "alpha beta")], "doc_id long, text string")).postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_table_is_indexed_once(spark, sf_dir):
    docs = lambda: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    first = retrieval.index_once(docs())
    assert first is retrieval.index_once(docs())
    shutil.rmtree(first.terms.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])  # a cleared folder
    again = retrieval.index_once(docs())
    assert again is not first and again.terms.count() > 0


def test_dense_search_by_both_ways(spark):
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(300, 6)), 2)
    x[7] = x[8] = x[9]  # ties go to the smallest key
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "doc_id long, embedding array<float>").repartition(5)
    asked = rows.where("doc_id % 50 = 9 or doc_id = 999").select(F.col("doc_id").alias("query_id"), "embedding")
    unit = x.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = set()
    for q in range(9, 300, 50):
        scores = np.round(unit @ unit[q], 6)
        want |= {(q, int(i), rank + 1) for rank, i in enumerate(np.lexsort((np.arange(300), -scores))[:4])}
    for most in (1, 4096):
        assert {(a["query_id"], a["doc_id"], a["rank"]) for a in retrieval.dense_top_k(rows, asked, 4, most=most).collect()} == want
    assert retrieval.dense_top_k(rows, asked.limit(0), 4).count() == 0 and retrieval.dense_top_k(rows.limit(0), asked, 4).count() == 0


def test_positions_of_a_reranker(spark):
    import pytest

    chunks = spark.createDataFrame([(q, 10 * q + k, k + 1) for q in (1, 2, 3) for k in range(q)], "query_id long, doc_id long, rank int")
    ranking = lambda *rows: spark.createDataFrame(rows, "query_id long, index int, rerank_score double")
    none = spark.createDataFrame([(2,)], "query_id long")
    got = {(r["query_id"], r["doc_id"], r["place"]) for r in retrieval.rerank_or_half(chunks, ranking((1, 0, 0.1), (3, 2, 0.9), (3, 0, 0.9), (3, 1, 0.2)), none, 2).collect()}
    assert got == {(1, 10, 1), (3, 30, 1), (3, 32, 2), (2, 20, 1)}
    for wrong in ((1, 1, 0.5), (1, -1, 0.5), (9, 0, 0.5)):
        with pytest.raises(Exception, match="outside of the list"):
            retrieval.positional(chunks, ranking(wrong)).collect()


def test_intermediate_tables_can_be_removed(spark):
    import os

    from ledgerscope.sources import shared

    made = shared.materialize(spark.range(5), "gone")
    folder = made.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    name = "t" + "0" * 32
    spark.range(3).write.format("parquet").bucketBy(2, "id").option("path", f"{shared.shared_dir(spark)}/{name}").saveAsTable(name)
    keep, shared._MADE = set(shared._MADE) - {folder, f"file:{folder}", f"file://{folder}"}, {p for p in shared._MADE if p.endswith(folder.rsplit("/", 1)[1])}
    try:
        assert os.path.isdir(folder) and shared.clear(spark) >= 2
        assert not os.path.exists(folder) and not spark.catalog.tableExists(name) and not shared._MADE
    finally:
        shared._MADE |= keep
