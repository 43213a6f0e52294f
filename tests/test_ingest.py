"""Tables that change together, points with retries, the ingest program."""

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerscope import fixed_values as V
from ledgerscope.functions.text import computed, tokens
from ledgerscope.operators import evidence, ingest, retrieval
from ledgerscope.sources.shared import shared_dir
from ledgerscope.sources.tableset import TableSet, write_points

ROOT = Path(__file__).resolve().parents[1]


embed = lambda texts: [[float(len(t)), 1.0] for t in texts]  # noqa: E731  a lambda, which workers get by value


def docs(spark, rows):
    return spark.createDataFrame([(u, "Title", t, "tech", None) for u, t in rows], "url string, title string, text string, technology string, category string")


def test_a_failure_between_tables_shows_none(spark, tmp_path):
    kept = TableSet(spark, str(tmp_path), {"a": "x long", "b": "y long"})
    good, bad = spark.range(3).select(F.col("id").alias("x")), spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("y"))
    with pytest.raises(Exception, match="lost"):
        kept.append({"a": good, "b": bad}, writer="w", batch=0)
    assert kept.table("a").count() == kept.table("b").count() == 0 and not kept.done("w", 0)
    assert kept.append({"a": good, "b": good.withColumnRenamed("x", "y")}, writer="w", batch=0)
    assert not kept.append({"a": good}, writer="w", batch=0) and kept.table("a").count() == 3
    assert kept.append({"a": good}, writer="other", batch=0) and kept.table("a").count() == 6
    kept.compact()
    assert (kept.table("a").count(), kept.table("b").count()) == (6, 3)
    assert kept.done("w", 0) and kept.append({"b": spark.range(1).select(F.col("id").alias("y"))}) and kept.table("b").count() == 4
    with pytest.raises(ValueError, match="no such tables"):
        kept.append({"c": good})


def test_replayed_documents_and_batches_change_nothing(spark, tmp_path):
    kept = ingest.store(spark, str(tmp_path))
    first = docs(spark, [("u1", "# A\nEins zwei drei.\n\n# B\nVier fuenf."), ("u2", "# A\nEins zwei drei."), ("u2", "# A\nEins zwei drei."), ("u3", None), ("u4", "")])
    assert ingest.ingest(first, kept, embed, writer="w", batch=0)
    sizes = lambda: {name: kept.table(name).count() for name in ("chunks", "vectors", "postings")}
    before = sizes()
    assert before["chunks"] == before["vectors"] == 2 and before["postings"] > 0
    assert ingest.ingest(first, kept, embed, writer="w", batch=0) is None and kept.table("reports").count() == 1
    assert ingest.ingest(first, kept, embed, writer="w", batch=1) and sizes() == before
    more = docs(spark, [("u1", "# A\nEins zwei drei.\n\n# B\nVier fuenf."), ("u5", "Neu ist dies.")])
    assert ingest.ingest(more, kept, embed, writer="w", batch=2)
    last = kept.table("reports").where("batch = 2").first()
    assert (last["collected"], last["different"], last["skipped"], last["added"]) == (2, 2, 1, 1) and sizes()["chunks"] == 3
    assert kept.table("chunks").join(kept.table("vectors"), "chunk_id", "full_outer").where("embedding is null or chunk is null").count() == 0


def test_nothing_is_computed_twice(spark):
    """A filter that is pushed down would clean each line, and cut each context into terms, once more."""
    rows = docs(spark, [("u1", "eins\x01 zwei  drei vier fuenf\nkurz"), ("u2", None)])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    lines = evidence.paragraphs(rows, ["url"])
    assert plan(lines).count(r"(?U)\s+") == 1 and [r["excerpt"] for r in lines.collect()] == ["eins zwei drei vier fuenf"]
    terms = retrieval.term_rows(rows.select("url", computed(tokens(F.col("text"))).alias("terms")), "url")
    assert plan(terms).count(V.TOKEN) == 1 and "Exchange" not in terms._jdf.queryExecution().executedPlan().toString()


def test_terms_of_pieces_are_counted_where_they_are(spark, tmp_path):
    texts = ["NIM nim a-b a.b a b nim", "", None, "the", "x" * 3000 + " y" * 5000]
    kept = ingest.store(spark, str(tmp_path))
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "url string, text string")
    cut = lambda d: d.select("url", F.lit(0).alias("position"), F.col("text").alias("context"), F.col("url").alias("chunk"), F.lit("t").alias("technology"), F.lit("c").alias("category"))
    assert ingest.ingest(rows, kept, lambda texts: [[1.0] for _ in texts], cut=cut)
    wanted = [(i, term, n, len(terms)) for i, text in rows.select("url", tokens(F.col("text"))).collect() for terms in [text or []] for term, n in Counter(terms).items()]
    assert len(wanted) > 5
    found = kept.table("postings").join(kept.table("chunks").select("chunk_id", "url"), "chunk_id").select("url", "term", "tf", "length")
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_contexts_come_back_whole(spark, tmp_path):
    contexts = [("a", "a", "T > H\n\na"), ("b", "b", "b"), ("c", "c", "other"), ("d", "d", None), ("e", "e", ""), ("f", None, "f"), ("g", "", "g"), ("h", "ü\U0001f600", "é\U0001f600 ü\U0001f600")]
    cut = lambda _: spark.createDataFrame([(u, 0, c, x, "t", None) for u, x, c in contexts], "url string, position int, context string, chunk string, technology string, category string")
    kept = ingest.store(spark, str(tmp_path))
    assert ingest.ingest(docs(spark, [("u", "x")]), kept, lambda texts: [[float(len(t or ""))] for t in texts], cut=cut)
    assert sorted(map(tuple, kept.table("chunks").select("url", "chunk", "context").collect())) == sorted((u, x, c) for u, x, c in contexts)
    assert kept.table("vectors").count() == len(contexts)


def test_the_pieces_of_a_batch_go_when_they_are_stored(spark, tmp_path):
    kept, before = ingest.store(spark, str(tmp_path)), set(os.listdir(shared_dir(spark).removeprefix("file:")))
    assert ingest.ingest(docs(spark, [("u1", "# A\nEins zwei drei."), ("u2", "Vier.")]), kept, embed)
    left = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before
    assert [name.split("-")[0] for name in left] == ["known"] and kept.table("chunks").count() == kept.table("vectors").count() == 2


def test_rows_made_of_rows_that_were_written(spark, tmp_path):
    kept = TableSet(spark, str(tmp_path), {"a": "x long", "b": "n long"})
    for n in (3, 4):
        assert kept.append({"a": spark.range(n).select(F.col("id").alias("x")), "b": lambda done: done["a"].agg(F.count("*").alias("n"))})
    assert sorted(r["n"] for r in kept.table("b").collect()) == [3, 4] and kept.table("a").count() == 7


def test_a_stream_is_taken_once(spark, tmp_path):
    source, kept = str(tmp_path / "in"), ingest.store(spark, str(tmp_path / "store"))
    for text in ("# A\nEins.", "# B\nZwei."):
        docs(spark, [("u", text)]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(docs(spark, []).schema).parquet(source)
        for _ in range(2):  # a second start finds nothing new
            ingest.ingest_stream(stream, kept, embed, checkpoint=str(tmp_path / "check"), name="s")
    assert kept.table("chunks").count() == 2 and kept.table("reports").agg(F.sum("added")).first()[0] == 2
    ingest.ingest_stream(spark.readStream.schema(docs(spark, []).schema).parquet(source), kept, embed, checkpoint=str(tmp_path / "lost"), name="s")  # a lost checkpoint
    assert kept.table("chunks").count() == 2


def test_sources_and_cards(spark, tmp_path):
    (tmp_path / "sources.yaml").write_text("version: 1\nfontes:\n  - url: https://a.org/x\n    title: A\n    technology: nim\n    category: inferencia\n  - url: https://a.org/gone\n    title: B\n")
    (tmp_path / "cards").mkdir()
    (tmp_path / "cards" / "one.md").write_text("---\ntitle: Card\n---\n# Card\nQuando usar isto.")
    pages = {"https://a.org/x": "# Guia\nComo servir modelos."}
    fetch = lambda urls: [pages.get(u) for u in urls]
    kept = ingest.store(spark, str(tmp_path / "store"))
    run = lambda: ingest.ingest_sources(spark, kept, fetch, embed, registry=str(tmp_path / "sources.yaml"), cards=str(tmp_path / "cards")).first().asDict()
    report = run()
    assert report == {"documents_ok": 1, "documents_failed": 1, "failed_urls": ["https://a.org/gone"], "cards_ingested": 1, "chunks_total": 2, "different": 2, "chunks_skipped": 0, "chunks_new": 2}
    assert run() | {"chunks_skipped": 0, "chunks_new": 2} == report and kept.table("vectors").count() == 2


def test_points_are_put_in_batches(spark, tmp_path):
    folder, told = str(tmp_path), []

    def put(points):
        assert len(points) <= 5
        for p in points:
            Path(folder, str(p["id"])).write_text(str(p["vector"]))

    rows = spark.range(23).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"), F.lit("x").alias("payload")).coalesce(1)
    write_points(rows, put, finish=lambda points, batches: Path(folder, "told").write_text(f"{points} {batches}"), name="few", batch=5, size=2)
    assert Path(folder, "told").read_text() == "23 5" and len(os.listdir(folder)) == 24 and not told
    with pytest.raises(Exception, match="numbers instead of 3"):
        write_points(rows, put, name="wrong", batch=5, size=3)


RETRIED = """
import os, sys
from pathlib import Path
from pyspark.sql import SparkSession, functions as F
from ledgerscope.sources.shared import shared_dir
from ledgerscope.sources.tableset import write_points
folder = sys.argv[1]
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()

def put(points):
    for p in points:
        with open(f"{folder}/log", "a") as log:
            log.write(p["id"] + "\\n")
        Path(folder, "p" + p["id"]).write_text("x")
    if int(points[-1]["id"]) >= 10 and not os.path.exists(f"{folder}/died"):
        Path(folder, "died").touch()
        os._exit(1)

rows = spark.range(20).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0)).alias("vector")).coalesce(1)
write_points(rows, put, finish=lambda points, batches: Path(folder, "told").write_text(f"{points} {batches}"), batch=4)
"""


def test_a_killed_task_leaves_one_copy(tmp_path):
    done = subprocess.run([sys.executable, "-c", RETRIED, str(tmp_path)], env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=240)
    assert (tmp_path / "told").exists(), done.stderr[-2000:]
    log = (tmp_path / "log").read_text().split()
    assert (tmp_path / "died").exists() and len(log) == 32 and len(set(log)) == 20  # twelve were put twice
    assert (tmp_path / "told").read_text() == "20 5" and len(list(tmp_path.glob("p*"))) == 20
