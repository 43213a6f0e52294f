"""The pipeline's stages on the smallest tables."""

from pyspark.sql import functions as F
from test_pairs import brute_components, brute_cut

import corpus_pipeline
from ledgerscope.llm import bpe


def test_stages_one_after_another(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns or i == len(corpus_pipeline.STAGES) - 1
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4] == counts[5]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    own = bpe.vocabulary(bpe.default_path())
    for r in docs.collect():
        assert bytes(r["ids"]) == own.encode(texts[r["doc_id"]])


def test_near_copies_at_four_fifths_of_five_words_go(spark):
    base = [f"w{i}" for i in range(204)]
    scattered = [f"x{i}" if i in (20, 60, 110, 160) else w for i, w in enumerate(base)]  # 180 of 220 five-word shingles
    block = base[:162] + [f"y{i}" for i in range(18)] + base[180:]  # an edit in one place: 178 of 222
    fewer = [f"z{i}" if i in (20, 60, 90, 120, 160) else w for i, w in enumerate(base)]  # 175 of 225: no near copy
    texts = {1: base, 2: scattered, 3: block, 4: fewer}
    texts = {i: " ".join(w) for i, w in texts.items()}
    sets = {i: {tuple(t.split()[p : p + 5]) for p in range(200)} for i, t in texts.items()}
    share = {i: len(sets[1] & s) / len(sets[1] | s) for i, s in sets.items()}
    assert 0.8 <= share[3] < 0.81 < share[2] < 0.82 and share[4] < 0.8
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for near in (2, 3):
        assert [r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs.where(F.col("doc_id").isin(1, near)), "").collect()] == [1]
    kept = {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs.where("doc_id in (1, 4)"), "").collect()}
    assert kept == {1, 4}


def test_stages_after_the_classifier_equal_brute_force(spark, sf_dir, tmp_path, near_table, near_copies):
    item = " ".join(f"benchword{i}" for i in range(12))
    rows = [*near_copies, (900, " ".join([*(f"before{i}" for i in range(80)), item, *(f"after{i}" for i in range(30))]))]
    extra = spark.createDataFrame([(900, rows[-1][1], "en", "s", len(rows[-1][1]))], near_table.schema)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = near_table.union(extra)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[1:]):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    of = {i: c for i, (_, c) in brute_components(rows, 5, 80).items()}
    one = [(i, t) for i, t in rows if of[i] == i]
    cut = brute_cut(one)
    left = {i: (cut[i][2] if cut[i][1] else t) for i, t in one if i != 900}
    own = bpe.vocabulary(bpe.default_path())
    assert {r["doc_id"]: bytes(r["ids"]) for r in docs.collect()} == {i: own.encode(t or "") for i, t in left.items()}


def test_stages_on_odd_rows_and_empty_tables(spark, sf_dir, tmp_path, odd_table, empty_table):
    for name, table in (("odd", odd_table), ("none", empty_table)):
        docs = table
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, docs, sf_dir)
            assert i == len(corpus_pipeline.STAGES) - 1 or made.columns == table.columns
            made.write.parquet(f"{tmp_path}/{name}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{i}") if i else table  # the classifier's choice is tested elsewhere
        ids = sorted((r["doc_id"] or 0, r["n_tokens"] > 0) for r in docs.collect())
        assert ids == ([] if name == "none" else [(0, True), (1, False), (2, False), (3, True), (3, True), (4, True), (5, True)])
