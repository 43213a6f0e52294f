"""Operators that no query states exactly: chunks, merging, citations, sources, sinks, providers, streams."""

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from ledgerscope.functions.text import unescaped
from ledgerscope.functions.urls import joined
from ledgerscope.operators import chunking, evidence, folds, history, merging, read_models, retrieval, routing, web
from ledgerscope.sources import readers, writers


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


def test_sections_follow_their_headings(spark):
    found = one(spark, chunking.sections(F.col("t")), "intro\n# A\na\n## B ##\nb\n#no heading\n# C\nc\n## D\n### E\n## F\nf")
    assert [(r["path"], r["body"]) for r in found] == [([], "intro"), (["A"], "a"), (["A", "B"], "b\n#no heading"), (["C"], "c"), (["C", "F"], "f")]


def test_siblings_merge_and_strangers_do_not(spark):
    found = one(spark, chunking.merged(chunking.sections(F.col("t")), 100), "# A\n## x\n1\n## y\n2\n# B\n## z\n3")
    assert [(r["path"], r["body"]) for r in found] == [(["A", "x"], "1\n\n## y\n2"), (["B", "z"], "3")]


def test_units_are_paragraphs_sentences_or_windows_of_words(spark):
    text = "short one\n\n  \nA first sentence of it. A second sentence of it!\n\n" + "w " * 30
    assert one(spark, chunking.units(F.col("t"), 7), text) == ["short one", "A first sentence of it.", "A second sentence of it!", *["w w w w w"] * 6]


def brute_spans(costs, target, room):
    out, first = [], 0
    for i in range(len(costs)):
        if i > first and sum(costs[first : i + 1]) > target:
            out.append((first, i))
            fits = [s for s in range(first + 1, i) if sum(costs[s:i]) <= room or s == i - 1]
            first = min(fits) if fits and room > 0 else i
    return [*out, (first, len(costs))] if costs else []


@pytest.mark.parametrize(("target", "room"), [(10, 3), (10, 0), (7, 7), (1, 1)])
def test_spans_pack_units(spark, target, room):
    r = random.Random(target)
    lists = [[r.randint(1, 9) for _ in range(n)] for n in (0, 1, 2, 9, 40)]
    rows = spark.createDataFrame([(x,) for x in lists], "c array<bigint>").select("c", chunking.spans(F.col("c"), target, room).alias("s")).collect()
    for r in rows:
        assert [tuple(x) for x in r["s"]] == brute_spans(r["c"], target, room)


def test_chunks_overlap_by_whole_units(spark):
    text = "\n\n".join(f"Parágrafo número {i} com algumas palavras." for i in range(12))
    found = chunking.chunk(spark.createDataFrame([(1, text)], "doc_id long, text string"), target=40, overlap=0.3).orderBy("position").collect()
    chunks = [r["chunk"] for r in found]
    assert len(chunks) > 1 and [r["position"] for r in found] == list(range(len(found)))
    for a, b in zip(chunks, chunks[1:], strict=False):
        assert a.split("\n\n")[-1] == b.split("\n\n")[0]
    assert all(r["token_estimate"] <= 60 for r in found)


def test_chunks_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id long, text string")
    assert [(r["doc_id"], r["chunk"]) for r in chunking.chunk(docs).collect()] == [(3, "x")]


def test_merge_keeps_what_is_known(spark):
    schema = "company_id long, name string, stage string, tags array<string>"
    old = spark.createDataFrame([(1, "A", "seed", ["x"])], schema)
    new = spark.createDataFrame([(1, None, "desconhecido", []), (2, "B", "desconhecido", None)], schema)
    rows = {r["company_id"]: (r["name"], r["stage"], r["tags"]) for r in merging.merge_companies(old, new).collect()}
    assert rows == {1: ("A", "seed", ["x"]), 2: ("B", "desconhecido", None)}


def test_fusion_prefers_consensus(spark):
    rows = lambda ids: spark.createDataFrame([(1, i, 1.0, n + 1) for n, i in enumerate(ids)], "query_id long, doc_id long, score double, rank int")
    assert [r["doc_id"] for r in retrieval.fuse(rows([7, 5]), rows([9, 5]), 3).orderBy("rank").collect()] == [5, 7, 9]


def test_restrict_ignores_empty_lists(spark):
    df = spark.createDataFrame([("a",), ("b",)], "technology string")
    assert retrieval.restrict(df, technology=[]).count() == 2 and retrieval.restrict(df, technology="a").count() == 1


def test_rerank_without_provider(spark):
    fused = spark.createDataFrame([(1, 2, 0.5, 1)], "query_id long, doc_id long, rrf_score double, rank int")
    assert retrieval.rerank(fused, 5).first()["rerank_score"] is None
    with pytest.raises(ValueError):
        retrieval.rerank(fused, 5, strict=True)


def test_literal_matches_of_short_and_long_excerpts(spark):
    texts = spark.createDataFrame([(1, "xxUm  trecho LITERAL de sete palavras aqui mesmoyy"), (2, "curto")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "um trecho literal de sete palavras aqui mesmo"), (2, "Curto"), (3, "outro trecho que não está em nenhum texto")], "item_id long, text string")
    assert sorted(tuple(r) for r in evidence.literal_matches(texts, items).collect()) == [(1, 1), (2, 2)]


def test_reconcile_takes_the_only_chunk_of_a_url(spark):
    cited = spark.createDataFrame([(1, 1, "u", "texto irreconhecível"), (2, 1, "w", "nada"), (3, 1, "v", "abc def")], "citation_id long, request_id long, url string, text string")
    chunks = spark.createDataFrame([(1, 10, 1, "u", "o texto real"), (1, 11, 2, "v", "ABC  def ghi"), (1, 12, 3, "v", "zzz")], "request_id long, chunk_id long, rank int, url string, text string")
    assert sorted(tuple(r) for r in evidence.reconcile(cited, chunks).collect()) == [(1, 10), (3, 11)]


def test_budget_refuses_without_cost(spark):
    calls = spark.createDataFrame([("k", i, float(a)) for i, a in enumerate((3, 4, 5, 1, 2))], "k string, i int, a double")
    assert [r["accepted"] for r in folds.budget(calls, "k", ["i"], "a", 9).orderBy("i").collect()] == [True, True, False, True, False]


def test_failures_stop_nothing(spark):
    done, failed = routing.run_stage(spark.createDataFrame([(1,), (0,)], "n int"), "score", "n", lambda r: {"x": 1 // r["n"]}, "out")
    assert [r["n"] for r in done.collect()] == [1]
    row = failed.first()
    assert (row["node"], row["n"], row["kind"]) == ("score", 0, "mundo")


def test_recommendations_without_citation_are_dropped(spark):
    recs = spark.createDataFrame([(1, "NIM", 1), (1, "NIM", 2), (2, "Riva", 3)], "recommendation_id long, technology string, citation_id long")
    kept, dropped = routing.sanitise(recs, spark.createDataFrame([(1, 10), (2, 10)], "citation_id long, chunk_id long"))
    assert [tuple(r) for r in kept.collect()] == [(1, "NIM", [10])] and [r["technology"] for r in dropped.collect()] == ["Riva"]


def test_media_outlets_by_article_links(spark):
    page = lambda n, host: "".join(f'<a href="{host}/noticia/{i}">x</a>' for i in range(n))
    rows = spark.createDataFrame([(page(20, ""),), (page(5, ""),), (page(20, "https://fora.com"),)], "h string")
    assert [r[0] for r in rows.select(web.article_links(F.col("h"), F.lit("https://www.p.com.br/"))).collect()] == [20, 5, 0]


def test_links_are_joined_to_their_page(spark):
    bases = ["https://a.com.br", "https://a.com.br/x/y?q=1", "http://a.com/x/"]
    links = ["/v", "v.html", "../v", "./v", "?p=2", "//b.com/z", "https://c.com/d", "a/../../b", "v#top", "#top", "x?u=../a"]
    pairs = [(b, x) for b in bases for x in links]
    rows = spark.createDataFrame(pairs, "b string, x string").select(joined(F.col("b"), F.col("x"))).collect()
    assert [r[0] for r in rows] == [urljoin(b, x) for b, x in pairs]


def test_links_jobs_and_clients(spark):
    html = (
        '<a href="/vagas">Vagas</a><a href="/pricing">Preço</a><a href="/pricing/">again</a><a href="mailto:x@y.z">m</a><a href=\'https://b.com/q\'><b>Trabalhe</b> conosco: vagas</a>'
        "<h2>Engenheiro de Software</h2><ul><li><span>Engenheiro de software</span></li><li>Vendas</li></ul>"
        '<section><h2>Nossos clientes</h2><img alt="Logo Banco X"><img title="banco x"><p>Loja Y</p><p>um texto que tem mais de cinco palavras</p></section>'
        '<div class="logos"><img alt="Z S.A."></div><h3>Outros</h3><img alt="nada">'
    )
    pages = spark.createDataFrame([(1, "https://a.com.br/sobre", html), (2, None, None), (3, "x", "")], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in web.page_links(pages).collect()}
    assert found[1]["career_links"] == ["https://a.com.br/vagas", "https://b.com/q"] and found[1]["signal_links"] == ["https://a.com.br/pricing"]
    assert found[1]["job_titles"] == ["Engenheiro de Software"] and found[1]["client_names"] == ["Banco X", "Loja Y", "Z S.A."]  # container by container
    assert all(found[i][c] == [] for i in (2, 3) for c in ("career_links", "signal_links", "job_titles", "client_names"))


def test_registry_and_cards(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("version: 1\nnim:\n  - url: https://a/\n    title: \"A\"\n    category: inferencia\n    technology: NIM\n  - title: sem url\ncards_manuais:\n  - url: https://b/\n")
    assert [(r["section"], r["url"], r["title"]) for r in readers.registry(spark, str(tmp_path / "s.yaml")).collect()] == [("nim", "https://a/", "A")]
    (tmp_path / "a.md").write_text("---\ntitle: Cartão\ntechnology: cuDF\n---\n# T\ncorpo")
    (tmp_path / "b.md").write_text("# Título\ncorpo")
    (tmp_path / "_c.md").write_text("x")
    (tmp_path / "README.md").write_text("x")
    (tmp_path / "d.md").write_text("---\ntitle: vazio\n---\n")
    assert [(r["slug"], r["title"], r["technology"]) for r in readers.cards(spark, str(tmp_path)).collect()] == [("a", "Cartão", "cuDF"), ("b", "Título", None)]


def test_cache_time_to_live(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    cache = spark.sql("SELECT * FROM VALUES ('a', '1', TIMESTAMP '2024-01-02'), ('b', '2', TIMESTAMP '2023-01-01') AS t(key, value, stored_at)")
    hits, misses = readers.cache_get(asked, cache, F.lit("2024-01-03").cast("timestamp"))
    assert [r["key"] for r in hits.collect()] == ["a"] and sorted(r["key"] for r in misses.collect()) == ["b", "c"]
    assert readers.cache_get(asked, cache, F.lit("2024-01-03").cast("timestamp"), -1)[0].count() == 2


def test_upsert_replaces_and_reads_back(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v array<int>")
    writers.upsert(rows(("a", [1]), ("b", [2])), str(tmp_path), "k")
    got = writers.upsert(rows(("b", [3])), str(tmp_path), "k")
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [("a", [1]), ("b", [3])]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("Ação & Cia", "# x")], "name string, markdown string")
    writers.write_markdown(df, str(tmp_path / "md"))
    writers.write_json(df, str(tmp_path / "json"))
    assert (tmp_path / "md" / "slug=acao-cia").exists() and spark.read.text(str(tmp_path / "json")).first()[0].startswith('{"name"')
    assert writers.append({"a": df, "b": df.withColumn("x", F.raise_error(F.lit("no")).cast("string"))}, str(tmp_path / "t"), ("b", "a"))[0][0] == "b"
    assert spark.read.parquet(str(tmp_path / "t" / "a")).count() == 1


def test_provider_counts_answers(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    assert sorted(r["n"] for r in readers.provided(df, lambda xs: [float(len(x)) for x in xs], "t", "n", "double").collect()) == [1.0, 1.0]
    with pytest.raises(Exception, match="answers"):
        readers.provided(df, lambda xs: [], "t", "n", "double").collect()


def test_json_isolation_and_prompts(spark):
    told = lambda t: one(spark, readers.json_object(F.col("t")), t)
    assert told('<think>{"no": 1}</think> x ```json\n{"a": "}", "b": {"c": 1}} tail```') == '{"a": "}", "b": {"c": 1}}'
    assert told("none") is None and told('{"open": 1') is None and told(None) is None
    assert told('a " {"q": "\\"}", "e": "\\\\"} {"next": 1}') == '{"q": "\\"}", "e": "\\\\"}' and told("{}}") == "{}" and told('{"a": {"b": "{"}}') == '{"a": {"b": "{"}}'
    assert readers.render("olá {{ nome }}", {"nome": "x"}) == "olá x"
    with pytest.raises(ValueError):
        readers.render("olá {{ nome }}", {})


def test_robots(spark):
    pages = spark.createDataFrame([("h", "/a/b"), ("h", "/c"), ("g", "/a")], "host string, path string")
    rules = spark.createDataFrame([("h", "*", "/a", False), ("h", "*", "/a/b", True)], "host string, agent string, prefix string, allow boolean")
    assert {(r["host"], r["path"]): r["allowed"] for r in readers.robots_allows(pages, rules).collect()} == {("h", "/a/b"): True, ("h", "/c"): True, ("g", "/a"): True}


def test_stream_waits(spark, tmp_path):
    from ledgerscope.streaming import events

    spark.sql("SELECT 'h' AS host, TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts FROM range(3)").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = events.drain(events.waits(events.stream(spark, str(tmp_path / "in")), 2.0)).orderBy("ts").collect()
    assert [r["wait"] for r in rows] == [0.0, 1.0, 2.0]


def test_weights_and_prices_are_checked():
    read_models.checked_weights({"a": 60, "b": 40}, {"gpu": 1.5})
    for weights, prices in (({"a": 60}, {}), ({"a": 100}, {"gpu": 0}), ({"a": 100}, {"gpu": float("nan")})):
        with pytest.raises(ValueError):
            read_models.checked_weights(weights, prices)


def test_no_answer_without_a_chunk(spark):
    rows = spark.createDataFrame([("c", 1), ("", 0)], "c string, n int").select("n", read_models.grounded(F.col("c"), F.col("n"), F.lit("q")).alias("t"))
    assert rows.where("n = 1").first()["t"] == "c\n\nq"
    with pytest.raises(Exception, match="no chunk"):
        rows.where("n = 0").collect()


def test_orphan_references_are_left_out(spark):
    rows = spark.createDataFrame([(1, [5, 9, 5, 4]), (2, [9]), (3, [])], "run long, refs array<long>")
    store = spark.createDataFrame([(4, "d"), (5, "e")], "ref long, v string")
    assert {r["run"]: [tuple(x) for x in r["found"]] for r in read_models.resolved(rows, "refs", store, "ref", "run").collect()} == {1: [(5, "e"), (5, "e"), (4, "d")]}


def test_index_is_saved_loaded_and_upserted(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "beta delta")], "query_id long, text string")
    assert retrieval.load_index(spark, f"{tmp_path}/none").documents.count() == 0
    retrieval.save_index(retrieval.index_of(docs), f"{tmp_path}/i")
    index = retrieval.upsert(retrieval.load_index(spark, f"{tmp_path}/i"), spark.createDataFrame([(2, "delta delta"), (4, "epsilon")], "doc_id long, text string"))
    fresh = spark.createDataFrame([(1, "alpha beta"), (2, "delta delta"), (3, None), (4, "epsilon")], "doc_id long, text string")
    found, want = (sorted(map(tuple, retrieval.bm25_scores(i, asked).collect())) for i in (index, retrieval.index_of(fresh)))
    assert found == want and [x[1] for x in found] == [1, 2] and index.documents.count() == 4


def test_literal_matches_of_any_length(spark):
    texts = ["Alpha beta gamma delta epsilon zeta eta", "xalpha beta gammay", "gamma  DELTA epsilon", "", None, "eta"]
    excerpts = ["alpha beta gamma", "beta gamma delta epsilon zeta", "gamma delta", "eta", "alpha beta gamma delta epsilon zeta eta", "", "beta gamma delta epsilon zeta et"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(excerpts)), "item_id long, text string")
    norm = lambda t: " ".join((t or "").lower().split())
    want = sorted((i, j) for i, t in enumerate(texts) if t is not None for j, e in enumerate(excerpts) if norm(e) and norm(e) in norm(t))
    assert sorted(map(tuple, evidence.literal_matches(docs, items).collect())) == want
    assert evidence.literal_matches(docs, items.where("false")).count() == 0


def test_character_references(spark):
    text = "a &amp; b &lt;c&gt; &eacute;&#233;&#xE9; &#128512; &nope; &#0; &amp;lt; &notin;"
    assert one(spark, unescaped(F.col("t")), text) == "a & b <c> ééé \U0001f600 &nope; &#0; &lt; ∉"


def test_rows_are_numbered_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    got = [(r["x"], r["n"]) for r in history.numbered(rows.repartition(7), "x", "n").orderBy("x").collect()]
    assert [n for _, n in got] == list(range(1, 1001))


def test_briefings_of_one_name_stay_apart(spark, tmp_path):
    from ledgerscope.sources import writers

    df = spark.createDataFrame([("Acme SA", f"# {i}\n\nText.") for i in range(5)], "name string, markdown string").coalesce(1)
    writers.write_markdown(df, f"{tmp_path}/md")
    assert sorted(r["value"][:3] for r in spark.read.text(f"{tmp_path}/md", wholetext=True).collect()) == [f"# {i}" for i in range(5)]


def test_markdown_of_every_company_is_exported(spark, tmp_path):
    from ledgerscope.plans.catalogue import QUERIES

    spark.createDataFrame([(1, "BRAZIL")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    names = [(i, f"Company {i // 2}", 1 if i % 3 else None, 0.0, "s") for i in range(101)]
    spark.createDataFrame(names, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = QUERIES["exported_markdown"](spark, str(tmp_path)).collect()
    assert sorted((r["slug"], r["first_line"]) for r in got) == sorted((f"company-{i // 2}", f"# Company {i // 2}") for i in range(101))


def test_markdown_is_read_back(spark, tmp_path):
    from ledgerscope.sources import writers

    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.exports.link./md", f"file://{tmp_path}")
    rows = [("007", "# a\n\nÇ."), ("007", "# b"), ("007", "# b"), ("Ação & Cia", "# c" * 1_500_000), ("x", ""), (None, None)]
    want = sorted(({"Ação & Cia": "acao-cia"}.get(n, n), f"{t}\n\n") for n, t in rows if n)
    for folder in (f"{tmp_path}/mounted of all", "viewfs://exports/md/spark"):
        writers.write_markdown(spark.createDataFrame([("old", "# old")], "name string, markdown string"), folder)
        writers.write_markdown(spark.createDataFrame(rows, "name string, markdown string"), folder)
        got = [(r["slug"], r["value"]) for r in readers.read_markdown(spark, folder).collect()]
        assert sorted(r for r in got if r[0]) == want and [r for r in got if not r[0]] == [(None, "\n\n")]
        assert spark.read.text(folder, wholetext=True).count() == len(rows)
