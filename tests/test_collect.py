"""Two waves of pages: seeds, then the links that tell."""

from ledgerscope.operators import collect

LONG = "<p>" + "palavras de um texto com alguma substancia " * 5 + "</p>"
SITES = {
    "https://a.com/": f'<title>A</title>{LONG}<a href="/blog/1">b</a><a href="/vagas">Vagas</a><a href="/">home</a><a href="https://fora.com/pricing">x</a>' + "".join(f'<a href="/cases/{i}">c</a>' for i in range(9)),
    "https://a.com/vagas": "<h1>Vagas</h1><li>Engenheiro de Software</li><li>Vendas</li>",
    "https://a.com/blog/1": f'{LONG}<a href="/vagas/mais">mais</a>',
    "https://m.com/": "".join(f'<a href="/noticia/{i}">n</a>' for i in range(20)) + '<a href="/vagas">v</a>',
    "https://m.com/vagas": "<li>Engenheiro</li>",
    "https://e.com/": "",
}


def test_two_waves(spark):
    asked = []

    def fetch(urls):
        there = spark.createDataFrame(list(SITES.items()), "url string, html string")
        found = urls.join(there, "url")
        asked.append(sorted(r["url"] for r in urls.collect()))
        return found

    rows = [("a", "a.com", "https://a.com/", 0), ("a", "a.com", "https://a.com/", 1), ("m", "m.com", "https://m.com/", 0), ("e", "e.com", "https://e.com/", 0), ("g", "g.com", "https://g.com/", 0)]
    got = collect.collect(spark.createDataFrame(rows, "company_id string, domain string, url string, place int"), fetch)
    pages = {(r["company_id"], r["wave"], r["url"]): r for r in got.pages.collect()}
    assert set(pages) == {("a", 1, "https://a.com/"), ("a", 2, "https://a.com/vagas"), ("a", 2, "https://a.com/blog/1")}
    assert pages["a", 1, "https://a.com/"]["title"] == "A" and pages["a", 2, "https://a.com/vagas"]["kind"] == "pagina_carreiras"
    assert [tuple(r) for r in got.titles.collect()] == [("a", ["Engenheiro de Software"])]
    assert {tuple(r) for r in got.failures.collect()} == {("m", collect.MEDIA), ("e", collect.NOTHING), ("g", collect.NOTHING)}
    assert asked[1] == ["https://a.com/blog/1", "https://a.com/cases/0", "https://a.com/cases/1", "https://a.com/cases/2", "https://a.com/vagas"] and len(asked) == 2


def test_titles_of_followed_pages(spark, tmp_path):
    """A role's letters in a heading of the first page are a title of that page, not of the vacancy."""
    from ledgerscope.plans.catalogue import QUERIES

    pages = [(n, f"https://{d}.example.com/{n}", f"<title>t</title><h2>Hast asrewhesed thed</h2>{LONG}") for n, d in ((2, "a"), (3, "b"))]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["domain"]: (r["n_pages"], r["n_followed"], r["titles"]) for r in QUERIES["collected_sites"](spark, str(tmp_path)).collect()}
    assert got == {"a.example.com": (2, 1, "Engenheiro de Dados 2"), "b.example.com": (1, 0, "")}
