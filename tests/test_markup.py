"""One pass over a page: golden pages, elements in elements, time in proportion to length; main text and dates."""

import time

import pytest
from pyspark.sql import functions as F

from ledgerscope.functions import markup
from ledgerscope.operators import web

CAREERS = """<html><body><h1>Trabalhe conosco</h1><ul class="vagas">
  <li><a href="/vagas/machine-learning-engineer">Machine Learning Engineer (Senior)</a></li>
  <li><a href="https://empresa.gupy.io/jobs/123">Engenheiro de Dados Pleno</a></li>
  <li><a href="/vagas/executivo-de-contas">Executivo de Contas</a></li>
  <li><a href="/sobre">Sobre nos</a></li></ul></body></html>"""
CLIENTS = """<section><h2>Nossos clientes</h2><img src="/1.svg" alt="Banco Neon"><img src="/2.svg" alt="Logo Magazine Luiza"><figcaption>Grupo Fleury</figcaption></section>
<section class="parceiros-logos"><img src="/3.svg" alt="NVIDIA Inception"></section>"""


def of(html, url="https://empresa.com.br/", **options):
    return dict(zip(web.LINKS, markup.extracted(html, url, **options), strict=True))


def test_careers_page():
    got = of(CAREERS)
    assert got["career_links"] == ["https://empresa.com.br/vagas/machine-learning-engineer", "https://empresa.gupy.io/jobs/123", "https://empresa.com.br/vagas/executivo-de-contas"]
    assert got["job_titles"] == ["Machine Learning Engineer (Senior)", "Engenheiro de Dados Pleno"]


def test_clients_page():
    assert of(CLIENTS)["client_names"] == ["Banco Neon", "Magazine Luiza", "Grupo Fleury", "NVIDIA Inception"]


@pytest.mark.parametrize(
    "html,names",
    [
        ('<div><h2>Clientes</h2><h3>Bancos</h3><img alt="A1"><h3>Varejo</h3><div><img alt="B2"></div></div><img alt="fora">', ["A1", "B2"]),  # logos under sub-headings
        ('<section><p><h2>Quem usa</h2></p><img alt="A1"></section><section><img alt="B2"></section>', ["A1"]),  # the nearest container, not the parent
        ('<main><h2>Trusted by</h2><img alt="A1"></main>', ["A1"]),  # no container: the parent
        ('<h2>Partners</h2><img alt="A1">', ["A1"]),  # no parent: the page
        ('<div class="x" id="logos"><img alt="A1"></div><div id="logos"><img alt="B2"></div>', ["A1"]),  # an id counts beside a class
        ('<div class="logo-wall"><ul class="clientes"><li>Um</li><li>Dois <b>Tres</b></li></ul><p>mais de cinco palavras sao texto corrido</p></div>', ["Um", "Dois Tres"]),
        ('<div class="clientes"><li>Um<li>Dois</div><p>Fora</p>', ["Um Dois", "Dois"]),  # items without end tags stand in each other
        ('<div class="clientes"><script>var x = "<img alt=no>"</script><template><p>nada</p></template><img title="logo: C3"><img alt="clientes"></div>', ["C3"]),
        ('<div class="clientes"><img alt="IMAGEM"><img alt=""><img><span> - Zê | </span></div>', ["Zê"]),
    ],
)
def test_names_in_containers(html, names):
    assert of(html)["client_names"] == names


def test_links_by_path_host_and_label():
    html = '<a href=" /blog/x ">1</a><a href="https://blog.outra.com/">2</a><a href="https://medium.com/@blog">3</a><a href="//empresa.com.br/pricing?a=1&amp;b=2">4</a><a>5</a><a href="#vagas">6</a><a href="x"><i>Nossas</i> <b>VAGAS</b></a><a href="ftp://a/pricing">7</a><a href="http://[bad/pricing">8</a>'
    got = of(html, "https://www.empresa.com.br/a/b")
    assert got["signal_links"] == ["https://www.empresa.com.br/blog/x", "https://blog.outra.com/", "https://empresa.com.br/pricing?a=1&b=2"]
    assert got["career_links"] == ["https://www.empresa.com.br/a/x"]
    assert of(html, "https://www.empresa.com.br/a/b", same_host=True)["signal_links"] == ["https://www.empresa.com.br/blog/x", "https://empresa.com.br/pricing?a=1&b=2"]


@pytest.mark.parametrize("unit", ['<a href="/vagas/{}">v</a>', '<a href="/vagas/{}">v', '<div class="clientes"><h2>Clientes</h2><li>Nome', "<h2>empresas que ", "<div>", "</div>", '<div class="logo"><img alt="L{}">', "<"])
def test_time_grows_with_length(unit):
    page = "".join(unit.format(i) for i in range(100_000 // len(unit)))
    took = []
    for _ in range(3):
        began = time.process_time()
        markup.extracted(page, "https://a.com/")
        took.append(time.process_time() - began)
    assert min(took) < 0.5


def test_pages_as_rows(spark):
    rows = [(1, "https://empresa.com.br/", CAREERS), (2, None, None), (3, "", ""), (4, None, CLIENTS)]
    got = {r["page_id"]: r for r in web.page_links(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got[1]["career_links"]) == 3 and got[2]["client_names"] == got[3]["job_titles"] == [] and got[4]["client_names"][0] == "Banco Neon"


ARTICLE = "<head><title>T</title>{}</head><nav><p>Menu de muitas palavras que nao sao texto do artigo nem de longe</p></nav><div><a href=x>um dois tres quatro cinco</a></div><p>Primeiro paragrafo com palavras bastantes para contar &amp; mais, e tantas outras palavras e tantas outras palavras e tantas outras palavras e tantas outras palavras e tantas outras palavras.</p><ul><li><a href=y>uma ligacao com muitas palavras no meio</a></li></ul><p>Segundo paragrafo, com <b>palavras</b> <a href=z>bastantes</a> para contar tambem, e tantas outras palavras e tantas outras palavras e tantas outras palavras e tantas outras palavras e tantas outras palavras.</p><div>fim</div><footer>Todos os direitos reservados a quem os tem, como sempre foi</footer>"


def test_main_text_is_the_densest_stretch(spark):
    pages = [(1, "u", ARTICLE.format("")), (2, "u", "<p>curto</p>"), (3, None, None), (4, "u", "<div><a href=x>so ligacoes aqui</a></div>" * 5)]
    got = {r["page_id"]: r for r in web.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    lines = got[1]["text"].split("\n")
    assert lines == ["Primeiro paragrafo com palavras bastantes para contar & mais, e tantas outras palavras e tantas outras palavras e tantas outras palavras e tantas outras palavras e tantas outras palavras.", "Segundo paragrafo, com palavras bastantes para contar tambem, e tantas outras palavras e tantas outras palavras e tantas outras palavras e tantas outras palavras e tantas outras palavras."] and not got[1]["fallback"] and got[1]["title"] == "T"
    assert (got[2]["text"], got[2]["fallback"], got[3]["text"], got[3]["title"]) == ("curto", True, "", None)
    assert got[4]["fallback"] and got[4]["text"].startswith("so ligacoes aqui so")


@pytest.mark.parametrize(
    "head,url,day",
    [
        ('<meta property="article:published_time" content="2024-03-05T10:20:30Z">', "https://a.org/2020/01/02/x", "2024-03-05 10:20:30"),
        ("<meta content='2024-03-05T10:20:30-03:00' name='date'>", "u", "2024-03-05 13:20:30"),
        ('<meta name="other" content="2023-01-01"><script type="application/ld+json">{"datePublished": "2024-03-05"}</script>', "u", "2024-03-05 00:00:00"),
        ('<time datetime="2024-02-30">?</time>', "https://a.org/2020/01/02/", "2020-01-02 00:00:00"),
        ('<time class=x datetime="2024-02-03 04:05">?</time>', "u", "2024-02-03 04:05:00"),
        ("", "https://a.org/2020/13/02/", None),
        ("", None, None),
    ],
)
def test_days_of_publication(spark, head, url, day):
    df = spark.createDataFrame([(1, url, ARTICLE.format(head))], "page_id long, url string, html string")
    assert df.select(F.date_format(web.published_at(F.col("html"), F.col("url")), "yyyy-MM-dd HH:mm:ss")).first()[0] == day
