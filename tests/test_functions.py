"""Golden cases of the column functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerscope.functions import scores as S
from ledgerscope.functions import text as T
from ledgerscope.functions import urls as U
from ledgerscope.operators import cost, history


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("url", "kind"),
    [
        ("https://e.com.br/carreiras", "pagina_carreiras"),
        ("https://e.com.br/vagas/ml-engineer", "pagina_carreiras"),
        ("https://e.com.br/jobs", "pagina_carreiras"),
        ("https://empresa.gupy.io/", "pagina_carreiras"),
        ("https://e.com.br/blog/inferencia", "blog_tecnico"),
        ("https://blog.empresa.com.br/", "blog_tecnico"),
        ("https://docs.empresa.com.br/api", "documentacao"),
        ("https://e.com.br/", "site_oficial"),
        ("https://e.com.br/produto", "site_oficial"),
        ("https://x.com.br/produto", "site_oficial"),
        ("https://braziljournal.com/a", "noticia"),
        ("https://g1.globo.com/a", "noticia"),
        ("https://www.crunchbase.com/a", "diretorio_startup"),
        ("https://br.linkedin.com/in/a", "perfil_publico"),
    ],
)
def test_source_kind(spark, url, kind):
    assert one(spark, U.source_kind(F.col("u")), u=url) == kind


def test_source_kind_of_a_foreign_host(spark):
    assert one(spark, U.source_kind(F.col("u"), F.lit("acme.com.br")), u="https://outra.com.br/") == "outro"
    assert one(spark, U.source_kind(F.col("u"), F.lit("acme.com.br")), u="https://app.acme.com.br/") == "site_oficial"


@pytest.mark.parametrize(
    ("url", "title", "reason"),
    [
        ("https://www.linkedin.com/jobs/1", "Vaga", "agregador"),
        ("https://agenciasebrae.com.br/x", "X", "agregador"),
        ("https://p.com.br/2026/09/a", "A", "caminho_de_conteudo"),
        ("https://p.com.br/blog/a", "A", "caminho_de_conteudo"),
        ("https://p.com.br/a/b/c/d/e", "A", "caminho_de_conteudo"),
        ("https://p.com.br/bb-adota-ia-generativa-para-gestao", "A", "caminho_de_conteudo"),
        ("https://p.com.br/", "Banco usa Inteligência artificial", "titulo_de_manchete"),
        ("https://p.com.br/", "Acme capta R$ 10 milhões", "titulo_de_manchete"),
        ("https://p.com.br/", "8 Startups de IA", "titulo_de_manchete"),
        ("https://p.com.br/", "Inteligência artificial na saúde", "titulo_de_assunto"),
        ("https://sofya.ai/", "Sofya | IA na saúde", None),
        ("https://empresa.com.br/produto", "Vailu", None),
    ],
)
def test_discovery_gate(spark, url, title, reason):
    assert one(spark, U.rejection(F.col("u"), F.col("t")), u=url, t=title) == reason


@pytest.mark.parametrize("name", ["Acme Saúde Ltda", "ACME  SAUDE", "Acme Saúde S.A."])
def test_names_meet(spark, name):
    assert one(spark, T.normal_name(F.col("n")), n=name) == "acme saude"


@pytest.mark.parametrize("site", ["https://acme.com.br", "http://www.acme.com.br/", "https://ACME.com.br"])
def test_sites_meet(spark, site):
    assert one(spark, T.normal_site(F.col("s")), s=site) == "acme.com.br"


@pytest.mark.parametrize(("text", "kind"), [("transcricao de chamadas", "voz_transcricao"), ("chatbot no whatsapp", "atendimento_cliente"), ("contratos juridicos", "analise_documentos"), ("copiloto", "copiloto_vertical"), ("consultoria empresarial", "desconhecido")])
def test_category(spark, text, kind):
    assert one(spark, T.category(F.col("t")), t=text) == kind


def test_tokens_keep_compounds_and_parts(spark):
    found = one(spark, T.tokens(F.col("t")), t="Inferência com TensorRT-LLM")
    assert {"inferencia", "tensorrt-llm", "tensorrt", "llm"} <= set(found) and "com" not in found


def test_whole_words_only(spark):
    assert one(spark, T.tech_mentions(F.col("t")), t="um fragmento de texto") == []
    assert one(spark, T.tech_mentions(F.col("t")), t="usamos RAG e Triton.") == ["rag", "triton"]


def test_citations(spark):
    assert one(spark, T.citations(F.col("t")), t="a [2] b [1] c [2][12]") == [2, 1, 12]
    long = "Esta frase afirma alguma coisa bastante longa sem fonte."
    assert one(spark, T.unsupported_sentences(F.col("t")), t=f"{long} Curta. Outra frase que afirma muito, mas com a sua fonte [1].") == [long]


def test_token_estimate(spark):
    assert one(spark, T.token_estimate(F.col("t")), t="um dois tres quatro cinco seis sete oito nove dez") == 13
    assert one(spark, T.token_estimate(F.col("t")), t="   ") == 0


def test_uuid5(spark):
    import uuid

    assert one(spark, T.uuid5(uuid.NAMESPACE_URL.hex, F.col("t")), t="chunk") == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunk"))


@pytest.mark.parametrize(
    ("new", "score", "confidence", "kind"),
    [(0, 0, -40, "confianca_caiu"), (0, -15, -45, "confianca_caiu"), (1, 0, 0, "nova_evidencia"), (0, 20, 5, "melhorou"), (0, -25, 0, "piorou"), (0, 2, 1, "estavel"), (0, 10, -6, "estavel"), (2, -30, 0, "nova_evidencia")],
)
def test_change_kinds(spark, new, score, confidence, kind):
    assert one(spark, S.change_kind(F.col("n"), F.col("s"), F.col("c")), n=new, s=score, c=confidence) == kind


def test_worked_score(spark):
    axes = [("proprietary_data", 82, 80), ("workflow_depth", 75, 70), ("stack_ownership", 25, 80), ("distribution", 60, 20)]
    struct = F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(s).alias("score"), (F.lit(c) / 100).cast("decimal(5,2)").alias("confidence")) for a, s, c in axes))
    run = spark.range(1).select(F.lit(1).alias("company_id"), F.lit(1).alias("run_id"), F.lit(1).alias("created_at"), struct.alias("axes"))
    whole = history.totals(run).first()
    assert (float(whole["total"]), float(whole["risk"]), float(whole["confidence"])) == (61.6, 38.4, 0.655)
    rows = history.axis_rows(run)
    assert [float(r["gap_severity"]) for r in rows.orderBy("position").collect()] == [4.32, 4.38, 15.0, 1.6]
    gap = history.gaps(rows).withColumn("t", history.technologies(F.col("gaps"))).first()
    assert gap["weakest_axis"] == "stack_ownership" and gap["gaps"] == ["stack_ownership"]
    assert gap["t"] == ["NIM", "TensorRT-LLM", "Triton Inference Server", "NVIDIA AI Enterprise"]


def test_trust_and_noisy_or(spark):
    assert one(spark, S.source_trust(F.lit("blog_tecnico"), F.lit(400))) == 95 * 65
    assert one(spark, S.noisy_or(F.array(*map(F.lit, (0.5, 0.5, 0.5))))) == 0.875
    assert one(spark, S.noisy_or(F.array().cast("array<double>"))) == 0.0


def test_capacity_and_buckets(spark):
    day = lambda y, m, d: F.lit(datetime.date(y, m, d))
    assert one(spark, F.round(S.funding_signal(day(2026, 3, 1), day(2026, 8, 14)), 3)) == 0.697
    assert one(spark, S.capacity(F.lit(0.697), F.lit(1.0), F.lit(0.0), F.lit(1.0))) == 0.679
    assert one(spark, S.founder_signal(F.array(F.lit(False), F.lit(None).cast("boolean")))) == 0.0
    assert one(spark, S.founder_signal(F.array(F.lit(None).cast("boolean")))) == 0.3
    assert one(spark, S.urgency(F.lit(80.0), F.lit(0.679), F.lit(0.8))) == 43.5
    for total, confidence, expected in ((20.0, 0.8, "abordar_agora"), (20.0, 0.2, "monitorar"), (80.0, 0.8, "case_potencial")):
        assert one(spark, S.bucket(F.lit(total), F.lit(confidence), F.lit(0.679), F.lit(None).cast("string"))) == expected
    assert one(spark, S.bucket(F.lit(20.0), F.lit(0.8), F.lit(0.06), F.lit(None).cast("string"))) == "nutrir"


@pytest.mark.parametrize(
    ("category", "provider", "headcount", "scenario", "tokens", "gpu", "usd", "saved"),
    [
        ("voz_transcricao", "openai_gpt_frontier", None, "agressivo", 750_000_000, "1x L40S", 803.0, 3697.0),
        ("busca_interna", "openai_gpt_mini", None, "conservador", 20_000_000, "1x L40S", 803.0, -794.0),
        ("copiloto_vertical", "desconhecido", 40, "medio", 101_192_885, "1x L40S", 803.0, -297.04),
        ("voz_transcricao", "anthropic_claude_frontier", 400, "agressivo", 3_000_000_000, "2x L40S", 1606.0, 25394.0),
    ],
)
def test_costs(spark, category, provider, headcount, scenario, tokens, gpu, usd, saved):
    company = spark.createDataFrame([(category, provider, headcount)], "category string, provider string, headcount int")
    row = cost.estimates(company).where(F.col("scenario") == scenario).withColumn("a", cost.assumptions()).first()
    assert (row["tokens"], row["gpu"], row["gpu_usd"], row["savings_usd"]) == (tokens, gpu, usd, saved)
    assert len(row["a"]) == (9 if tokens < 30_000_000 else 8)


def test_letters_in_their_plain_form(spark):
    import sys
    import unicodedata

    plain = lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x))
    points = [p for p in range(1, sys.maxunicode + 1) if not 0xD800 <= p < 0xE000 and unicodedata.category(chr(p)) not in ("Cn", "Co")]
    texts = ["|".join(map(chr, points[i : i + 400])) for i in range(0, len(points), 400)] + ["ﬁm ação", "", "１２ａ ㎏ ½ 한글 각"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.fold(F.col("t")).alias("f")).collect()
    assert [r["i"] for r in got if r["f"] != plain(texts[r["i"]])] == []
    assert spark.createDataFrame([(None,)], "t string").select(T.fold(F.col("t"))).first()[0] is None


def test_a_text_is_folded_once(spark):
    df = spark.createDataFrame([(1, "Ação da Anthropic", "api_externa")], "i int, t string, p string")
    folded = T.fold(F.lower("t"))
    for column in (T.provider_key(folded, F.col("p")), T.category(folded), T.tokens(F.col("t")), T.normal_name(F.col("t"))):
        plan = df.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("translate(") == 1


def test_folding_takes_time_by_length(spark):
    import time

    df = spark.createDataFrame([("é" + "palavras com acentuação e várias letras " * 50_000,)], "t string").select(F.length(T.fold(F.col("t"))))
    df.collect()
    began = time.time()
    df.collect()
    assert time.time() - began < 2  # two million letters


def test_urgency_at_a_tie_that_doubles_miss(spark):
    assert one(spark, S.urgency(F.lit(0.6), F.lit(0.75), F.lit(1.0))) == 0.5


def test_estimates_are_made_once(spark):
    from ledgerscope.operators import chunking

    df = spark.createDataFrame([("  um dois　tres \x85",)], "t string")
    assert df.select(T.stripped(F.col("t"))).first()[0] == "um dois　tres" and df.select(T.token_estimate(F.col("t"))).first()[0] == 4
    estimate = df.select(T.token_estimate(F.col("t")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert estimate.count("trim(") == 1
    costs = F.transform(F.split("t", " "), T.token_estimate)
    assert df.select(chunking.spans(costs, 9, 2).alias("s"))._jdf.queryExecution().optimizedPlan().toString().count("trim(") == 1
