"""Texts of briefings, prompts and steps, word by word."""

import hashlib
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerscope.functions import scores, text
from ledgerscope.operators import briefings, cost

AXIS = "array<struct<axis string, score int, confidence decimal(5,2)>>"
SCHEMA = f"""name string, generated_at timestamp, weights_version string, maturity string, summary string, total decimal(5,1), risk decimal(5,1), confidence decimal(5,3), axes {AXIS},
priority struct<bucket string, urgency double, capacity double, rationale string, next_step string>,
tco array<struct<scenario string, tokens long, api_usd double, gpu_usd double, savings_usd double, is_favorable boolean, assumptions array<string>>>, moat_plan string,
recommendations array<struct<technology string, axis string, priority string, complexity string, technical string, business string, next_action string, citations array<struct<title string, url string>>>>,
starters array<string>, inception string, caveats array<string>"""
AXES = [("proprietary_data", 40, Decimal("0.80")), ("workflow_depth", 70, Decimal("0.50")), ("stack_ownership", 20, Decimal("0.90")), ("distribution", 10, Decimal("0.20"))]
FULL = (
    "Acme", datetime(2026, 3, 4, 12), "0.1.0", "ai_native", "Resumo.", Decimal("44.5"), Decimal("55.5"), Decimal("0.625"), AXES, ("nutrir", 20.5, 0.455, "Porque sim.", "Ligar."),
    [("otimista", 2_500_000_000, 12345.5, 1000.0, 11345.5, True, ["x"]), ("conservador", 4_000_000, 20.0, 803.0, -783.0, False, ["a", "b"]), ("base", 50_000_000, 250.0, 803.0, -553.0, False, ["y"])],
    "Plano.", [("NIM", "stack_ownership", "alta", "media", "T.", "N.", "P.", [("Guia", "https://k/1"), (None, "https://k/2")])], ["Q1?", "Q2?"], None, ["c1", "c2"],
)
GOLDEN = """# Acme

> Briefing gerado em 04/03/2026 · pesos `0.1.0`
> · maturidade **ai_native**

## Resumo executivo

Resumo.

## Defensibility Radar

- **Score de defensibilidade:** 44/100
- **Risco de comoditização:** 56/100
- **Confiança global do diagnóstico:** 0.62

| Eixo | Peso | Score | Confiança | Leitura |
|---|---:|---:|---:|---|
| Domínio da stack | 25% | 20 | 0.90 | 20/100 |
| Dados proprietários | 30% | 40 | 0.80 | 40/100 |
| Profundidade de workflow | 25% | 70 | 0.50 | 70/100 |
| Distribuição | 20% | 10 | 0.20 | **evidência insuficiente** (não é nota baixa) |

## Prioridade

- **Bucket:** nutrir · **Urgência:** 20/100
- **Capacidade de agir:** 0.46
- Porque sim.
- **Próximo passo:** Ligar.

## Custo de inferência (TCO estimado)

| Cenário | Tokens/mês | Custo API | Stack NVIDIA | Economia | Migrar compensa? |
|---|---:|---:|---:|---:|---|
| conservador | 4M | US$ 20 | US$ 803 | US$ -783 | **não, neste volume** |
| base | 50M | US$ 250 | US$ 803 | US$ -553 | **não, neste volume** |
| otimista | 2500M | US$ 12,346 | US$ 1,000 | US$ 11,346 | sim |

**Estimativa a partir de sinais públicos, não medição.** Premissas:

- x

## Plano de fosso

Plano.

## Recomendações NVIDIA

### 1. NIM

- **Endereça o eixo:** Domínio da stack
- **Prioridade:** alta · **Complexidade:** media

**Técnico.** T.

**Negócio.** N.

**Próxima ação.** P.

- Fontes na base NVIDIA:
  - [Guia](https://k/1)
  - [KB NVIDIA](https://k/2)

## Perguntas para a primeira conversa

- Q1?
- Q2?

## Encaixe no Inception

_Sem encaixe evidente neste estágio._

## O que este diagnóstico não sabe

- c1
- c2
"""


def test_golden_briefing(spark):
    from ledgerscope import fixed_values as V

    scenarios = list(V.SCENARIOS)
    rename = dict(zip(("conservador", "base", "otimista"), scenarios, strict=True))
    costs = [(rename[c[0]], *c[1:]) for c in FULL[10]]
    rows = [(*FULL[:10], costs, *FULL[11:]), (*FULL[:10], [], FULL[11], [], None, "Cabe.", None)]
    whole, bare = (r[0] for r in spark.createDataFrame(rows, SCHEMA).select(briefings.markdown(F.col)).collect())
    golden = GOLDEN
    for old, new in rename.items():
        golden = golden.replace(f"| {old} |", f"| {new} |")
    assert whole == golden
    assert "_Não calculado: nenhum provedor" in bare and "_Nenhuma recomendação foi emitida" in bare and "\n- (nenhuma)\n" in bare and "Cabe." in bare


def test_gaps_in_evidence(spark):
    schema = f"notes array<string>, axes {AXIS}, tco array<string>, coverage double, attempts int"
    df = spark.createDataFrame([(["nota"], AXES, None, 0.555, 2), (None, AXES[:3], ["x"], 0.6, 1), (None, None, None, None, None)], schema)
    got = [r[0] for r in df.select(briefings.gaps_text(briefings.evidence_gaps(*map(F.col, df.columns)))).collect()]
    assert got[0].split("\n") == ["- nota", "- eixo 'Distribuição' com confiança 0.20: evidência insuficiente, não é nota baixa", "- TCO não calculado: nenhum provedor de API externa foi identificado publicamente, então não há custo atual com que comparar", "- cobertura de evidência do perfil em 56% — vários campos não puderam ser fundamentados em fonte pública", "- houve re-coleta: os sinais desta empresa não estavam na primeira leitura do site"]
    assert got[1:] == ["- nenhuma lacuna registrada"] * 2


def test_prompts_payloads_and_steps(spark):
    pages = [("u1", "blog", "Texto", "T", None), ("u2", "outro", " \n", None, None), ("u3", "", "x" * 9, "", datetime(2026, 1, 2))]
    df = spark.createDataFrame([(pages,), ([],), (pages[:1] * 14,)], "p array<struct<url string, kind string, text string, title string, published_at timestamp>>")
    state = F.transform("p", lambda p: briefings.page_state(p["url"], p["kind"], p["text"], p["title"], p["published_at"]))
    got = [r[0] for r in df.select(briefings.prompt_pages(state, chars=5)).collect()]
    assert got[0] == "[DOC 1] T · blog · u1\nTexto\n\n---\n\n[DOC 3] u3\nxxxxx" and got[1] == "(nenhum documento coletado)" and got[2].count("[DOC ") == 12
    chunk = spark.createDataFrame([("id", "t", "u", "Fonte", "nim", "Seção")], "chunk_id string, text string, source_url string, source_title string, technology string, section_title string")
    found = chunk.withColumn("p", briefings.payload(chunk.columns)).select("p", briefings.retrieved(F.col("p"), rrf_score=F.lit(0.5)).alias("r")).first()
    assert list(found["p"].asDict()) == list(briefings.PAYLOAD) and found["p"]["category"] is None
    assert found["r"].asDict() == {"text": "t", "source_url": "u", "source_title": "Seção", "technology": "nim", "dense_score": None, "bm25_score": None, "rrf_score": 0.5, "rerank_score": None}
    steps = [("collect", 3), ("collect", 0), ("validate", 0), ("rag", 2), ("score", 0), ("other", 1)]
    told = spark.createDataFrame(steps, "node string, n int").select(briefings.step_detail(F.col("node"), F.col("n"), F.lit(None), F.lit("m"), F.lit(Decimal("41.0")), F.lit("distribution"), F.col("n"), F.col("n")))
    assert [r[0] for r in told.collect()] == ["3 página(s) coletada(s)", None, "evidência suficiente", "2 trecho(s) da base NVIDIA", "score 41.0 · eixo mais fraco: distribution", None]


def test_rubric():
    got = briefings.rubric({"distribution": {"positive": ["a", "b"], "negative": ["c"]}}, "v1").split("\n")
    assert got == ["### distribution (peso 20%)", "- Sinais POSITIVOS (elevam o score):", "  - a", "  - b", "- Sinais NEGATIVOS (rebaixam o score):", "  - c", "", "Limiar de confiança acionável: 0.35 (abaixo disso o eixo é reportado como 'evidência insuficiente', nunca como nota baixa).", "Limiar de gap: score < 60.0 caracteriza gap.", "Versão dos pesos: v1"]


def test_fingerprints(spark):
    def expected(model, temperature, params, messages):
        said = f"{model}|{temperature:.4f}|" + "".join(f"{k}={v};" for k, v in sorted((params or {}).items())) + "".join(f"{r}\x00{c}\x01" for r, c in messages)
        return hashlib.sha256(said.encode()).hexdigest()

    calls = [("m", 0.2, {"top_p": "0.9", "max_tokens": "1024"}, [("system", "é"), ("human", "oi")]), ("m", 0.0, None, [("human", "oi")]), ("m", 0.0, {}, [("system", "oi")])]
    df = spark.createDataFrame(calls, "model string, t double, params map<string,string>, messages array<struct<role string, content string>>")
    assert [r[0] for r in df.select(text.fingerprint(*map(F.col, df.columns))).collect()] == [expected(*c) for c in calls]


def test_enforced_citations_and_literal_excerpts(spark):
    long = "Esta frase afirma muito e precisa de uma fonte real"
    df = lambda *rows: spark.createDataFrame(rows, "a string, n int")
    good = df((f"{long} [1]. Curta. # nada", 2), ("sem afirmacao", 0))
    assert good.select(text.enforced(F.col("a"), F.col("n"))).collect()[0][0].startswith("Esta")
    for row, message in (((f"{long} [3].", 2), "cites 3 of 2"), ((f"{long}.", 2), "1 claims without")):
        with pytest.raises(Exception, match=message):
            df(row).select(text.enforced(F.col("a"), F.col("n"))).collect()
    pair = lambda *rows: spark.createDataFrame(rows, "e string, s string").select(text.literal(F.col("e"), F.col("s")))
    assert [r[0] for r in pair(("Uma  frase\nliteral da fonte", "antes uma FRASE literal da fonte depois"), ("y" * 30, None)).collect()] == ["Uma frase literal da fonte", "y" * 30]
    for row, message in ((("curto", "curto"), "too short"), (("uma frase que ela nunca disse", "outra coisa"), "not in its source")):
        with pytest.raises(Exception, match=message):
            pair(row).collect()


def test_rationale_and_assumptions(spark):
    told = scores.capacity_told(F.lit(0.5), F.lit(1.0), F.lit(0.4), F.lit(0.7))
    got = spark.range(1).select(scores.capacity_rationale(F.lit(0.635), told, F.lit(55.5), F.lit(0.625))).first()[0]
    assert got == "Capacidade de agir 0.64 — capital recente 0.50 (peso 40%), founder técnico 1.00 (peso 25%), contratação de engenharia 0.40 (peso 20%), maturidade do estágio 0.70 (peso 15%). Urgência = risco 56 × capacidade 0.64 × confiança 0.62."
    company = spark.createDataFrame([("desconhecido", "openai_gpt_mini", 25)], "category string, provider string, headcount int")
    rows = cost.estimates(company).withColumn("a", cost.assumptions()).orderBy("tokens").collect()
    assert [len(r["a"]) for r in rows] == [9 if r["below_floor"] else 8 for r in rows]
    assert rows[0]["a"][1] == "Preço de API: US$ 0.45 por 1M tokens (openai_gpt_mini), mix aproximado de 3:1 entrada:saída." and rows[0]["a"][2] == "Stack NVIDIA: 1x L40S sob demanda a US$ 1.10/hora, 730h/mês." and "2,800 tokens/s" in rows[0]["a"][4]
