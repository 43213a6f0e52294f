"""Texts of a company's briefing and of the steps that lead to it, as columns.

A briefing is an array of sections joined by blank lines; every section is a
template over nested columns (axes, costs, recommendations), so a row becomes
its Markdown without a group or a join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerscope import fixed_values as V
from ledgerscope.functions import scores as S


def _whole(number: Column) -> Column:
    """A number without places, ties to even."""
    return F.bround(number.cast("decimal(20,4)"), 0).cast("long")


def _two(number: Column) -> Column:
    return F.format_string("%.2f", F.bround(number.cast("decimal(20,6)"), 2).cast("double"))


def _dollars(number: Column) -> Column:
    return F.concat(F.lit("US$ "), F.format_number(_whole(number), 0))


def _label(axis: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in V.AXIS_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(names, axis), axis)


def _lines(rows: Column, line, between: str = "\n") -> Column:
    return F.array_join(F.transform(rows, line), between)


def _none(rows: Column) -> Column:
    return F.coalesce(F.size(rows), F.lit(0)) < 1


def axes_table(axes: Column) -> Column:
    """Axes (axis, score, confidence), the severest gap first; ties keep their order."""
    placed = F.transform(axes, lambda a, i: F.struct((-S.gap_severity(a["axis"], a["score"], a["confidence"])).alias("s"), i.alias("i"), a.alias("a")))
    weights = F.create_map(*(F.lit(x) for pair in V.AXIS_WEIGHTS.items() for x in pair))

    def line(p: Column) -> Column:
        a = p["a"]
        score = _whole(a["score"]).cast("string")
        told = F.when(S.is_actionable(a["confidence"]), F.concat(score, F.lit("/100"))).otherwise(V.BRIEFING_TEXTS["weak"])
        return F.concat(F.lit("| "), F.array_join(F.array(_label(a["axis"]), F.concat(weights[a["axis"]].cast("string"), F.lit("%")), score, _two(a["confidence"]), told), " | "), F.lit(" |"))

    return F.concat(F.lit(V.BRIEFING_TEXTS["axes"] + "\n"), _lines(F.array_sort(placed), line))


def costs_table(tco: Column) -> Column:
    """Costs (scenario, tokens, api_usd, gpu_usd, savings_usd, is_favorable, assumptions) in the order of the scenarios, and what the first assumes."""
    say = V.BRIEFING_TEXTS
    order = F.array(*map(F.lit, V.SCENARIOS))
    placed = F.transform(tco, lambda t: F.struct(F.array_position(order, t["scenario"]).alias("i"), t.alias("t")))

    def line(p: Column) -> Column:
        t = p["t"]
        cells = (t["scenario"], F.concat(_whole(t["tokens"] / 1_000_000).cast("string"), F.lit("M")), _dollars(t["api_usd"]), _dollars(t["gpu_usd"]), _dollars(t["savings_usd"]), F.when(t["is_favorable"], say["favorable"]).otherwise(say["unfavorable"]))
        return F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))

    rows = _lines(F.array_sort(placed, lambda a, b: (a["i"] - b["i"]).cast("int")), line)
    assumed = _lines(F.get(tco, F.lit(0))["assumptions"], lambda a: F.concat(F.lit("- "), a))
    return F.when(_none(tco), F.lit(say["no_costs"])).otherwise(F.concat(F.lit(say["costs"] + "\n"), rows, F.lit("\n\n" + say["estimate"] + "\n\n"), assumed))


def recommendations_list(recommendations: Column) -> Column:
    """Recommendations (technology, axis, priority, complexity, technical, business, next_action, citations of title and url) in their order."""

    def block(r: Column, i: Column) -> Column:
        cited = _lines(r["citations"], lambda c: F.format_string("  - [%s](%s)", F.coalesce(F.nullif(c["title"], F.lit("")), F.lit(V.BRIEFING_TEXTS["source"])), c["url"]))
        return F.concat_ws(
            "\n\n",
            F.format_string("### %d. %s", i + 1, r["technology"]),
            F.format_string("- **Endereça o eixo:** %s\n- **Prioridade:** %s · **Complexidade:** %s", _label(r["axis"]), r["priority"], r["complexity"]),
            F.concat(F.lit("**Técnico.** "), r["technical"]),
            F.concat(F.lit("**Negócio.** "), r["business"]),
            F.concat(F.lit("**Próxima ação.** "), r["next_action"]),
            F.concat(F.lit("- Fontes na base NVIDIA:\n"), cited),
        )

    return F.when(_none(recommendations), F.lit(V.BRIEFING_TEXTS["no_recommendations"])).otherwise(F.array_join(F.transform(recommendations, block), "\n\n"))


def evidence_gaps(notes: Column, axes: Column, tco: Column, coverage: Column, attempts: Column) -> Column:
    """What isn't known of a company: notes, axes without evidence, missing costs, thin coverage, a second collection."""
    say = V.GAP_TEXTS
    weak = F.transform(F.filter(axes, lambda a: ~S.is_actionable(a["confidence"])), lambda a: F.format_string(say["axis"], _label(a["axis"]), F.bround(a["confidence"].cast("decimal(20,6)"), 2).cast("double")))
    more = F.array_compact(F.array(F.when(axes.isNotNull() & _none(tco), say["costs"]), F.when(coverage < V.COVERAGE_FLOOR, F.format_string(say["coverage"], _whole(coverage * 100))), F.when(attempts > 1, say["again"])))
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(notes, none), F.coalesce(weak, none), more)


def gaps_text(gaps: Column) -> Column:
    return F.when(_none(gaps), F.lit(V.GAP_TEXTS["none"])).otherwise(_lines(gaps, lambda g: F.concat(F.lit("- "), g)))


def markdown(c) -> Column:
    """The whole briefing of a row whose columns ``c`` looks up by name."""
    priority = c("priority")
    bullets = lambda rows: _lines(F.coalesce(rows, F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x))
    sections = {
        "Resumo executivo": c("summary"),
        "Defensibility Radar": F.concat(
            F.format_string("- **Score de defensibilidade:** %d/100\n- **Risco de comoditização:** %d/100\n- **Confiança global do diagnóstico:** %s\n\n", _whole(c("total")), _whole(c("risk")), _two(c("confidence"))), axes_table(c("axes"))
        ),
        "Prioridade": F.format_string("- **Bucket:** %s · **Urgência:** %d/100\n- **Capacidade de agir:** %s\n- %s\n- **Próximo passo:** %s", priority["bucket"], _whole(priority["urgency"]), _two(priority["capacity"]), priority["rationale"], priority["next_step"]),
        "Custo de inferência (TCO estimado)": costs_table(c("tco")),
        "Plano de fosso": c("moat_plan"),
        "Recomendações NVIDIA": recommendations_list(c("recommendations")),
        "Perguntas para a primeira conversa": F.when(_none(c("starters")), F.lit(V.BRIEFING_TEXTS["no_starters"])).otherwise(bullets(c("starters"))),
        "Encaixe no Inception": F.coalesce(F.nullif(c("inception"), F.lit("")), F.lit(V.BRIEFING_TEXTS["no_inception"])),
        "O que este diagnóstico não sabe": bullets(c("caveats")),
    }
    head = F.format_string("# %s\n\n> Briefing gerado em %s · pesos `%s`\n> · maturidade **%s**", c("name"), F.date_format(c("generated_at"), "dd/MM/yyyy"), c("weights_version"), c("maturity"))
    body = (F.concat(F.lit(f"## {title}\n\n"), F.coalesce(text, F.lit(""))) for title, text in sections.items())
    return F.concat(F.array_join(F.array(head, *body), "\n\n"), F.lit("\n"))


def rubric(signals: dict[str, dict[str, list[str]]], version: str) -> str:
    """The signals of each axis as Markdown, with the thresholds that readers of a score need."""
    block = lambda axis, groups: "\n".join([f"### {axis} (peso {V.AXIS_WEIGHTS[axis]}%)" if V.AXIS_WEIGHTS.get(axis) else f"### {axis}", *(line for head, name in (("- Sinais POSITIVOS (elevam o score):", "positive"), ("- Sinais NEGATIVOS (rebaixam o score):", "negative")) for line in (head, "\n".join(f"  - {s}" for s in groups.get(name, []))))])
    foot = [
        f"Limiar de confiança acionável: {V.ACTIONABLE_CONFIDENCE / 100} (abaixo disso o eixo é reportado como 'evidência insuficiente', nunca como nota baixa).",
        f"Limiar de gap: score < {float(V.GAP_SCORE)} caracteriza gap.",
        f"Versão dos pesos: {version}",
    ]
    return "\n\n".join(block(axis, groups) for axis, groups in signals.items()) + "\n\n" + "\n".join(foot)


def step_detail(node: Column, pages: Column, again: Column, maturity: Column, total: Column, weakest: Column, chunks: Column, recommendations: Column) -> Column:
    """A short fact on what a step has made; null where there is none."""
    say = V.STEP_TEXTS
    return (
        F.when((node == "collect") & (pages > 0), F.format_string(say["pages"], pages))
        .when(node == "validate", F.when(F.coalesce(again, F.lit(False)), say["again"]).otherwise(say["enough"]))
        .when(node == "classify", maturity)
        .when((node == "score") & total.isNotNull(), F.format_string(say["score"], total.cast("string"), weakest))
        .when(node == "rag", F.format_string(say["chunks"], F.coalesce(chunks, F.lit(0))))
        .when(node == "recommend", F.format_string(say["recommendations"], F.coalesce(recommendations, F.lit(0))))
    )


PAYLOAD = ("chunk_id", "text", "source_url", "source_title", "technology", "category", "doc_type", "section_title", "heading_path", "position", "token_estimate")
SCORES = ("dense_score", "bm25_score", "rrf_score", "rerank_score")


def payload(columns: list[str]) -> Column:
    """What a vector store keeps of a chunk: flat, and every field, null where the chunk has none."""
    return F.struct(*((F.col(name) if name in columns else F.lit(None).cast("string")).alias(name) for name in PAYLOAD))


def retrieved(p: Column, **scores: Column) -> Column:
    """A found chunk as its readers see it: its section's title before its source's, and the scores that found it."""
    told = (scores.get(name, F.lit(None)).cast("double").alias(name) for name in SCORES)
    return F.struct(p["text"].alias("text"), p["source_url"].alias("source_url"), F.coalesce(F.nullif(p["section_title"], F.lit("")), p["source_title"]).alias("source_title"), p["technology"].alias("technology"), *told)


def page_state(url: Column, kind: Column, text: Column, title: Column, published_at: Column) -> Column:
    """What later steps keep of a page: no markup, and its time as text."""
    return F.struct(url.alias("url"), kind.alias("kind"), text.alias("text"), title.alias("title"), F.date_format(published_at, "yyyy-MM-dd'T'HH:mm:ssxxx").alias("published_at"))


def prompt_pages(pages: Column, most: int = V.PROMPT_DOCS, chars: int = V.PROMPT_CHARS) -> Column:
    """Page states as one numbered text; blank ones are left out and keep their number."""

    def one(p: Column, i: Column) -> Column:
        text = F.substring(F.coalesce(p["text"], F.lit("")), 1, chars)
        head = F.array_join(F.filter(F.array(p["title"], p["kind"], p["url"]), lambda x: F.coalesce(x != "", F.lit(False))), " · ")
        return F.when(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) != "", F.format_string("[DOC %d] %s\n%s", i + 1, head, text))

    told = F.array_compact(F.transform(F.slice(pages, 1, most), one))
    return F.when(_none(told), F.lit(V.NO_DOCUMENTS)).otherwise(F.array_join(told, "\n\n---\n\n"))
