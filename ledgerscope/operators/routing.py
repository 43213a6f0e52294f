"""The batch as stages over companies: routes, early exits, failures as rows, rendering."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import fixed_values as V
from ledgerscope.functions.urls import netloc

PROGRAM_ERRORS = ("TypeError", "KeyError", "AttributeError", "NameError", "ImportError", "IndexError", "UnboundLocalError", "NotImplementedError")


def next_stage(pages: Column, profile: Column, recollect: Column, maturity: Column, scored: Column) -> Column:
    """Where a company goes next: no pages or profile ends it, so does ``non_ai``; ``indeterminado`` goes on."""
    return (
        F.when(F.coalesce(pages, F.lit(0)) == 0, "fim_sem_paginas")
        .when(~F.coalesce(profile, F.lit(False)), "fim_sem_perfil")
        .when(F.coalesce(recollect, F.lit(False)), "collect")
        .when(maturity.isNull(), "fim_sem_classificacao")
        .when(maturity == "non_ai", "fim_non_ai")
        .when(~F.coalesce(scored, F.lit(False)), "score")
        .otherwise("compare")
    )


def triage(error: Column) -> Column:
    """Errors of the program against those of the world."""
    return F.when(error.isin(*PROGRAM_ERRORS), "bug").otherwise("mundo")


def is_rate_limit(status: Column, message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return (F.coalesce(status, F.lit(0)) == 429) | low.contains("rate limit") | low.contains("too many requests") | low.contains("quota")


def run_stage(companies: DataFrame, node: str, key: str, work: Callable[[dict], dict], result: str) -> tuple[DataFrame, DataFrame]:
    """Apply a provider to each company; a company that fails becomes a row of failures and stops nothing else."""
    columns = companies.columns

    def mapper(frames):
        for frame in frames:
            out, error = [], []
            for row in frame.to_dict("records"):
                try:
                    out.append(str(work(row)))
                    error.append(None)
                except Exception as failed:  # the failure is the row's result
                    out.append(None)
                    error.append(f"{type(failed).__name__}: {failed}")
            yield frame.assign(**{result: out, "__error": error})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in companies.schema)
    done = companies.mapInPandas(mapper, f"{schema}, `{result}` string, __error string")
    failures = done.where(F.col("__error").isNotNull()).select(F.lit(node).alias("node"), key, F.col("__error").alias("error"), triage(F.substring_index("__error", ":", 1)).alias("kind"))
    return done.where(F.col("__error").isNull()).select(*columns, result), failures


def fetched(urls: DataFrame, fetch: Callable[[str], str], url: str = "url") -> DataFrame:
    """``urls`` with ``text`` and ``error``: a provider is asked once for each row, each host's in one task, one after the other; what fails is told and stops nothing else."""
    columns = urls.columns
    at = columns.index(url)
    dealt = urls.withColumn("__host", netloc(F.col(url))).repartition("__host").sortWithinPartitions("__host", url).drop("__host")

    def mapper(batches):
        for batch in batches:
            texts, errors = [], []
            for u in batch.column(at).to_pylist():
                try:
                    texts.append(fetch(u))
                    errors.append(None)
                except Exception as failed:  # the failure is the row's result
                    texts.append(None)
                    errors.append(f"{type(failed).__name__}: {failed}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[*columns, "text", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return dealt.mapInArrow(mapper, f"{schema}, text string, error string")


def briefing(axes: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """Markdown for each company: total, axes by gap severity, costs if there are any, gaps in the evidence."""
    line = F.format_string("- **%s**: %d (confiança %.2f, gap %.2f)", F.col("axis"), F.col("score"), F.col("confidence").cast("double"), F.col("gap_severity").cast("double"))
    weak = F.when(~F.col("is_actionable"), F.format_string("- %s: evidência insuficiente", F.col("axis")))
    order = F.struct((-F.col("gap_severity")).alias("s"), "position", line.alias("line"))
    per = axes.groupBy("company_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"]).alias("lines"), F.array_sort(F.array_compact(F.collect_list(weak))).alias("weak"))
    if costs is not None:
        table = costs.groupBy("company_id").agg(F.array_sort(F.collect_list(F.format_string("| %s | %.2f | %.2f |", F.col("scenario"), F.col("api_usd"), F.col("gpu_usd")))).alias("costs"))
        per = per.join(table, "company_id", "left")
    else:
        per = per.withColumn("costs", F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    gaps = F.concat(F.col("weak"), F.when(F.size(F.coalesce("costs", none)) == 0, F.array(F.lit("- sem estimativa de custo"))).otherwise(none))
    body = F.concat(
        F.array(F.format_string("# Empresa %d", F.col("company_id")), F.lit("## Eixos")),
        F.col("lines"),
        F.when(F.size(F.coalesce("costs", none)) > 0, F.concat(F.array(F.lit("## Custo")), F.col("costs"))).otherwise(none),
        F.when(F.size(gaps) > 0, F.concat(F.array(F.lit("## Lacunas")), gaps)).otherwise(none),
    )
    return per.select("company_id", F.array_join(body, "\n").alias("markdown"))


def sanitise(recommendations: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recommendations with their real citations, each chunk once; those without any are dropped and named."""
    real = recommendations.join(matched, "citation_id").dropDuplicates(["recommendation_id", "chunk_id"])
    kept = real.groupBy("recommendation_id", "technology").agg(F.sort_array(F.collect_list("chunk_id")).alias("chunks"))
    dropped = recommendations.select("recommendation_id", "technology").distinct().join(kept.select("recommendation_id"), "recommendation_id", "left_anti")
    return kept, dropped


def retrieval_text(axis: Column, sector: Column, provider: Column, techs: Column) -> Column:
    """What to search for an axis: its name with the company's sector, provider and first five technologies."""
    return F.concat_ws(" ", F.replace(axis, F.lit("_"), F.lit(" ")), sector, F.replace(provider, F.lit("_"), F.lit(" ")), F.array_join(F.slice(techs, 1, 5), " "))


def history_limit(runs: DataFrame, n: int = V.RUNS_KEPT) -> DataFrame:
    """Unfinished runs and the newest ``n`` finished ones."""
    from pyspark.sql import Window

    finished = runs.where("finished").withColumn("__n", F.row_number().over(Window.partitionBy("owner").orderBy(F.col("at").desc(), F.col("run").desc()))).where(F.col("__n") <= n).drop("__n")
    return runs.where("not finished").unionByName(finished)
