"""Monthly cost of an outside model against own GPUs, in three scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope import fixed_values as V


def gpu_capacity(tokens_per_second: Column) -> Column:
    """Tokens that a GPU serves in a month."""
    return tokens_per_second * F.lit(V.GPU_UTILISATION) * F.lit(V.HOURS_PER_MONTH * 3600)


def monthly_tokens(category: Column, factor: Column, headcount: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in V.BASE_TOKENS.items() for x in pair))
    base = F.coalesce(F.try_element_at(table, category), F.lit(V.BASE_TOKENS[V.UNKNOWN]))
    size = F.when(headcount > 0, F.sqrt(headcount / F.lit(float(V.REFERENCE_HEADCOUNT)))).otherwise(F.lit(1.0))
    return F.floor(base * factor * size).cast("long")


def cheapest_gpu(tokens: Column) -> Column:
    """``gpu, n, cost`` of the cheapest machines that serve ``tokens``; ties go to the first in the table."""
    options = []
    for i, (gpu, hourly) in enumerate(V.GPU_HOURLY.items()):
        n = F.greatest(F.lit(1), F.ceil(tokens / gpu_capacity(F.lit(V.GPU_TOKENS_PER_SECOND[gpu])))).cast("long")
        options.append(F.struct(F.round(n * F.lit(hourly) * V.HOURS_PER_MONTH, 2).alias("cost"), F.lit(i).alias("place"), F.lit(gpu).alias("gpu"), n.alias("n")))
    return F.array_min(F.array(*options))


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(V.SCENARIOS.items()), "scenario string, factor double")


def estimates(companies: DataFrame) -> DataFrame:
    """Three rows for each row of ``companies`` (category, provider, headcount) whose provider is known."""
    rows = companies.where(F.col("provider").isNotNull()).crossJoin(F.broadcast(scenarios(companies.sparkSession)))  # three rows
    prices = F.create_map(*(F.lit(x) for pair in V.API_PRICES.items() for x in pair))
    price = F.coalesce(F.try_element_at(prices, F.col("provider")), F.lit(V.API_PRICES[V.UNKNOWN]))
    found = rows.withColumn("tokens", monthly_tokens(F.col("category"), F.col("factor"), F.col("headcount"))).withColumn("price", price).withColumn("best", cheapest_gpu(F.col("tokens")))
    found = found.withColumn("api_usd", F.round(F.col("tokens") / 1_000_000 * F.col("price"), 2)).withColumn("gpu_usd", F.col("best.cost"))
    saved = F.round(F.col("api_usd") - F.col("gpu_usd"), 2)
    return (
        found.withColumn("savings_usd", saved)
        .withColumn("savings_pct", F.when(F.col("api_usd") > 0, F.round(F.col("savings_usd") / F.col("api_usd") * 100, 1)))
        .withColumn("is_favorable", F.col("savings_usd") > 0)
        .withColumn("break_even_tokens", F.floor(F.col("gpu_usd") / F.col("price") * 1_000_000).cast("long"))
        .withColumn("below_floor", F.col("tokens") < V.LEAST_TOKENS)
        .withColumn("gpu", F.format_string("%dx %s", F.col("best.n"), F.upper(F.col("best.gpu"))))
        .drop("best", "factor")
    )


def assumptions() -> Column:
    """The sentences that go with an estimate; the last only below the floor."""
    say, millions = V.ASSUMPTION_TEXTS, lambda tokens: F.bround(tokens / 1_000_000, 0)
    of = lambda table: F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[F.lower(F.regexp_extract("gpu", r"^[0-9]+x (.*)$", 1))]
    return F.array_compact(
        F.array(
            F.format_string(say[0], millions(F.col("tokens")), F.col("category"), F.col("scenario")),
            F.format_string(say[1], F.col("price"), F.col("provider")),
            F.format_string(say[2], F.col("gpu"), of(V.GPU_HOURLY), F.lit(V.HOURS_PER_MONTH)),
            F.format_string(say[3], F.lit(round(V.GPU_UTILISATION * 100))),
            F.format_string(say[4], F.format_number(of(V.GPU_TOKENS_PER_SECOND), 0)),
            F.format_string(say[5], millions(F.col("break_even_tokens"))),
            F.format_string(say[6], F.lit(V.PRICES_OF)),
            F.lit(say[7]),
            F.when(F.col("below_floor"), F.format_string(say[8], F.lit(V.LEAST_TOKENS / 1e6))),
        )
    )
