"""Read models: evidence behind hashes, company details, citations as rows, contexts, orders of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope import fixed_values as V


def resolved(rows: DataFrame, refs: str, evidence: DataFrame, key: str, by: str) -> DataFrame:
    """``by, found`` (evidence in the order of its references): a reference without evidence is left out."""
    each = rows.select(by, F.posexplode(refs).alias("__at", key))
    met = each.join(evidence, key).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("__at", F.struct(*evidence.columns).alias("e")))).alias("__found"))
    return met.select(by, F.transform("__found", lambda x: x["e"]).alias("found"))


def referenced(found: Column, key: str) -> Column:
    """Evidence as the references that a stored row keeps of it."""
    return F.transform(found, lambda e: e[key])


def citation_rows(answers: DataFrame, citations: Column, by: list[str]) -> DataFrame:
    """A row for each citation of an answer, with its position: what a bridge table holds."""
    return answers.select(*by, F.posexplode(citations).alias("position", "item"))


def ordered_by(df: DataFrame, *order: Column, within: list[str], name: str = "place") -> DataFrame:
    """Rows numbered in an order within groups; the last of ``order`` keeps ties stable."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


def numbered_context(chunks: DataFrame, by: str, order: str, title: Column, body: Column, most: int | None = None, chars: int | None = None) -> DataFrame:
    """``by, context, n``: chunks as one text, each under its number and title, ``most`` of them and ``chars`` of each if that is asked."""
    placed = ordered_by(chunks.withColumn("__title", title).withColumn("__body", F.substring(body, 1, chars) if chars else body), F.col(order), within=[by], name="__n")
    kept = placed.where(F.col("__n") <= most) if most else placed
    one = F.concat(F.lit("["), F.col("__n").cast("string"), F.lit("] "), F.coalesce("__title", F.lit("")), F.lit("\n"), F.coalesce("__body", F.lit("")))
    return kept.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("__n", one.alias("t")))).alias("x"), F.count("*").alias("n")).select(by, F.array_join(F.transform("x", lambda p: p["t"]), "\n\n").alias("context"), "n")


def grounded(context: Column, n: Column, question: Column) -> Column:
    """A question under its numbered context; asking without any chunk is an error."""
    return F.when(n > 0, F.concat(context, F.lit("\n\n"), question)).otherwise(F.raise_error(F.lit("no chunk to ground an answer in")))


def annulled(row: DataFrame, unsupported: Column, fields: list[str]) -> DataFrame:
    """Fields that an audit names as unsupported become null."""
    return row.withColumns({f: F.when(~F.coalesce(F.array_contains(unsupported, f), F.lit(False)), F.col(f)) for f in fields})


def followed_links(links: Column, seen: Column, most: int = 5) -> Column:
    """The first different links that were not seen before."""
    return F.slice(F.filter(F.array_distinct(links), lambda x: ~F.array_contains(seen, x)), 1, most)


def refresh(companies: DataFrame, history: DataFrame, key: str = "company_id") -> DataFrame:
    """``companies`` with ``refresh``: one seen before has its signal pages fetched anew."""
    known = history.select(key).distinct().withColumn("refresh", F.lit(True))
    return companies.join(known, key, "left").withColumn("refresh", F.coalesce("refresh", F.lit(False)))


def iso_time(text: Column) -> Column:
    """ISO dates and times, without a zone in UTC; null where none can be read."""
    plain = F.trim(text)
    zoned = F.regexp_replace(plain, "[zZ]$", "+00:00")
    shaped = zoned.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:?\d{2})?)?$")
    zoned = F.regexp_replace(zoned, r"^(.{10}[T ]\d{2}:\d{2})($|[+-])", "$1:00$2")
    has_zone = zoned.rlike(r"\d{2}:\d{2}.*[+-]\d{2}:?\d{2}$")
    return F.when(shaped, F.try_to_timestamp(F.when(has_zone, zoned).otherwise(F.concat(zoned, F.when(F.length(zoned) > 10, "+00:00").otherwise("T00:00:00+00:00")))))


def unions(**parts: DataFrame) -> DataFrame:
    """What parallel branches gave as one table, every row kept, with the branch as ``branch``."""
    found = None
    for name, part in parts.items():
        rows = part.withColumn("branch", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    return found


def checked_weights(weights: dict[str, float], prices: dict[str, float]) -> None:
    """Weights have to sum to one whole, and every price has to be above zero."""
    if abs(sum(weights.values()) - 100) > 1e-6:
        raise ValueError(f"weights sum to {sum(weights.values())}, not 100")
    wrong = [name for name, value in prices.items() if not value > 0]
    if wrong:
        raise ValueError(f"without a value above zero: {wrong}")


def robots_url(url: Column) -> Column:
    """Where a host's rules for robots are."""
    return F.concat(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), F.lit("/robots.txt"))


def axis_order(axis: Column) -> Column:
    """Axes by falling weight."""
    return F.array_position(F.array(*map(F.lit, sorted(V.AXIS_WEIGHTS, key=V.AXIS_WEIGHTS.get, reverse=True))), axis)


def errors(checks: dict[str, Column], most: int = 15) -> Column:
    """Names of the checks that fail, in order."""
    return F.slice(F.array_compact(F.array(*(F.when(wrong, F.lit(name)) for name, wrong in checks.items()))), 1, most)
