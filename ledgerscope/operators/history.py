"""Score history: latest rows, last rows, differences between runs, the ranked queue.

Every ``latest`` is one window over the key with the row's id as tie-break, so
the engine limits each partition to the wanted ranks before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope import fixed_values as V
from ledgerscope.sources.shared import materialize
from ledgerscope.functions import scores as S


def ranked(df: DataFrame, key: str, *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def last_rows(df: DataFrame, n: int, key: str = "company_id", at: str = "created_at", row_id: str = "run_id") -> DataFrame:
    """The newest ``n`` rows of each key, with their ``rank``."""
    return ranked(df, key, F.col(at).desc(), F.col(row_id).desc()).where(F.col("rank") <= n)


def latest(df: DataFrame, key: str = "company_id", at: str = "created_at", row_id: str = "run_id") -> DataFrame:
    return last_rows(df, 1, key, at, row_id).drop("rank")


def totals(runs: DataFrame) -> DataFrame:
    """``runs`` (axes as an array of ``axis, score, confidence``) with total, risk and confidence of the whole."""
    weigh = lambda what: F.aggregate("axes", F.lit(0).cast("decimal(12,4)"), lambda acc, a: (acc + what(a) * S.weight(a["axis"])).cast("decimal(12,4)"))
    total = F.bround(weigh(lambda a: a["score"].cast("decimal(5,2)")), 1)
    return runs.withColumn("total", total).withColumn("risk", F.bround(100 - F.col("total"), 1)).withColumn("confidence", F.bround(weigh(lambda a: a["confidence"].cast("decimal(5,2)")), 3))


def valid_axes(axes: Column) -> Column:
    """Whether a score has each of the four axes once."""
    return (F.size(axes) == len(V.AXES)) & (F.size(F.array_distinct(F.transform(axes, lambda a: a["axis"]))) == len(V.AXES))


def axis_rows(runs: DataFrame) -> DataFrame:
    """A row for each axis of each run, with its gap severity and whether it is actionable."""
    flat = runs.select("company_id", "run_id", "created_at", F.posexplode("axes").alias("position", "a")).select("company_id", "run_id", "created_at", "position", "a.*")
    return flat.withColumn("gap_severity", S.gap_severity(F.col("axis"), F.col("score"), F.col("confidence"))).withColumn("is_actionable", S.is_actionable(F.col("confidence")))


def gaps(axes: DataFrame) -> DataFrame:
    """Each run's weakest axis and its actionable gaps, the severest first; ties by the axis' position."""
    worst = F.max_by("axis", F.struct("gap_severity", -F.col("position"))).alias("weakest_axis")
    is_gap = F.col("is_actionable") & (F.col("score") < V.GAP_SCORE)
    found = F.array_sort(F.collect_list(F.when(is_gap, F.struct((-F.col("gap_severity")).alias("s"), "position", "axis"))))  # four axes at most
    return axes.groupBy("company_id", "run_id").agg(worst, F.transform(found, lambda g: g["axis"]).alias("gaps"))


def technologies(gap_names: Column) -> Column:
    """Technologies that address the gaps, in order, each once."""
    table = F.create_map(*(x for axis, names in V.AXIS_TECHNOLOGIES.items() for x in (F.lit(axis), F.array(*map(F.lit, names)))))
    return F.array_distinct(F.flatten(F.transform(gap_names, lambda g: table[g])))


def axes_to_query(gap_names: Column, weakest: Column) -> Column:
    """The two severest gaps, or the weakest axis."""
    return F.when(F.size(gap_names) > 0, F.slice(gap_names, 1, 2)).otherwise(F.array(weakest))


def axis_changes(runs: DataFrame) -> DataFrame:
    """Each company's newest run against the one before it, axis by axis; axes that were missing before are left out."""
    pair = last_rows(runs, 2)
    side = lambda rank: axis_rows(pair.where(F.col("rank") == rank)).join(pair.where(F.col("rank") == rank).select("run_id", "evidence"), "run_id")
    new, old = side(1), side(2)
    old = old.select("company_id", "axis", F.col("score").alias("score_before"), F.col("confidence").alias("confidence_before"), F.col("evidence").alias("evidence_before"))
    both = new.join(old, ["company_id", "axis"])
    fresh = F.size(F.array_except("evidence", "evidence_before"))
    change = F.col("score") - F.col("score_before")
    steps = F.round((F.col("confidence") - F.col("confidence_before")) * 100).cast("int")
    return both.select("company_id", "position", "axis", "score_before", F.col("score").alias("score_after"), change.alias("score_change"), fresh.alias("new_evidence"), S.change_kind(fresh, change, steps).alias("kind"))


def headlines(changes: DataFrame) -> DataFrame:
    """The change to open a conversation with: new evidence, then worse, then better, then less certain."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, V.CHANGE_ORDER)), F.col("kind")), F.lit(0))
    moved = F.col("kind") != "estavel"
    return changes.groupBy("company_id").agg(
        F.bool_or(moved).alias("has_changes"),
        F.min_by(F.when(moved, F.col("axis")), F.when(moved, F.struct(order, "position"))).alias("headline_axis"),
        F.min_by(F.when(moved, F.col("kind")), F.when(moved, F.struct(order, "position"))).alias("headline_kind"),
    )


def queue(companies: DataFrame, runs: DataFrame, priorities: DataFrame, *, bucket: str | None = None, min_risk: float | None = None, min_confidence: float | None = None) -> DataFrame:
    """Each scored company's latest run with its priority, if it has one, in the order of work (see ``in_order``)."""
    found = companies.join(latest(runs), "company_id").join(priorities, "run_id", "left")
    for wanted, condition in ((bucket, F.col("bucket") == bucket), (min_risk, F.col("risk") >= min_risk), (min_confidence, F.col("confidence") >= min_confidence)):
        if wanted is not None:
            found = found.where(condition)
    return found


def in_order(found: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Urgency, or risk where there is none, falling; then the newest; then the smallest company."""
    ordered = found.orderBy(F.coalesce("urgency", "risk").desc(), F.col("created_at").desc(), "company_id")
    ordered = ordered.offset(offset) if offset else ordered
    return ordered if limit is None else ordered.limit(limit)


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with numbers from 1 in the order of a column without ties: ranges are numbered each by itself, from where the ones before end."""
    ranged = materialize(df.repartitionByRange(order).withColumn("__range", F.spark_partition_id()), "ranges")  # a range keeps its number
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return ranged.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__own")).drop("__range", "__own", "__before")
