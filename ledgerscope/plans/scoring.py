"""Queries over score runs: history, gaps, changes, priorities, cost, the ranked queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope import fixed_values as V
from ledgerscope.functions import scores as S
from ledgerscope.operators import cost, history
from ledgerscope.plans import adapters as A
from ledgerscope.plans.registry import half_even, query

_AXES = ", ".join(
    f"{{'axis': '{name}', 'position': {i}, 'score': CAST((o_orderkey * {7 + 6 * i} + o_custkey * 3) % 101 AS INT), 'conf': CAST((o_orderkey * {11 + 2 * i}) % 101 AS INT), 'w': {V.AXIS_WEIGHTS[name]}}}" for i, name in enumerate(V.AXES)
)
#: Runs with totals in tenths, risk in tenths, confidence in thousandths.
RUNS = f"""runs AS (SELECT o_custkey AS company_id, o_orderkey AS run_id, o_orderdate AS created_at, [{_AXES}] AS axes,
 [o_orderkey % 7, o_orderkey % 11 % 7, o_custkey % 7] AS evidence FROM orders),
flat AS (SELECT company_id, run_id, created_at, evidence, unnest(axes) AS a FROM runs),
axes AS (SELECT company_id, run_id, created_at, evidence, a.axis AS axis, a.position AS position, a.score AS score, a.conf AS conf, a.w AS w,
 {half_even('(100 - a.score) * a.conf * a.w', 100)} AS severity FROM flat),
summed AS (SELECT company_id, run_id, created_at, sum(score * w)::BIGINT AS s, sum(conf * w)::BIGINT AS c FROM axes GROUP BY ALL),
totals AS (SELECT company_id, run_id, created_at, {half_even('s', 10)} AS total10, 1000 - {half_even('s', 10)} AS risk10, {half_even('c', 10)} AS conf1000 FROM summed),
ordered AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, run_id DESC) AS rank FROM totals)"""
_PRIORITY = "SELECT o_orderkey AS run_id, o_orderkey % 101 / 100.0::DOUBLE AS capacity FROM orders WHERE o_orderkey % 5 <> 0"


def _double(*names):
    return [F.col(n).cast("double").alias(n) for n in names]


def _urgency(spark, sf_dir) -> DataFrame:
    """Each run's totals with capacity, bucket and urgency; runs without a priority have nulls."""
    runs = history.totals(A.runs(spark, sf_dir)).select("company_id", "run_id", "created_at", *_double("total", "risk", "confidence"))
    found = runs.join(A.priorities(spark, sf_dir), "run_id", "left")
    urgency = S.urgency(F.col("risk"), F.col("capacity"), F.col("confidence"))
    bucket = F.when(F.col("capacity").isNotNull(), S.bucket(F.col("total"), F.col("confidence"), F.col("capacity"), F.lit(None).cast("string")))
    return found.withColumn("urgency", F.when(F.col("capacity").isNotNull(), urgency)).withColumn("bucket", bucket)


_URGENT = f"""priority AS ({_PRIORITY}),
urgent AS (SELECT o.*, total10 / 10.0::DOUBLE AS total, risk10 / 10.0::DOUBLE AS risk, conf1000 / 1000.0::DOUBLE AS confidence, p.capacity,
 CASE WHEN p.capacity IS NULL THEN NULL ELSE round(least(100.0, greatest(0.0, (risk10 / 10.0::DOUBLE) * p.capacity * greatest(conf1000 / 1000.0::DOUBLE, 0.1::DOUBLE))), 1) END AS urgency,
 CASE WHEN p.capacity IS NULL THEN NULL WHEN conf1000 < 350 THEN 'monitorar' WHEN total10 >= 650 THEN 'case_potencial' WHEN p.capacity >= 0.5 THEN 'abordar_agora' ELSE 'nutrir' END AS bucket
 FROM ordered o LEFT JOIN priority p USING (run_id))"""


@query(f"WITH {RUNS}, {_URGENT} SELECT c_custkey AS company_id, c_name AS name, c_mktsegment AS sector, n_name AS country, u.run_id, u.created_at, u.total, u.risk, u.confidence, u.capacity, u.bucket, u.urgency FROM urgent u JOIN customer ON c_custkey = company_id LEFT JOIN nation ON c_nationkey = n_nationkey WHERE rank = 1")
def ranked_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scored company's latest run with its priority, in the order of work."""
    companies = A.companies(spark, sf_dir).select("company_id", "name", "sector", "country")
    runs = history.totals(history.latest(A.runs(spark, sf_dir))).select("company_id", "run_id", "created_at", *_double("total", "risk", "confidence"))
    latest = runs.join(A.priorities(spark, sf_dir), "run_id", "left")
    scored = latest.withColumn("urgency", S.urgency(F.col("risk"), F.col("capacity"), F.col("confidence"))).withColumn("bucket", F.when(F.col("capacity").isNotNull(), S.bucket(F.col("total"), F.col("confidence"), F.col("capacity"), F.lit(None).cast("string"))))
    found = companies.join(scored, "company_id")
    return history.in_order(found.select("company_id", "name", "sector", "country", "run_id", "created_at", "total", "risk", "confidence", "capacity", "bucket", F.when(F.col("capacity").isNotNull(), F.col("urgency")).alias("urgency")))


@query(f"WITH {RUNS}, {_URGENT} SELECT company_id, run_id, risk, confidence, bucket, urgency FROM urgent WHERE rank = 1 AND bucket = 'abordar_agora' AND risk >= 50 AND confidence >= 0.4")
def queue_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue of one bucket above a least risk and confidence."""
    runs = _urgency(spark, sf_dir)
    companies = A.companies(spark, sf_dir).select("company_id")
    return history.queue(companies, runs.drop("capacity", "bucket", "urgency"), runs.select("run_id", "bucket", "urgency"), bucket="abordar_agora", min_risk=50, min_confidence=0.4).select("company_id", "run_id", "risk", "confidence", "bucket", "urgency")


@query(f"WITH {RUNS} SELECT company_id, run_id, created_at, total10 / 10.0::DOUBLE AS total, risk10 / 10.0::DOUBLE AS risk, conf1000 / 1000.0::DOUBLE AS confidence FROM ordered WHERE rank = 1")
def latest_score_per_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.totals(history.latest(A.runs(spark, sf_dir))).select("company_id", "run_id", "created_at", *_double("total", "risk", "confidence"))


@query(f"WITH {RUNS} SELECT company_id, run_id, created_at, rank, total10 / 10.0::DOUBLE AS total FROM ordered WHERE rank <= {V.HISTORY_KEPT}")
def score_history_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.totals(history.last_rows(A.runs(spark, sf_dir), V.HISTORY_KEPT)).select("company_id", "run_id", "created_at", "rank", *_double("total"))


@query(f"WITH {RUNS} SELECT company_id, run_id, axis, position, score, conf / 100.0::DOUBLE AS confidence, severity / 100.0::DOUBLE AS gap_severity, conf >= 35 AS is_actionable FROM (SELECT company_id, run_id, axis, position, score, conf, {half_even('(100 - score) * conf * w', 100)} AS severity FROM axes)")
def axis_scores_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.axis_rows(A.runs(spark, sf_dir)).select("company_id", "run_id", "axis", "position", "score", *_double("confidence", "gap_severity"), "is_actionable")


@query(f"WITH {RUNS} SELECT company_id, run_id, total10 / 10.0::DOUBLE AS total, risk10 / 10.0::DOUBLE AS risk, conf1000 / 1000.0::DOUBLE AS confidence, true AS valid FROM totals")
def defensibility_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = A.runs(spark, sf_dir).withColumn("valid", history.valid_axes(F.col("axes")))
    return history.totals(runs).select("company_id", "run_id", *_double("total", "risk", "confidence"), "valid")


_GAPS = """gaps AS (SELECT company_id, run_id, arg_max(axis, severity * 10 - position) AS weakest_axis,
 coalesce(list(axis ORDER BY severity DESC, position) FILTER (WHERE conf >= 35 AND score < 60), []) AS gaps FROM axes GROUP BY ALL)"""


@query(f"WITH {RUNS}, {_GAPS} SELECT company_id, run_id, weakest_axis FROM gaps")
def weakest_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.gaps(history.axis_rows(A.runs(spark, sf_dir))).select("company_id", "run_id", "weakest_axis")


@query(f"WITH {RUNS}, {_GAPS} SELECT company_id, run_id, array_to_string(gaps, ',') AS gaps, len(gaps) AS n_gaps FROM gaps")
def actionable_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.gaps(history.axis_rows(A.runs(spark, sf_dir))).select("company_id", "run_id", F.array_join("gaps", ",").alias("gaps"), F.size("gaps").cast("long").alias("n_gaps"))


_TECH = "MAP {" + ", ".join("'{}': [{}]".format(a, ", ".join(f"'{t}'" for t in ts)) for a, ts in V.AXIS_TECHNOLOGIES.items()) + "}"


@query(
    f"WITH {RUNS}, {_GAPS}, tech AS (SELECT company_id, run_id, flatten(list_transform(gaps, lambda g: {_TECH}[g])) AS t FROM gaps) SELECT company_id, run_id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), '|') AS technologies FROM tech"
)
def candidate_technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.gaps(history.axis_rows(A.runs(spark, sf_dir))).select("company_id", "run_id", F.array_join(history.technologies(F.col("gaps")), "|").alias("technologies"))


@query(f"WITH {RUNS}, {_GAPS} SELECT company_id, run_id, array_to_string(CASE WHEN len(gaps) > 0 THEN gaps[1:2] ELSE [weakest_axis] END, ',') AS axes FROM gaps")
def axes_to_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.gaps(history.axis_rows(A.runs(spark, sf_dir))).select("company_id", "run_id", F.array_join(history.axes_to_query(F.col("gaps"), F.col("weakest_axis")), ",").alias("axes"))


_CHANGES = f"""changes AS (SELECT n.company_id, n.position, n.axis, o.score AS score_before, n.score AS score_after, n.score - o.score AS score_change,
 len(list_filter(list_distinct(n.evidence), lambda e: NOT list_contains(o.evidence, e))) AS new_evidence, n.conf - o.conf AS dc
 FROM (SELECT x.* FROM axes x JOIN ordered USING (run_id) WHERE rank = 1) n JOIN (SELECT x.* FROM axes x JOIN ordered USING (run_id) WHERE rank = 2) o ON n.company_id = o.company_id AND n.axis = o.axis),
kinds AS (SELECT *, CASE WHEN new_evidence > 0 THEN 'nova_evidencia' WHEN dc < -{V.CONFIDENCE_NOISE} AND score_change <= 0 THEN 'confianca_caiu'
 WHEN score_change > {V.SCORE_NOISE} AND dc >= -{V.CONFIDENCE_NOISE} THEN 'melhorou' WHEN score_change < -{V.SCORE_NOISE} AND dc >= -{V.CONFIDENCE_NOISE} THEN 'piorou' ELSE 'estavel' END AS kind FROM changes)"""


@query(f"WITH {RUNS}, {_CHANGES} SELECT company_id, axis, score_before, score_after, score_change, new_evidence, kind FROM kinds")
def score_delta_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.axis_changes(A.runs(spark, sf_dir)).select("company_id", "axis", "score_before", "score_after", "score_change", F.col("new_evidence").cast("long").alias("new_evidence"), "kind")


_HEADLINE = f"""moved AS (SELECT *, list_position(['{"', '".join(V.CHANGE_ORDER)}'], kind) AS o FROM kinds)"""


@query(
    f"WITH {RUNS}, {_CHANGES}, {_HEADLINE} SELECT company_id, bool_or(kind <> 'estavel') AS has_changes, arg_min(axis, o * 10 + position) FILTER (WHERE kind <> 'estavel') AS headline_axis, arg_min(kind, o * 10 + position) FILTER (WHERE kind <> 'estavel') AS headline_kind FROM moved GROUP BY company_id"
)
def delta_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.headlines(history.axis_changes(A.runs(spark, sf_dir)))


@query(f"WITH {RUNS}, {_CHANGES}, {_HEADLINE}, per AS (SELECT company_id, bool_or(kind <> 'estavel') AS c FROM moved GROUP BY company_id) SELECT count(*) AS companies, count(*) FILTER (WHERE c) AS changed FROM per")
def changed_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many companies have two runs, and how many of them changed."""
    return history.headlines(history.axis_changes(A.runs(spark, sf_dir))).agg(F.count("*").alias("companies"), F.count_if("has_changes").alias("changed"))


@query(f"WITH {RUNS}, {_URGENT} SELECT coalesce(bucket, 'sem_prioridade') AS bucket, count(*) AS n FROM urgent WHERE rank = 1 GROUP BY ALL")
def queue_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = history.latest(_urgency(spark, sf_dir))
    return latest.groupBy(F.coalesce("bucket", F.lit("sem_prioridade")).alias("bucket")).agg(F.count("*").alias("n"))


_CAPACITY = f"""signals AS (SELECT c_custkey AS company_id,
 (SELECT 1) AS one, CASE c_custkey % 6 WHEN 0 THEN 0.3 WHEN 1 THEN 0.7 WHEN 2 THEN 1.0 WHEN 3 THEN 0.85 WHEN 4 THEN 0.4 ELSE 0.3 END::DOUBLE AS stage,
 CASE WHEN c_custkey % 5 = 0 THEN 0.0 WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN 1.0 WHEN c_custkey % 7 = 0 THEN 0.3 ELSE 0.0 END::DOUBLE AS founder,
 CASE c_custkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.4 WHEN 2 THEN 1.0 ELSE 0.4 END::DOUBLE AS hiring FROM customer),
rounds AS (SELECT o_custkey AS company_id, max(CASE WHEN o_orderkey % 9 = 0 THEN 0.3::DOUBLE
 ELSE CASE WHEN date_diff('day', o_orderdate::DATE, DATE '{A.TODAY}') / {V.DAYS_PER_MONTH}::DOUBLE < 0 OR date_diff('day', o_orderdate::DATE, DATE '{A.TODAY}') / {V.DAYS_PER_MONTH}::DOUBLE > {V.FUNDING_MONTHS} THEN 0.0::DOUBLE
 ELSE 1 - date_diff('day', o_orderdate::DATE, DATE '{A.TODAY}') / {V.DAYS_PER_MONTH}::DOUBLE / {V.FUNDING_MONTHS} END END) AS f FROM orders GROUP BY 1),
capacity AS (SELECT s.company_id, round(coalesce(f, 0.0), 3) AS funding, founder, hiring, stage,
 least(1000, {half_even('CAST(round(coalesce(f, 0.0) * 1000) AS BIGINT) * 40 + CAST(round(founder * 1000) AS BIGINT) * 25 + CAST(round(hiring * 1000) AS BIGINT) * 20 + CAST(round(stage * 1000) AS BIGINT) * 15', 100)}) / 1000.0::DOUBLE AS capacity FROM signals s LEFT JOIN rounds USING (company_id))"""


def _capacity(spark, sf_dir) -> DataFrame:
    """Capacity to act with its four signals; orders stand for funding rounds, some without a date."""
    key = F.col("company_id")
    orders = A.table(spark, sf_dir, "orders")
    announced = F.when(F.col("o_orderkey") % 9 != 0, F.to_date("o_orderdate"))
    rounds = orders.groupBy(F.col("o_custkey").alias("company_id")).agg(F.round(F.max(S.funding_signal(announced, F.lit(A.TODAY).cast("date"))), 3).alias("funding"))
    yes, unknown = F.lit(True), F.lit(None).cast("boolean")
    founders = F.when(key % 5 == 0, F.array().cast("array<boolean>")).otherwise(F.array(F.when(key % 3 == 0, yes).when(key % 7 != 0, F.lit(False)), F.when(key % 4 == 0, yes).otherwise(unknown)))
    roles = A.pick(("", "Vendas", "MLOps pleno", "Suporte"), key % 4)
    c = A.companies(spark, sf_dir).join(rounds, "company_id", "left")
    c = c.select("company_id", F.coalesce("funding", F.lit(0.0)).alias("funding"), S.founder_signal(founders).alias("founder"), S.hiring_signal(F.filter(F.array(roles), lambda r: r != "")).alias("hiring"), S.stage_signal(F.col("stage")).alias("stage"))
    return c.withColumn("capacity", S.capacity(*map(F.col, ("funding", "founder", "hiring", "stage"))))


@query(f"WITH {_CAPACITY} SELECT * FROM capacity")
def capacity_to_act(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capacity(spark, sf_dir)


@query(
    f"WITH {RUNS}, {_CAPACITY} SELECT company_id, c.capacity, round(least(100.0, greatest(0.0, (risk10 / 10.0::DOUBLE) * c.capacity * greatest(conf1000 / 1000.0::DOUBLE, 0.1::DOUBLE))), 1) AS urgency, CASE WHEN company_id % 13 = 0 OR conf1000 < 350 THEN 'monitorar' WHEN total10 >= 650 THEN 'case_potencial' WHEN c.capacity >= 0.5 THEN 'abordar_agora' ELSE 'nutrir' END AS bucket FROM ordered JOIN capacity c USING (company_id) WHERE rank = 1"
)
def priority_bucket_urgency(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = history.totals(history.latest(A.runs(spark, sf_dir))).select("company_id", *_double("total", "risk", "confidence"))
    found = latest.join(_capacity(spark, sf_dir).select("company_id", "capacity"), "company_id")
    maturity = F.when(F.col("company_id") % 13 == 0, "indeterminado").otherwise("ai_native")
    return found.select("company_id", "capacity", S.urgency(F.col("risk"), F.col("capacity"), F.col("confidence")).alias("urgency"), S.bucket(F.col("total"), F.col("confidence"), F.col("capacity"), maturity).alias("bucket"))


_CATEGORIES = tuple(V.BASE_TOKENS)
_PRICES = tuple(V.API_PRICES)


def _products(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    return A.table(spark, sf_dir, "part").select(key.alias("product_id"), A.pick(_CATEGORIES, key % 7).alias("category"), F.when(key % 6 != 5, A.pick(_PRICES, key % 6 % 5)).alias("provider"), F.col("p_size").alias("headcount"))


_case = lambda column, table: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " END"
_COSTS = f"""products AS (SELECT p_partkey AS product_id, [{", ".join(f"'{c}'" for c in _CATEGORIES)}][p_partkey % 7 + 1] AS category,
 CASE WHEN p_partkey % 6 <> 5 THEN [{", ".join(f"'{c}'" for c in _PRICES)}][p_partkey % 6 % 5 + 1] END AS provider, p_size AS headcount FROM part),
scen AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in V.SCENARIOS.items())}) s(scenario, factor)),
est AS (SELECT product_id, category, provider, headcount, scenario, CAST(floor(({_case('category', V.BASE_TOKENS)})::DOUBLE * factor * CASE WHEN headcount > 0 THEN sqrt(headcount / 25.0::DOUBLE) ELSE 1.0 END) AS BIGINT) AS tokens,
 ({_case('provider', V.API_PRICES)})::DOUBLE AS price FROM products, scen WHERE provider IS NOT NULL),
gpus AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{g}', {h}::DOUBLE, {V.GPU_TOKENS_PER_SECOND[g]}::DOUBLE)" for i, (g, h) in enumerate(V.GPU_HOURLY.items()))}) g(place, gpu, hourly, tps)),
options AS (SELECT est.*, place, gpu, greatest(1, CAST(ceil(tokens / (tps * {V.GPU_UTILISATION}::DOUBLE * {V.HOURS_PER_MONTH * 3600})) AS BIGINT)) AS n, hourly FROM est, gpus),
best AS (SELECT *, round(n * hourly * {V.HOURS_PER_MONTH}, 2) AS gpu_usd, row_number() OVER (PARTITION BY product_id, scenario ORDER BY round(n * hourly * {V.HOURS_PER_MONTH}, 2), place) AS r FROM options)"""


@query(
    f"WITH {_COSTS} SELECT product_id, category, provider, headcount, scenario, tokens, price, round(tokens / 1000000 * price, 2) AS api_usd, gpu_usd, n || 'x ' || upper(gpu) AS gpu, round(round(tokens / 1000000 * price, 2) - gpu_usd, 2) AS savings_usd, CASE WHEN round(tokens / 1000000 * price, 2) > 0 THEN round(round(round(tokens / 1000000 * price, 2) - gpu_usd, 2) / round(tokens / 1000000 * price, 2) * 100, 1) END AS savings_pct, round(round(tokens / 1000000 * price, 2) - gpu_usd, 2) > 0 AS is_favorable, CAST(floor(gpu_usd / price * 1000000) AS BIGINT) AS break_even_tokens, tokens < {V.LEAST_TOKENS} AS below_floor FROM best WHERE r = 1"
)
def tco_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.estimates(_products(spark, sf_dir))


@query(f"WITH {_COSTS} SELECT gpu, n, count(*) AS products, round(sum(gpu_usd), 2) AS usd FROM best WHERE r = 1 GROUP BY ALL")
def cheapest_gpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often which machines are the cheapest."""
    rows = _products(spark, sf_dir).where(F.col("provider").isNotNull()).crossJoin(F.broadcast(cost.scenarios(spark)))
    best = rows.select(cost.cheapest_gpu(cost.monthly_tokens(F.col("category"), F.col("factor"), F.col("headcount"))).alias("b"))
    return best.groupBy(F.col("b.gpu").alias("gpu"), F.col("b.n").alias("n")).agg(F.count("*").alias("products"), F.round(F.sum("b.cost"), 2).alias("usd"))
