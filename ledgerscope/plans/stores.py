"""Queries over keyed stores and logs: merging, caches, budgets, runs, routes, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope import fixed_values as V
from ledgerscope.functions import text as T
from ledgerscope.operators import cost, folds, history, merging, routing
from ledgerscope.plans import adapters as A
from ledgerscope.plans.registry import query
from ledgerscope.streaming import events as E

_STAGES = f"[{', '.join(repr(s) for s in A.STAGES)}]"
_COMPANY = f"company AS (SELECT c_custkey AS company_id, c_name AS name, c_mktsegment AS sector, n_name AS country, {_STAGES}[c_custkey % 6 + 1] AS stage, CAST(1 + c_custkey % 400 AS INT) AS headcount FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"


@query(
    f"WITH {_COMPANY}, known AS (SELECT company_id, name, sector, stage, headcount FROM company WHERE company_id % 3 <> 0), inc AS (SELECT company_id, CASE WHEN company_id % 2 = 0 THEN name || ' SA' END AS name, CASE WHEN company_id % 5 = 0 THEN 'AI' END AS sector, {_STAGES}[(company_id + 1) % 6 + 1] AS stage, NULL::INT AS headcount FROM company WHERE company_id % 4 <> 0) SELECT coalesce(k.company_id, i.company_id) AS company_id, coalesce(i.name, k.name) AS name, coalesce(i.sector, k.sector) AS sector, coalesce(nullif(i.stage, 'desconhecido'), k.stage, i.stage) AS stage, coalesce(i.headcount, k.headcount) AS headcount FROM known k FULL JOIN inc i ON k.company_id = i.company_id"
)
def company_merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known companies merged with what a later collection found."""
    c = A.companies(spark, sf_dir).select("company_id", "name", "sector", "stage", "headcount")
    key = F.col("company_id")
    new = c.where(key % 4 != 0).select(key, F.when(key % 2 == 0, F.concat("name", F.lit(" SA"))).alias("name"), F.when(key % 5 == 0, "AI").alias("sector"), A.pick(A.STAGES, (key + 1) % 6).alias("stage"), F.lit(None).cast("int").alias("headcount"))
    return merging.merge_companies(c.where(key % 3 != 0), new)


_NAME = r"trim(regexp_replace(strip_accents(lower(name)), '[^\p{L}\p{N}]+', ' ', 'g'))"
_SUFFIX = "|".join(V.LEGAL_SUFFIXES)


@query(f"WITH {_COMPANY}, v AS (SELECT company_id, [name || ' Ltda', upper(name) || ' S.A.', 'Ação ' || name || ' ME', name][company_id % 4 + 1] AS name FROM company), f AS (SELECT company_id, name, {_NAME} AS plain FROM v) SELECT company_id, CASE WHEN trim(regexp_replace(plain, '(( |^)({_SUFFIX})| s a)+$', '')) <> '' THEN trim(regexp_replace(plain, '(( |^)({_SUFFIX})| s a)+$', '')) ELSE lower(trim(name)) END AS name_key FROM f")
def normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key, name = A.companies(spark, sf_dir), F.col("company_id"), F.col("name")
    varied = F.element_at(F.array(F.concat(name, F.lit(" Ltda")), F.concat(F.upper(name), F.lit(" S.A.")), F.concat(F.lit("Ação "), name, F.lit(" ME")), name), (key % 4 + 1).cast("int"))
    return c.select(key, T.normal_name(varied).alias("name_key"))


@query(
    f"WITH {_COMPANY}, known AS (SELECT company_id, lower(replace(name, '#', ' ')) AS name_key, CASE WHEN company_id % 2 = 0 THEN 'c' || company_id // 3 || '.com.br' END AS site FROM company), s AS (SELECT site, min(company_id) AS by_site FROM known WHERE site IS NOT NULL GROUP BY 1), n AS (SELECT name_key, min(company_id) AS by_name FROM known GROUP BY 1), inc AS (SELECT company_id AS seen, CASE WHEN company_id % 5 = 0 THEN 'new' ELSE lower(replace(name, '#', ' ')) END AS name_key, CASE WHEN company_id % 3 = 0 THEN 'c' || company_id // 3 || '.com.br' END AS site FROM company) SELECT seen, coalesce(by_site, by_name) AS company_id FROM inc LEFT JOIN s USING (site) LEFT JOIN n USING (name_key)"
)
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which known company each seen one is: by site first, by name if no site fits."""
    c, key = A.companies(spark, sf_dir), F.col("company_id")
    name = F.lower(F.translate("name", "#", " "))
    site = F.concat(F.lit("c"), F.floor(key / 3).cast("string"), F.lit(".com.br"))
    known = c.select(key, name.alias("name_key"), F.when(key % 2 == 0, site).alias("site"))
    seen = c.select(key.alias("seen"), F.when(key % 5 == 0, "new").otherwise(name).alias("name_key"), F.when(key % 3 == 0, site).alias("site"))
    return merging.resolve(seen, known).select("seen", "company_id")


@query(f"WITH {_COMPANY} SELECT company_id, name, stage, country FROM company WHERE contains(lower(name), '00001') AND stage IN ('seed', 'serie_a') ORDER BY name, company_id LIMIT 50")
def company_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of companies by part of the name and stage."""
    found = A.companies(spark, sf_dir).where(F.lower("name").contains("00001") & F.col("stage").isin("seed", "serie_a"))
    return found.select("company_id", "name", "stage", "country").orderBy("name", "company_id").limit(50)


@query("SELECT o_orderkey AS run_id, o_custkey AS company_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that remain when every tenth company is deleted."""
    deleted = A.companies(spark, sf_dir).where("company_id % 10 = 3")
    return merging.cascade(A.runs(spark, sf_dir).select("run_id", "company_id"), deleted, "company_id")


_STATE = """state AS (SELECT d.doc_id AS company_id, CASE WHEN d.doc_id % 17 = 0 THEN 0 ELSE 1 + d.doc_id % 3 END AS pages, d.doc_id % 19 <> 0 AS profile, d.doc_id % 23 = 0 AS recollect, CASE WHEN quality = 0 THEN 'non_ai' WHEN toxic = 1 THEN 'indeterminado' WHEN quality = 1 THEN 'ai_native' END AS maturity, d.doc_id % 2 = 0 AS scored FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
routed AS (SELECT company_id, CASE WHEN pages = 0 THEN 'fim_sem_paginas' WHEN NOT profile THEN 'fim_sem_perfil' WHEN recollect THEN 'collect' WHEN maturity IS NULL THEN 'fim_sem_classificacao' WHEN maturity = 'non_ai' THEN 'fim_non_ai' WHEN NOT scored THEN 'score' ELSE 'compare' END AS stage FROM state)"""


def _routed(spark, sf_dir) -> DataFrame:
    key = F.col("doc_id")
    docs = A.table(spark, sf_dir, "documents").select("doc_id").join(A.table(spark, sf_dir, "labels"), "doc_id", "left")
    maturity = F.when(F.col("quality") == 0, "non_ai").when(F.col("toxic") == 1, "indeterminado").when(F.col("quality") == 1, "ai_native")
    return docs.select(key.alias("company_id"), routing.next_stage(F.when(key % 17 == 0, 0).otherwise(1 + key % 3), key % 19 != 0, key % 23 == 0, maturity, key % 2 == 0).alias("stage"))


@query(f"WITH {_STATE} SELECT * FROM routed")
def pipeline_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir)


@query(f"WITH {_STATE} SELECT stage, count(*) AS companies FROM routed WHERE starts_with(stage, 'fim') GROUP BY stage")
def skipped_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).where(F.col("stage").startswith("fim")).groupBy("stage").agg(F.count("*").alias("companies"))


@query("SELECT event_id, CASE WHEN value < 0 OR event_id % 50 = 0 THEN 'TypeError' ELSE 'HTTPError' END AS error, CASE WHEN value < 0 OR event_id % 50 = 0 THEN 'bug' ELSE 'mundo' END AS kind, event_id % 7 = 0 AS rate_limited FROM events WHERE event_type = 'error'")
def error_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the log: the program's against the world's, and those of a rate limit."""
    e = A.table(spark, sf_dir, "events").where("event_type = 'error'")
    name = F.when((F.col("value") < 0) | (F.col("event_id") % 50 == 0), "TypeError").otherwise("HTTPError")
    limited = routing.is_rate_limit(F.when(F.col("event_id") % 14 == 0, 429), F.when(F.col("event_id") % 14 == 7, "Too Many Requests"))
    return e.select("event_id", name.alias("error"), routing.triage(name).alias("kind"), limited.alias("rate_limited"))


_CACHE_NOW = "2024-01-30 00:00:00"


@query(f"WITH c AS (SELECT user_id, max(ts) AS stored FROM events WHERE event_type = 'view' AND ts <= TIMESTAMP '{_CACHE_NOW}' GROUP BY 1) SELECT user_id, epoch_us(TIMESTAMP '{_CACHE_NOW}' - stored) / 1000000.0::DOUBLE AS age, epoch_us(TIMESTAMP '{_CACHE_NOW}' - stored) / 1000000.0::DOUBLE <= CASE WHEN user_id % 10 = 0 THEN 1e18 ELSE {V.CACHE_DAYS} * 86400 END AS fresh FROM c")
def cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age and freshness of cached answers on a given day; a negative time to live never ends."""
    e = A.table(spark, sf_dir, "events").where((F.col("event_type") == "view") & (F.col("ts") <= F.lit(_CACHE_NOW).cast("timestamp_ntz")))
    stored = e.groupBy("user_id").agg(F.max("ts").alias("stored"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    age = (micros(F.lit(_CACHE_NOW).cast("timestamp_ntz")) - micros(F.col("stored"))) / 1e6
    ttl = F.when(F.col("user_id") % 10 == 0, -1).otherwise(V.CACHE_DAYS * 86400)
    return stored.select("user_id", age.alias("age"), ((ttl < 0) | (age <= ttl)).alias("fresh"))


@query("WITH c AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND event_id % 3 = 0), r AS (SELECT user_id, count(*) AS asked FROM events WHERE event_type = 'click' GROUP BY 1) SELECT user_id, asked, c.user_id IS NOT NULL AS hit FROM r LEFT JOIN c USING (user_id)")
def cache_hits_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against a keyed cache."""
    e = A.table(spark, sf_dir, "events")
    cached = e.where("event_type = 'view' and event_id % 3 = 0").select("user_id").distinct().withColumn("hit", F.lit(True))
    asked = e.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("asked"))
    return asked.join(cached, "user_id", "left").select("user_id", "asked", F.coalesce("hit", F.lit(False)).alias("hit"))


_CALLS = "calls AS (SELECT user_id, ts, event_id, 1 + event_id % 5 AS amount, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query(
    f"WITH RECURSIVE {_CALLS}, f AS (SELECT user_id, event_id, i, amount <= 100 AS accepted, CASE WHEN amount <= 100 THEN amount ELSE 0 END AS used FROM calls WHERE i = 1 UNION ALL SELECT c.user_id, c.event_id, c.i, f.used + c.amount <= 100, CASE WHEN f.used + c.amount <= 100 THEN f.used + c.amount ELSE f.used END FROM f JOIN calls c ON c.user_id = f.user_id AND c.i = f.i + 1) SELECT user_id, event_id, accepted, used::DOUBLE AS used FROM f"
)
def call_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each run against its budget: refused ones cost nothing."""
    calls = A.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (1 + F.col("event_id") % 5).cast("double").alias("amount"))
    return folds.budget(calls, "user_id", ["ts", "event_id"], "amount", 100).select("user_id", "event_id", "accepted", "used")


@query(
    "WITH RECURSIVE q AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (SELECT user_id, event_id, i, 0.0::DOUBLE AS wait, s AS sent FROM q WHERE i = 1 UNION ALL SELECT q.user_id, q.event_id, q.i, greatest(0.0::DOUBLE, f.sent + 3600 - q.s), greatest(q.s, f.sent + 3600) FROM f JOIN q ON q.user_id = f.user_id AND q.i = f.i + 1) SELECT user_id, event_id, round(wait, 3) AS wait FROM f"
)
def rate_limit_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each request waits if an hour lies between any two of a host."""
    e = A.table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return folds.rate_limit(e, "user_id", "ts", "event_id", 3600).select("user_id", "event_id", F.round("wait", 3).alias("wait"))


@query("SELECT user_id, event_id, round(epoch_us(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000.0::DOUBLE, 3) AS gap FROM events")
def request_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds since a host's request before."""
    s = F.unix_micros(F.col("ts").cast("timestamp"))
    before = F.lag(s).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return A.table(spark, sf_dir, "events").select("user_id", "event_id", F.round((s - before) / 1e6, 3).alias("gap"))


_RUN_STATE = "SELECT user_id AS run, arg_max(event_type, (ts, event_id)) AS state, max(event_id) AS last_event, count(*) AS n FROM events GROUP BY user_id"


@query(_RUN_STATE)
def run_state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's newest event as its state."""
    return E.latest_state(A.table(spark, sf_dir, "events"))


_RUNS = "runs AS (SELECT user_id % 3 AS owner, user_id AS run, max(ts) AS ended, arg_max(event_type, (ts, event_id)) IN ('purchase', 'error', 'view') AS finished FROM events GROUP BY user_id)"


@query(f"WITH {_RUNS} SELECT run, finished FROM runs WHERE NOT finished UNION ALL SELECT run, finished FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ended DESC, run DESC) AS n FROM runs WHERE finished) WHERE n <= {V.RUNS_KEPT}")
def run_retention_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running runs and the newest fifty finished ones of each owner."""
    e = A.table(spark, sf_dir, "events")
    runs = e.groupBy(F.col("user_id").alias("run")).agg(F.max("ts").alias("at"), F.max_by("event_type", F.struct("ts", "event_id")).isin("purchase", "error", "view").alias("finished"))
    return routing.history_limit(runs.withColumn("owner", F.col("run") % 3)).select("run", "finished")


@query("SELECT user_id AS run, count(*) AS found, count(*) FILTER (WHERE event_type = 'purchase') AS ready, count(*) FILTER (WHERE event_type = 'error') AS failures, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("found"), F.count_if(F.col("event_type") == "purchase").alias("ready"), F.count_if(F.col("event_type") == "error").alias("failures"), F.count_distinct("event_type").alias("kinds"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_valid(props) AND json_extract(props, '$.k') IS NOT NULL AS valid FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured output with its validity: what doesn't parse is null and not valid."""
    parsed = F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})
    return A.table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), parsed["k"].isNotNull().alias("valid"))


@query("SELECT conv_id, turn, role, sha256(text) AS text_sha256, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS place FROM conversations QUALIFY place <= 3")
def recommendations_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three entries of each thread."""
    rows = history.ranked(A.table(spark, sf_dir, "conversations"), "conv_id", F.col("turn").desc(), F.col("role"), name="place").where("place <= 3")
    return rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"), "place")


@query()
def briefing_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A briefing for each scored company, with costs where the provider is known."""
    latest = history.axis_rows(history.latest(A.runs(spark, sf_dir)))
    key = F.col("company_id")
    users = A.companies(spark, sf_dir).select(key, A.pick(tuple(V.BASE_TOKENS), key % 7).alias("category"), F.when(key % 6 != 5, A.pick(tuple(V.API_PRICES), key % 6 % 5)).alias("provider"), "headcount")
    return routing.briefing(latest, cost.estimates(users))


_HOURS = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def _events_stream(spark, sf_dir):
    return E.stream(spark, sf_dir, "events.parquet")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_history_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A late subscriber's view: every event of the history once."""
    return E.drain(_events_stream(spark, sf_dir).select("event_id", "user_id", "event_type")).drop("batch")


@query(_RUN_STATE)
def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that a stream ends with equal those of the batch."""
    return E.newest_batch(E.drain(E.latest_state(_events_stream(spark, sf_dir)), "update"), "run").select("run", "state", "last_event", "n")


@query(_HOURS)
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per hour and type from a stream in update mode, as it last gave them."""
    rows = E.drain(E.hourly(_events_stream(spark, sf_dir)), "update")
    last = rows.groupBy("hour", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return last.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "x.n", F.round("x.total", 4).alias("total"))


@query(
    f"WITH b AS (SELECT user_id AS company_id, event_id AS id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, value AS after FROM events) SELECT company_id, id, before, after, CASE WHEN after - before > {V.SCORE_NOISE} THEN 'melhorou' WHEN after - before < -{V.SCORE_NOISE} THEN 'piorou' ELSE 'estavel' END AS kind FROM b WHERE before IS NOT NULL"
)
def stream_score_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's value against the user's one before, from keyed state."""
    scores = _events_stream(spark, sf_dir).select(F.col("user_id").alias("company_id"), "ts", F.col("event_id").alias("id"), F.col("value").alias("score"))
    return E.drain(E.changes(scores)).select("company_id", "id", "before", "after", "kind")
