"""Queries of the read models: details of companies, evidence behind references, contexts, orders of work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope import fixed_values as V
from ledgerscope.functions import text as T
from ledgerscope.functions import urls as U
from ledgerscope.operators import history
from ledgerscope.operators import read_models as R
from ledgerscope.plans import adapters as A
from ledgerscope.plans.knowledge import _ANSWERS, _CITED, _answers, _docs
from ledgerscope.plans.pages import _NETLOC, _PATH
from ledgerscope.plans.registry import query
from ledgerscope.plans.scoring import RUNS
from ledgerscope.sources import readers

#: References of a run to documents as its evidence; some lead nowhere.
_REFS = "[(o_orderkey * 7 + o_custkey) % 5000, (o_orderkey * 13) % 5000, o_custkey % 5000]"


def _refs(spark, sf_dir) -> DataFrame:
    run, company = F.col("run_id"), F.col("company_id")
    return A.runs(spark, sf_dir).select("company_id", "run_id", "created_at", F.array((run * 7 + company) % 5000, run * 13 % 5000, company % 5000).alias("refs"))


def _evidence(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("ref"), "source")


@query(
    f"WITH r AS (SELECT o_orderkey AS run_id, unnest({_REFS}) AS ref, unnest([0, 1, 2]) AS position FROM orders), m AS (SELECT run_id, position, ref, source FROM r JOIN documents ON ref = doc_id) SELECT run_id, string_agg(CAST(ref AS VARCHAR), ',' ORDER BY position) AS refs, string_agg(source, ',' ORDER BY position) AS sources FROM m GROUP BY run_id"
)
def evidence_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence behind each run's references, in their order; orphans are left out."""
    found = R.resolved(_refs(spark, sf_dir), "refs", _evidence(spark, sf_dir), "ref", "run_id")
    return found.select("run_id", F.array_join(R.referenced(F.col("found"), "ref").cast("array<string>"), ",").alias("refs"), F.array_join(F.transform("found", lambda e: e["source"]), ",").alias("sources"))


@query(f"WITH r AS (SELECT o_custkey AS company_id, unnest({_REFS}) AS ref FROM orders) SELECT company_id, count(*) AS n, count(DISTINCT ref) AS n_different FROM r JOIN documents ON ref = doc_id GROUP BY company_id")
def evidence_per_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _refs(spark, sf_dir).select("company_id", F.explode("refs").alias("ref")).join(_evidence(spark, sf_dir), "ref")
    return each.groupBy("company_id").agg(F.count("*").alias("n"), F.count_distinct("ref").alias("n_different"))


@query(
    f"""WITH {RUNS}, best AS (SELECT company_id, run_id, axis, score FROM axes QUALIFY row_number() OVER (PARTITION BY company_id, run_id ORDER BY w DESC, position) = 1),
r AS (SELECT o_orderkey AS run_id, unnest({_REFS}) AS ref FROM orders), e AS (SELECT run_id, count(*) AS n_evidence FROM r JOIN documents ON ref = doc_id GROUP BY run_id),
c AS (SELECT company_id, count(*) AS n_runs, min(created_at) AS first_run FROM totals GROUP BY company_id)
SELECT o.company_id, c_name AS name, n_name AS country, o.run_id, o.created_at, total10 / 10.0::DOUBLE AS total, risk10 / 10.0::DOUBLE AS risk, conf1000 / 1000.0::DOUBLE AS confidence, axis AS first_axis, score AS first_score, n_runs, first_run, coalesce(n_evidence, 0) AS n_evidence
FROM ordered o JOIN c USING (company_id) JOIN best USING (company_id, run_id) JOIN customer ON c_custkey = o.company_id LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN e USING (run_id) WHERE rank = 1"""
)
def company_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a company's page shows: profile, latest totals, heaviest axis, length of its history, evidence found."""
    latest = history.latest(A.runs(spark, sf_dir))
    totals = history.totals(latest).select("company_id", "run_id", "created_at", *(F.col(c).cast("double").alias(c) for c in ("total", "risk", "confidence")))
    axes = R.ordered_by(history.axis_rows(latest), R.axis_order(F.col("axis")), within=["company_id"]).where("place = 1").select("company_id", F.col("axis").alias("first_axis"), F.col("score").alias("first_score"))
    past = A.runs(spark, sf_dir).groupBy("company_id").agg(F.count("*").alias("n_runs"), F.min("created_at").alias("first_run"))
    refs = _refs(spark, sf_dir).join(latest.select("run_id"), "run_id", "left_semi")
    found = R.resolved(refs, "refs", _evidence(spark, sf_dir), "ref", "run_id").select("run_id", F.size("found").cast("long").alias("n_evidence"))
    profile = A.companies(spark, sf_dir).select("company_id", "name", "country")
    whole = profile.join(totals, "company_id").join(axes, "company_id").join(past, "company_id").join(found, "run_id", "left")
    return whole.select("company_id", "name", "country", "run_id", "created_at", "total", "risk", "confidence", "first_axis", "first_score", "n_runs", "first_run", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


@query(f"WITH {RUNS}, w AS (SELECT run_id, axis, w * 1000 + 10 - position AS weight FROM axes) SELECT run_id, axis, row_number() OVER (PARTITION BY run_id ORDER BY weight DESC) AS place FROM w")
def axes_by_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.axis_rows(A.runs(spark, sf_dir)).select("run_id", "axis")
    return R.ordered_by(rows, R.axis_order(F.col("axis")), within=["run_id"])


@query(f"WITH {_ANSWERS}, c AS (SELECT conv_id, turn, list_filter({_CITED}, lambda x, i: list_position({_CITED}, x) = i) AS cited FROM answers) SELECT conv_id, turn, unnest(cited) AS item, unnest(range(len(cited))) AS position FROM c")
def citation_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and what they cite as rows, in order."""
    rows = R.citation_rows(_answers(spark, sf_dir), T.citations(F.col("answer")), ["conv_id", "turn"])
    return rows.select("conv_id", "turn", "item", F.col("position").cast("long").alias("position"))


@query(f"WITH {_ANSWERS}, c AS (SELECT conv_id, list_distinct({_CITED}) AS cited FROM answers) SELECT conv_id, CAST(sum(len(cited)) AS BIGINT) AS n_citations FROM c GROUP BY conv_id")
def citation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.citation_rows(_answers(spark, sf_dir), T.citations(F.col("answer")), ["conv_id", "turn"]).groupBy("conv_id").agg(F.count("*").alias("n_citations"))
    each = _answers(spark, sf_dir).select("conv_id").distinct()
    return each.join(rows, "conv_id", "left").select("conv_id", F.coalesce("n_citations", F.lit(0)).alias("n_citations"))


@query(f"SELECT user_id, count(*) FILTER (WHERE event_type <> 'view') AS used, greatest(0, {V.CALL_BUDGET} - count(*) FILTER (WHERE event_type <> 'view')) AS remaining, count(*) FILTER (WHERE event_type = 'view') AS hits FROM events GROUP BY user_id")
def budget_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls made, calls left and answers from the cache of each run."""
    used = F.count_if(F.col("event_type") != "view")
    return A.table(spark, sf_dir, "events").groupBy("user_id").agg(used.alias("used"), F.greatest(F.lit(0), V.CALL_BUDGET - used).alias("remaining"), F.count_if(F.col("event_type") == "view").alias("hits"))


@query("SELECT user_id AS run, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS place FROM events WHERE event_type = 'purchase'")
def batch_by_urgency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch's finished entries by falling urgency; ties keep their order."""
    rows = A.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("run"), "event_id", "value")
    return R.ordered_by(rows, F.col("value").desc_nulls_last(), F.col("event_id"), within=["run"]).drop("value")


@query("SELECT l_orderkey AS plan, l_linenumber AS position, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3, l_linenumber) AS place FROM lineitem")
def planned_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned searches by rising priority number; ties keep their order."""
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("position"))
    return R.ordered_by(rows, F.col("position") % 3, F.col("position"), within=["plan"])


@query("WITH r AS (SELECT user_id AS run, user_id % 3 AS owner, max(ts) AS ended FROM events GROUP BY user_id) SELECT run, owner, row_number() OVER (PARTITION BY owner ORDER BY ended DESC, run) AS place FROM r")
def runs_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = A.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(F.max("ts").alias("ended"))
    return R.ordered_by(runs.withColumn("owner", F.col("run") % 3), F.col("ended").desc(), F.col("run"), within=["owner"]).select("run", "owner", "place")


@query(
    """WITH h AS (SELECT page_id, url, regexp_extract_all(coalesce(html, ''), '(?i)href=["'']([^"'']+)["'']', 1) AS l FROM pages)
SELECT page_id, array_to_string(list_filter(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: x NOT IN ('/', '#', coalesce(url, '')))[1:5], ' ') AS links FROM h"""
)
def links_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five different links of a page that aren't its start or itself."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("(?i)href=[\"']([^\"']+)[\"']"), 1)
    seen = F.array(F.lit("/"), F.lit("#"), F.coalesce("url", F.lit("")))
    return A.table(spark, sf_dir, "pages").select("page_id", F.array_join(R.followed_links(links, seen), " ").alias("links"))


@query(
    "WITH b AS (SELECT 'documents' AS branch, doc_id AS item, source AS kind FROM documents UNION ALL SELECT 'pages', page_id, CAST(NULL AS VARCHAR) FROM pages UNION ALL SELECT 'events', event_id, event_type FROM events) SELECT branch, kind, count(*) AS n, count(DISTINCT item) AS n_items FROM b GROUP BY ALL"
)
def fan_out_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three branches gave, as one table."""
    of = lambda name, key, kind: A.table(spark, sf_dir, name).select(F.col(key).alias("item"), kind.alias("kind"))
    rows = R.unions(documents=of("documents", "doc_id", F.col("source")), pages=of("pages", "page_id", F.lit(None).cast("string")), events=of("events", "event_id", F.col("event_type")))
    return rows.groupBy("branch", "kind").agg(F.count("*").alias("n"), F.count_distinct("item").alias("n_items"))


@query(
    "WITH p AS (SELECT doc_id // 5 AS request_id, source, text, row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id) AS n FROM documents) SELECT request_id, sha256(string_agg('[' || n || '] ' || coalesce(source, '') || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY n) || chr(10) || chr(10) || 'q' || request_id) AS prompt_sha256, count(*) AS n FROM p GROUP BY request_id"
)
def grounded_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request's chunks as a numbered context with its question."""
    chunks = _docs(spark, sf_dir).withColumn("request_id", F.floor(F.col("doc_id") / 5))
    found = R.numbered_context(chunks, "request_id", "doc_id", F.col("source"), F.col("text"))
    asked = R.grounded(F.col("context"), F.col("n"), F.concat(F.lit("q"), F.col("request_id").cast("string")))
    return found.select("request_id", F.sha2(asked, 256).alias("prompt_sha256"), "n")


@query(
    "WITH p AS (SELECT lang, source, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents QUALIFY n <= 12) SELECT lang, sha256(string_agg('[' || n || '] ' || coalesce(source, '') || chr(10) || coalesce(left(text, 12000), ''), chr(10) || chr(10) ORDER BY n)) AS context_sha256, count(*) AS n FROM p GROUP BY lang"
)
def prompt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt's documents: the first twelve of each language, 12,000 letters of each (the prompt's own limits)."""
    found = R.numbered_context(_docs(spark, sf_dir), "lang", "doc_id", F.col("source"), F.col("text"), most=12, chars=12_000)
    return found.select("lang", F.sha2("context", 256).alias("context_sha256"), "n")


@query(
    "SELECT c_custkey AS company_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 4 <> 1 THEN c_mktsegment END AS sector, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 3 <> 1 THEN n_name END AS country FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"
)
def annulled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles without the fields that an audit found unsupported."""
    key = F.col("company_id")
    unsupported = F.array_compact(F.array(F.when(key % 3 == 0, "name"), F.when(key % 4 == 1, "sector"), F.when((key % 3 == 1) & (key % 5 != 0), "country")))
    return R.annulled(A.companies(spark, sf_dir).select("company_id", "name", "sector", "country"), unsupported, ["name", "sector", "country"])


@query("SELECT c_custkey AS company_id, c_custkey IN (SELECT o_custkey FROM orders) AS refresh FROM customer")
def refresh_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with a history have their signal pages fetched anew."""
    return R.refresh(A.companies(spark, sf_dir).select("company_id"), A.runs(spark, sf_dir))


_DATES = "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT10:30:00Z') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT10:30:00-03:00') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d 10:30') ELSE strftime(o_orderdate, '%d/%m/%Y') END"


@query(f"WITH d AS (SELECT o_orderkey AS run_id, o_orderkey % 5 AS k, {_DATES} AS written, CAST(o_orderdate AS TIMESTAMP) AS day FROM orders) SELECT run_id, written, CASE k WHEN 0 THEN day WHEN 1 THEN day + INTERVAL 630 MINUTE WHEN 2 THEN day + INTERVAL 810 MINUTE WHEN 3 THEN day + INTERVAL 630 MINUTE END AS read FROM d")
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as pages write them, read as UTC; what is no ISO date is null."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    of = lambda pattern: F.date_format(day, pattern)
    written = F.when(k == 0, of("yyyy-MM-dd")).when(k == 1, F.concat(of("yyyy-MM-dd"), F.lit("T10:30:00Z"))).when(k == 2, F.concat(of("yyyy-MM-dd"), F.lit("T10:30:00-03:00"))).when(k == 3, F.concat(of("yyyy-MM-dd"), F.lit(" 10:30"))).otherwise(of("dd/MM/yyyy"))
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), written.alias("written"))
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), R.iso_time(F.col("written")).cast("timestamp_ntz"))
    return rows.select("run_id", "written", utc.alias("read"))


@query("SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || '/robots.txt' AS robots FROM pages")
def robots_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", R.robots_url(F.col("url")).alias("robots"))




@query("SELECT doc_id, sha256(concat_ws('|', 'model', lang, text)) AS cache_key FROM documents")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys under which answers about documents are cached."""
    return _docs(spark, sf_dir).select("doc_id", readers.cache_key(F.lit("model"), F.col("lang"), F.col("text")).alias("cache_key"))


@query(
    f"""WITH p AS (SELECT DISTINCT {_NETLOC.format('url')} AS host, {_PATH.format('url')} AS path FROM pages), h AS (SELECT host, min(path) AS least, max(path) AS most FROM p GROUP BY host),
rules AS (SELECT host, left(most, 4) AS prefix, false AS allow FROM h UNION ALL SELECT host, least, true FROM h UNION ALL SELECT host, '', false FROM h),
hit AS (SELECT p.host, p.path, allow, length(prefix) AS n FROM p JOIN rules r ON p.host = r.host AND starts_with(path, prefix) AND prefix <> ''),
best AS (SELECT host, path, allow FROM hit QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY n DESC, allow DESC) = 1)
SELECT host, path, coalesce(allow, true) AS allowed FROM p LEFT JOIN best USING (host, path)"""
)
def robots_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that their host's rules let a robot read: the longest rule decides, and allows on ties."""
    pages = A.table(spark, sf_dir, "pages").select(U.netloc(F.col("url")).alias("host"), U.path_of(F.col("url")).alias("path")).distinct()
    ends = pages.groupBy("host").agg(F.min("path").alias("least"), F.max("path").alias("most"))
    rule = lambda prefix, allow: ends.select("host", F.lit("*").alias("agent"), prefix.alias("prefix"), F.lit(allow).alias("allow"))
    rules = rule(F.substring("most", 1, 4), False).union(rule(F.col("least"), True)).union(rule(F.lit(""), False))
    return readers.robots_allows(pages, rules)


@query(
    "WITH e AS (SELECT event_id, json_valid(props) AS good, CAST(json_extract(CASE WHEN json_valid(props) THEN props ELSE '{}' END, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, array_to_string(list_filter([CASE WHEN NOT good THEN 'no object' END, CASE WHEN k IS NULL THEN 'k: missing' END, CASE WHEN k > 50 THEN 'k: above 50' END, CASE WHEN k % 2 = 1 THEN 'k: odd' END], lambda x: x IS NOT NULL), '; ') AS errors FROM e"
)
def output_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each structured answer, fifteen errors at most."""
    k = F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})["k"]
    checks = {"no object": ~F.coalesce(F.col("props").rlike(r"^\s*\{.*\}\s*$"), F.lit(False)), "k: missing": F.col("k").isNull(), "k: above 50": F.col("k") > 50, "k: odd": F.col("k") % 2 == 1}
    rows = A.table(spark, sf_dir, "events").select("event_id", "props", k.alias("k"))
    return rows.select("event_id", F.array_join(R.errors(checks), "; ").alias("errors"))
