"""Sources: registries, cards, caches, indexes, and providers of pages, vectors and answers."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope import fixed_values as V
from ledgerscope.sources.shared import mounted

#: Sections of a registry that hold no sources.
SKIPPED_SECTIONS = ("version", "cards_manuais")
CARD_URL = "https://cards.local/"
#: Where ``writers.write_markdown`` lists its files, and what a folder is called whose company has no name.
WRITTEN, NAMELESS = "_written", "__HIVE_DEFAULT_PARTITION__"
#: Bytes of files that a task hands on at a time.
_READ_BYTES = 2 << 20


def registry(spark: SparkSession, path: str) -> DataFrame:
    """``section, url, title, category, technology`` of a YAML registry: sections of flat entries; entries without a URL are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    named = lines.select("n", "line", F.nullif(F.regexp_extract("line", r"^([A-Za-z_][\w-]*):\s*$", 1), F.lit("")).alias("head"), F.regexp_extract("line", r"^\s*-\s", 0).alias("dash"), F.regexp_extract("line", r"^\s*(?:-\s+)?([a-z_]+):\s*[\"']?(.*?)[\"']?\s*$", 1).alias("key"), F.regexp_extract("line", r"^\s*(?:-\s+)?([a-z_]+):\s*[\"']?(.*?)[\"']?\s*$", 2).alias("value"))
    order = Window.orderBy("n")  # one file of settings
    placed = named.withColumn("section", F.last("head", ignorenulls=True).over(order)).withColumn("entry", F.sum((F.col("dash") != "").cast("int")).over(order))
    fields = placed.where(F.col("section").isNotNull() & ~F.col("section").isin(*SKIPPED_SECTIONS) & F.col("head").isNull() & (F.col("value") != ""))
    of = lambda name: F.max(F.when(F.col("key") == name, F.col("value"))).alias(name)
    return fields.groupBy("section", "entry").agg(of("url"), of("title"), of("category"), of("technology")).where(F.col("url").isNotNull()).drop("entry")


def front_matter(text: Column) -> tuple[Column, Column]:
    """Head and body of a document that opens with ``---``; without a closed head everything is body."""
    closed = text.rlike(r"(?s)^---\r?\n.*?\r?\n---\r?(\n|$)")
    head = F.when(closed, F.regexp_extract(text, r"(?s)^---\r?\n(.*?)\r?\n---\r?(?:\n|$)", 1))
    body = F.when(closed, F.regexp_replace(text, r"(?s)^---\r?\n.*?\r?\n---\r?(\n|$)", "")).otherwise(text)
    return head, F.trim(F.regexp_replace(body, r"^\s+|\s+$", ""))


def cards(spark: SparkSession, folder: str) -> DataFrame:
    """``slug, url, title, technology, category, body`` of the Markdown cards in a folder; README, ``_*`` and empty ones are skipped."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("slug"), "value")
    head, body = front_matter(F.col("value"))
    rows = files.where(~F.col("slug").rlike("^(_.*|(?i)readme)$")).select("slug", head.alias("head"), body.alias("body")).where(F.col("body") != "")
    of = lambda name: F.nullif(F.regexp_extract(F.coalesce("head", F.lit("")), rf"(?m)^{name}:\s*[\"']?(.*?)[\"']?\s*$", 1), F.lit(""))
    heading = F.nullif(F.regexp_extract("body", r"(?m)^#\s+(.+?)\s*$", 1), F.lit(""))
    return rows.select("slug", F.coalesce(of("url"), F.concat(F.lit(CARD_URL), "slug")).alias("url"), F.coalesce(of("title"), heading, F.col("slug")).alias("title"), of("technology").alias("technology"), of("category").alias("category"), "body").orderBy("slug")


def latest_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """``name, version, text`` of the newest version of each prompt (``name.vN.md``)."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    parts = files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.v(\d+)\.md$", 1).alias("name"), F.regexp_extract(F.input_file_name(), r"\.v(\d+)\.md$", 1).alias("v"), F.col("value").alias("text")).where("v <> ''")
    rows = parts.withColumn("version", F.col("v").cast("int"))
    return rows.groupBy("name").agg(F.max("version").alias("version"), F.max_by("text", "version").alias("text"))


def render(template: str, values: dict[str, str]) -> str:
    """A prompt with ``{{name}}`` replaced; a name without value or a value without name is an error."""
    names = set(re.findall(r"\{\{\s*(\w+)\s*\}\}", template))
    if names != set(values):
        raise ValueError(f"placeholders {sorted(names)} against values {sorted(values)}")
    return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: values[m[1]], template)


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """``slug, value`` of each text that ``writers.write_markdown`` put into a folder; files are found and opened by tasks."""
    root = mounted(spark, folder)
    if root is None:
        return spark.read.schema("value string, slug string").text(folder, wholetext=True).select("slug", "value")

    def rows(slugs, texts):
        return pa.RecordBatch.from_arrays([pa.array(slugs, pa.string()), pa.array(texts, pa.binary())], names=["slug", "value"])

    def get(batches):
        for batch in batches:
            slugs, texts, size = [], [], 0
            for name in batch.column(0).to_pylist():
                with open(f"{root}/{name}", "rb") as file:
                    texts.append(file.read())
                slug = name[len("slug=") : name.index("/")]
                slugs.append(None if slug == NAMELESS else slug)
                size += len(texts[-1])
                if size > _READ_BYTES:
                    yield rows(slugs, texts)
                    slugs, texts, size = [], [], 0
            yield rows(slugs, texts)

    files = spark.read.schema("file string").parquet(f"{folder}/{WRITTEN}")
    return files.mapInArrow(get, "slug string, value binary").select("slug", F.col("value").cast("string").alias("value"))


def read_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A saved index, or an empty one where nothing was saved."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def cache_key(*parts: Column) -> Column:
    """Key of a cached answer: the hash of what was asked."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def cache_get(requests: DataFrame, cache: DataFrame, now: Column, ttl_seconds: float = V.CACHE_DAYS * 86400) -> tuple[DataFrame, DataFrame]:
    """Requests (key, ...) with a fresh cached ``value``, and those without; a negative time to live never ends; null values are misses."""
    age = (F.unix_micros(now) - F.unix_micros("stored_at")) / 1e6
    fresh = cache.where(F.col("value").isNotNull() & ((F.lit(ttl_seconds) < 0) | (age <= ttl_seconds)))
    newest = fresh.groupBy("key").agg(F.max_by("value", "stored_at").alias("value"))
    return requests.join(newest, "key"), requests.join(newest.select("key"), "key", "left_anti")


def provided(rows: DataFrame, of: Callable[[list], list], source: str, name: str, kind: str, batch: int = 32) -> DataFrame:
    """``rows`` with a column that a provider makes of ``source``, ``batch`` values a call; another number of answers is an error."""
    columns = rows.columns
    at = columns.index(source)
    pa_kind = {"string": pa.string(), "double": pa.float64(), "array<float>": pa.list_(pa.float32())}[kind]

    def mapper(batches):
        for b in batches:
            asked, got = b.column(at).to_pylist(), []
            for i in range(0, len(asked), batch):
                part = of(asked[i : i + batch])
                if len(part) != len(asked[i : i + batch]):
                    raise ValueError(f"{len(part)} answers to {len(asked[i : i + batch])} requests")
                got += part
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa_kind)], names=[*columns, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(mapper, f"{schema}, `{name}` {kind}")


def json_object(text: Column) -> Column:
    """The first balanced JSON object of an answer, without thoughts and fences; null where none is closed.

    The text is cut at quotes, backslashes and braces, and one fold over the
    pieces counts what is open and knows where it began.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<think>.*?</think>", "")
    fence = r"(?s)```(?:json)?\s*(.*?)\s*```"
    told = F.when(bare.rlike(fence), F.regexp_extract(bare, fence, 1)).otherwise(bare)
    kind = "struct<at:int,depth:int,quoted:boolean,escaped:boolean,begin:int,end:int>"

    def step(s: Column, piece: Column) -> Column:
        sign = lambda c: piece == F.lit(c)
        inside, after = s["depth"] > 0, s["at"] + F.length(piece)
        live = s["end"] == 0
        free = inside & ~s["quoted"]
        opens, closes = live & sign("{") & (free | ~inside), live & free & sign("}")
        depth = s["depth"] + F.when(opens, 1).otherwise(0) - F.when(closes, 1).otherwise(0)
        quoted = F.when(live & inside & sign('"') & ~s["escaped"], ~s["quoted"]).otherwise(s["quoted"])
        escaped = s["quoted"] & sign("\\") & ~s["escaped"]
        begin = F.when(opens & (s["depth"] == 0), after).otherwise(s["begin"])
        end = F.when(closes & (depth == 0), after).otherwise(s["end"])
        return F.struct(after.alias("at"), depth.alias("depth"), quoted.alias("quoted"), escaped.alias("escaped"), begin.alias("begin"), end.alias("end")).cast(kind)

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("begin"), F.lit(0).alias("end")).cast(kind)
    pieces = lambda t: F.regexp_extract_all(t, F.lit(r'(?s)[^"\\{}]+|["\\{}]'), 0)
    found = F.transform(F.array(told), lambda t: F.struct(t.alias("t"), F.aggregate(pieces(t), start, step).alias("s")))[0]
    return F.when(found["s"]["end"] > 0, F.substr(found["t"], found["s"]["begin"], found["s"]["end"] - found["s"]["begin"] + 1))


def robots_allows(pages: DataFrame, rules: DataFrame, agent: str = "*", order: str = "longest") -> DataFrame:
    """``pages`` (host, path, other columns; every row stays) with ``allowed``.

    Of a host's rules (host, agent, prefix, allow) those count whose agent is in
    the robot's name, or else those for ``*``.  Of the rules that a path begins
    with, the longest decides and allows on ties, or with ``order="first"`` the
    one of the smallest ``position``, as readers of robots files do that stop at
    the first match.  Empty rules are none; without a rule all is allowed.

    A path meets rules by equality: it is cut to the lengths that its host's
    rules have, so a host of ten thousand rules costs each of its pages some
    dozens of lookups and no comparison with every rule.
    """
    name = agent.lower()
    own = rules.where(F.length("prefix") > 0).withColumn("__named", (F.col("agent") != "*") & F.contains(F.lit(name), F.lower("agent")))
    groups = rules.groupBy("host").agg(F.bool_or((F.col("agent") != "*") & F.contains(F.lit(name), F.lower("agent"))).alias("__specific"))
    own = own.join(groups, "host").where(F.when(F.col("__specific"), F.col("__named")).otherwise(F.col("agent") == "*"))
    lengths = own.groupBy("host").agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("__lengths"))
    asked = pages.select("host", "path").distinct()
    cuts = asked.join(lengths, "host").select("host", "path", F.explode(F.filter("__lengths", lambda n: n <= F.length("path"))).alias("__n")).withColumn("prefix", F.expr("left(path, __n)"))
    place = F.struct(-F.col("position"), F.lit(0)) if order == "first" else F.struct(F.length("prefix"), F.col("allow").cast("int"))
    told = cuts.join(own, ["host", "prefix"]).groupBy("host", "path").agg(F.max_by("allow", place).alias("allowed"))
    back = pages.join(told.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("allowed").alias("__a")), (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left")
    return back.select(*[c for c in pages.columns if c != "allowed"], F.coalesce("__a", F.lit(True)).alias("allowed"))
