"""How far the sources of each language stand apart, by the terms they use.

Terms are runs of letters and other non-ASCII signs; a language keeps those of
at least ``MIN_DOCS`` of its documents.  Each (lang, source) group, and each
language, gives every kept term a smoothed share of a thousand million, and the
divergence of two groups is the sum over all kept terms of ``(p - q)^2 div q``.

Counts are columns over the vocabulary, one for each source, and mostly equal
for long stretches once the vocabulary is put in the right order.  So terms
with the same counts everywhere become one entry that stands for many terms,
entries are sorted by their counts, and a block of neighbours keeps, for each
source, runs of equal counts with their lengths (``columns``).  For a pair of
sources the two run boundaries are merged, ``f`` is taken once for each piece
and multiplied by the terms that it stands for; blocks' sums are then added.
A task has one block and at most ``TILE`` sources against the rest, so neither
a vocabulary nor a language with many sources has to fit one.

All arithmetic is whole-numbered: shares are divided digit by digit, which is
exact up to 9e14 terms in a group, and sums stay below 2^63.

Defined results: a null text, lang or source is the empty one; the empty
source and language are groups like any other; a group without terms gives
every kept term the same share; a language of one source has no pairs, one
without kept terms has pairs of value 0 and no terms; rows that repeat a
``doc_id`` are documents of their own; other columns take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, materialize, small_batches

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Entries of a block, counts in it, and sources that a task sets against the others.
ENTRIES, CELLS, TILE = 4096, 1 << 18, 64
#: Letters as they are, A-Z in lower case, all else of ASCII as spaces.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def _term_counts(batches):
    """Occurrences and documents of each term, by language and source, of a block of documents at a time."""
    for langs, sources, bodies in blocks(batches, 0, 1, 2):
        groups, group_of = {}, np.empty(len(bodies), np.int64)
        for i, pair in enumerate(zip(langs, sources, strict=True)):
            group_of[i] = groups.setdefault(pair, len(groups))
        words = [b.translate(FOLDED).split() for b in bodies]
        coded = pa.array([w for own in words for w in own], pa.large_binary()).dictionary_encode()
        if not len(coded):
            continue
        many = len(coded.dictionary)
        code = coded.indices.to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(bodies)), [len(w) for w in words])
        once, n = np.unique(owner * many + code, return_counts=True)
        keys, back = np.unique(group_of[once // many] * many + once % many, return_inverse=True)
        group, term = keys // many, keys % many
        names = list(groups)
        columns = [pa.array([names[g][k] for g in group.tolist()], pa.string()) for k in (0, 1)]
        terms = coded.dictionary.take(pa.array(term)).cast(pa.large_string()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([*columns, terms, pa.array(np.bincount(back, weights=n).astype(np.int64)), pa.array(np.bincount(back))], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: how often, and in how many documents, a group has a term."""
    told = small_batches(docs).select("lang", "source", F.col("text").cast("binary").alias("body"))
    return told.mapInArrow(_term_counts, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, of: str, kept: str) -> Column:
    """A group's smoothed share of a term that it has ``n`` times, of ``of`` occurrences and ``kept`` terms."""
    return F.expr(f"1 + cast({n} + 1 as decimal(19,0)) * {SCALE}BD div cast({of} + {kept} as decimal(19,0))")


def shares(n: np.ndarray, of: int, kept: int) -> np.ndarray:
    """The same for an array of counts: three digits at a time, so that no product leaves 64 bits."""
    rest, found = n.astype(np.int64) + 1, np.zeros(len(n), np.int64)
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // (of + kept)
        rest = rest % (of + kept)
    return found + 1


def runs(counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A column as (values, lengths) of its runs; entry ``i`` stands for ``weights[i]`` terms."""
    first = np.flatnonzero(np.r_[True, counts[1:] != counts[:-1]])
    return counts[first], np.add.reduceat(weights, first)


def divergence(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sums of f from ``a`` to ``b`` and back, of two columns (shares, run ends) over the same terms."""
    ends = np.union1d(a[1], b[1])
    p, q = a[0][np.searchsorted(a[1], ends)], b[0][np.searchsorted(b[1], ends)]
    square, length = (p - q) * (p - q), np.diff(ends, prepend=0)
    return int((square // q * length).sum()), int((square // p * length).sum())


def columns(entries: DataFrame, most: int = ENTRIES) -> DataFrame:
    """``lang, block, terms, runs``: entries (``lang, vec, m``) in order, in blocks, each source's counts as runs."""
    kind = "array<struct<source: string, counts: array<long>, lengths: array<long>>>"

    def told(lang, number, held):
        weights = np.array([m for _, m in held], np.int64)
        cells: dict[str, list[tuple[int, int]]] = {}
        for i, (vec, _) in enumerate(held):
            for cell in vec:
                cells.setdefault(cell["source"], []).append((i, cell["n"]))
        found = []
        for source, own in cells.items():
            counts = np.zeros(len(held), np.int64)
            counts[[i for i, _ in own]] = [n for _, n in own]
            values, lengths = runs(counts, weights)
            found.append({"source": source, "counts": values.tolist(), "lengths": lengths.tolist()})
        return {"lang": lang, "block": number, "terms": int(weights.sum()), "runs": found}

    def cut(batches):
        from pyspark import TaskContext

        number, lang, held, cells = TaskContext.get().partitionId() << 32, None, [], 0
        fields = pa.struct([("source", pa.string()), ("counts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
        schema = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("terms", pa.int64()), ("runs", pa.list_(fields))])
        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["lang"] != lang or len(held) >= most or cells >= CELLS):
                    yield pa.RecordBatch.from_pylist([told(lang, number, held)], schema)
                    number, held, cells = number + 1, [], 0
                lang = r["lang"]
                held.append((r["vec"], r["m"]))
                cells += len(r["vec"])
        if held:
            yield pa.RecordBatch.from_pylist([told(lang, number, held)], schema)

    ordered = entries.repartitionByRange("lang", "vec").sortWithinPartitions("lang", "vec")
    return ordered.mapInArrow(cut, f"lang string, block long, terms long, runs {kind}")


def _pairs(tile: int):
    """A mapper: sums over a block of all pairs of a tile's sources with the sources after them, both ways."""

    def sums(batches):
        for batch in batches:
            for r in batch.to_pylist():
                terms, own, everyone = r["terms"] or 0, {x["source"]: x for x in r["runs"] or []}, r["everyone"]
                made = []
                for g in everyone:
                    counts, lengths = (own[g["source"]]["counts"], own[g["source"]]["lengths"]) if g["source"] in own else ([0], [terms])
                    made.append((shares(np.array(counts, np.int64), g["of"], r["kept"]), np.cumsum(lengths)) if terms else None)
                first = r["tile"] * tile
                out = [[], [], []]
                for i in range(first, min(first + tile, len(made))):
                    for k in range(i + 1, len(made)):
                        there, back = divergence(made[i], made[k]) if terms else (0, 0)
                        for held, x in zip(out, ((everyone[i]["source"], everyone[k]["source"]), (everyone[k]["source"], everyone[i]["source"]), (there, back)), strict=True):
                            held.extend(x)
                yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(out[0]), pa.string()), pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["lang", "source", "item", "value"])

    return sums


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, entries: int = ENTRIES, tile: int = TILE) -> DataFrame:
    """``lang, source, part, item, value, rank``: divergence of each source from each other one (part ``pair``), and the terms that set it apart from its language (part ``term``, the first ``top``)."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = materialize(term_counts(named), "terms")
    by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vec"))
    kept = materialize(by_term.where(F.col("docs") >= min_docs).select("lang", "term", "all", "vec"), "kept")
    cells = kept.select("lang", "term", "all", F.explode("vec").alias("cell")).select("lang", "term", "all", "cell.*")
    size = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("of_lang"))
    used = cells.groupBy("lang", "source").agg(F.sum("n").alias("of"))
    groups = named.select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(size, "lang", "left").na.fill(0, ["of", "kept", "of_lang"])
    groups = materialize(groups, "groups")

    langs = groups.groupBy("lang").agg(F.first("kept").alias("kept"), F.sort_array(F.collect_list(F.struct("source", "of"))).alias("everyone"))
    alike = kept.groupBy("lang", "vec").agg(F.count("*").alias("m"))
    stretches = materialize(columns(alike, entries), "columns")
    tiles = langs.join(stretches, "lang", "left").withColumn("tile", F.explode(F.sequence(F.lit(0), F.expr(f"cast((size(everyone) - 1) div {tile} as int)"))))
    sums = tiles.repartition("lang", "block", "tile").mapInArrow(_pairs(tile), "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    p, q = F.col("p"), F.col("q")
    own = cells.join(groups, ["lang", "source"]).withColumn("p", share("n", "of", "kept")).withColumn("q", share("all", "of_lang", "kept"))
    apart = own.where(p > q).select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    told = lambda df, part: df.withColumn("rank", rank).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return told(pairs, "pair").unionByName(told(apart, "term").where(F.col("rank") <= top))


def audit_sql(min_docs: int = MIN_DOCS, top: int = TOP) -> str:
    """The same for DuckDB."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n_all FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {min_docs}),
size AS (SELECT lang, count(*) AS v, sum(n_all) AS n_lang FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
used AS (SELECT lang, source, sum(n) AS n_group FROM cells GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(u.n_group, 0) + s.v) AS p, 1 + (1000000000::HUGEINT * (k.n_all + 1)) // (s.n_lang + s.v) AS q
 FROM g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM dense WHERE n > 0 AND p > q),
both_parts AS (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' FROM term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
