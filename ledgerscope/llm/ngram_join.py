"""Jaccard self-join on sets of word n-grams by partitions of the universe of n-grams.

Two documents link when ``100 * |A & B| >= percent * |A | B|``.  The links'
components are what comes out, so equal sets are one class from the start and
pairs that are connected already need no test.

1.  Sizes are dealt into bands such that linked sets lie in one band or in
    neighbours.  For two neighbouring bands the number ``k`` of n-grams in
    which linked sets can differ is bounded, and the universe of n-grams is
    hashed into ``k + 1`` segments: by the pigeonhole principle linked sets
    agree in one segment at least.  Each segment of a set is a key.  A set's
    own size says in how many segments a link to it needs agreement; sets that
    don't share so many keys go.  Empty segments are keys only of sets that
    need them for that number.
2.  Segments are taken two by two.  Of ``k`` differences dealt over the pairs
    of segments, one pair has one difference at most, so linked sets agree in
    one of its segments and differ by at most one n-gram in the other.  What a
    segment's key costs is the number of sets that hold it: to each of them
    that many comparisons.  Where that is more than the keys of its partner
    cost, it is allocated its partner too: the key becomes the segment and the
    partner, or the partner less any one of its n-grams.  The allocation
    depends on the key alone, so both sides of a link allocate alike.
3.  The hub of a key is that of its sets which meets most sets over all keys,
    and a set's home is the hub of most of its keys.  Sets of one home are compared in blocks; then
    those of keys that hold sets of several homes which aren't connected yet.
    Every comparison is of whole sets, in pieces of bounded size.

Words are cut at ASCII white space after lower-casing A-Z; n-grams are 64-bit
hashes, and so are sets (a sum over their n-grams).  Defined results: a text
without words has an empty set and links with nothing; a text of fewer than
``n`` words is one n-gram; rows with a null ``doc_id`` are left out; repeated
rows give repeated result rows; rows that repeat a ``doc_id`` with different
texts are sets of their own; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_long, block_words, blocks, bucketed, materialize, mix, text_bytes, window_hashes

N = 4
PERCENT = 85
#: Comparisons that one key of a partner costs.
BALANCE = 2
#: N-grams and sets of a slot, and columns of the tables that two slots are compared in.
SLOT, SLOT_SETS, COLUMNS = 400_000, 1000, 4096


def _sets(bodies: list[bytes], n: int) -> list[np.ndarray]:
    words, starts = block_words([b.lower() for b in bodies])
    grams = window_hashes(words, n)
    found = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        size = int(b - a)
        found.append(np.unique(grams[a : b - n + 1]) if size >= n else window_hashes(words[a:b], size) if size else np.empty(0, U64))
    return found


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the sets in a row, and how many are each set's."""
    return np.concatenate([*sets, np.empty(0, U64)]), np.array([len(s) for s in sets], np.int64)


def _identities(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.r_[U64(0), np.cumsum(mix(flat, 11))][np.r_[0, np.cumsum(sizes)]]
    return mix(np.diff(total) + sizes.astype(U64), 12)


def band_edges(percent: int, most: int = 1 << 40) -> list[int]:
    """The smallest size of each band: sets that link lie in one band or in neighbours."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(edges[-1] * 100 // percent + 1)
    return edges


def differences(percent: int, most):
    """In how many n-grams linked sets of ``most`` n-grams at most can differ."""
    return 2 * most * (100 - percent) // (100 + percent)


def partner_keys(percent: int) -> int:
    """About how many keys a segment with its partner is: the partner, whole or less one of its n-grams."""
    return 1 + (100 + percent) // (2 * (100 - percent))


class Segments:
    """The segments of many sets in one of their double bands: ``lower`` is 1 for that of the band below, else 0."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, edges: np.ndarray, percent: int, lower: int):
        band = np.searchsorted(edges, sizes, side="right") - 1 - lower
        self.sets = np.flatnonzero((band >= 0) & (sizes > 0))
        keep = np.repeat((band >= 0) & (sizes > 0), sizes)
        band, sizes, self.tokens = band[self.sets], sizes[self.sets], flat[keep]
        self.parts = differences(percent, edges[band + 2] - 1) + 1
        self.first = np.cumsum(self.parts) - self.parts
        self.owner = np.repeat(np.arange(len(self.sets)), sizes)
        spread = mix(self.tokens + band.astype(U64)[self.owner] * U64(0x9E3779B97F4A7C15), 400) >> U64(32)
        self.segment = self.first[self.owner] + (spread % self.parts.astype(U64)[self.owner]).astype(np.int64)
        self.marks = mix(self.tokens, 401)
        total = int(self.parts.sum())
        self.sums = np.zeros(total, U64)
        np.add.at(self.sums, self.segment, self.marks)
        self.of = np.repeat(np.arange(len(self.sets)), self.parts)
        self.number = np.arange(total) - self.first[self.of]
        place = self.number.astype(U64) * U64(0x9E3779B97F4A7C15) + (band.astype(U64) << U64(32))[self.of]
        self.keys = mix(mix(self.sums, 402) + place, 403)
        largest = np.minimum(sizes * 100 // percent, edges[band + 2] - 1)
        need = self.parts - (100 - percent) * (sizes + largest) // (100 + percent)
        empty = np.bincount(self.segment, minlength=total) == 0
        without = need - np.bincount(self.of[empty], minlength=len(self.sets))
        self.kept = ~empty | (without < 1)[self.of]
        self.need = np.maximum(without, 1)


def _base(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, size, set_id``."""

    def mapper(batches):
        for ids, bodies in blocks(batches, 0, 1):
            flat, sizes = _flat(_sets(bodies, n))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(as_long(_identities(flat, sizes)))], names=["doc_id", "size", "set_id"])

    return docs.mapInArrow(mapper, "doc_id long, size long, set_id long")


def _keys(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``key, set_id, about``: the segments of each set; ``about`` is twice the agreement that a link needs, and 1 for the lower double band."""
    edges = np.array(band_edges(percent))

    def mapper(batches):
        sent: set[int] = set()
        for _, bodies in blocks(batches, 0, 1):
            flat, sizes = _flat(_sets(bodies, n))
            ids = as_long(_identities(flat, sizes))
            new = np.zeros(len(ids), bool)
            for i, x in enumerate(ids.tolist()):  # one of a task's equal sets is enough
                new[i] = x not in sent
                sent.add(x)
            flat, sizes, ids = flat[np.repeat(new, sizes)], sizes[new], ids[new]
            for lower in (0, 1):
                x = Segments(flat, sizes, edges, percent, lower)
                about = (2 * x.need + lower)[x.of]
                yield pa.RecordBatch.from_arrays([pa.array(as_long(x.keys[x.kept])), pa.array(ids[x.sets][x.of][x.kept]), pa.array(about[x.kept])], names=["key", "set_id", "about"])

    return docs.mapInArrow(mapper, "key long, set_id long, about long")


def _shared(keyed: DataFrame, whole: bool = False) -> DataFrame:
    """The distinct rows of keys that two sets or more hold; ``whole``: one of them at least with an ``about`` above 0."""

    def mapper(batches):
        last, told, open_key = None, False, False  # the row that the next batch goes on from, whether it was passed on, whether its key may pass
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            if not len(rows):
                continue
            if last is not None:
                rows = np.concatenate([last, rows])
            rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]]
            begins = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
            many = np.diff(np.r_[begins, len(rows)])
            may = rows[begins, 2] > 0 if whole else np.ones(len(begins), bool)  # the largest comes first
            if last is not None:
                may[0] = open_key
            good = may & (many > 1)
            if last is not None:
                good[0] |= told
            hit = np.repeat(good, many)
            again, open_key = bool(hit[-1]), bool(may[-1])
            if last is not None:
                hit[0] &= not told
            last, told = rows[-1:], again
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(rows[hit, i]) for i in range(3)], names=["key", "set_id", "about"])

    order = ["key", F.desc("about"), "set_id"] if whole else ["key", "set_id"]
    return keyed.repartition("key").sortWithinPartitions(*order).mapInArrow(mapper, "key long, set_id long, about long")


def _enough(shared: DataFrame) -> DataFrame:
    """Rows of the sets that share as many keys of a double band as a link there needs."""
    lower = F.col("about") % 2
    able = shared.groupBy("set_id", lower.alias("lower")).agg(F.count("*").alias("have"), F.max(F.floor(F.col("about") / 2)).alias("want")).where("have >= want").select("set_id", "lower")
    return shared.withColumn("lower", lower).join(able, ["set_id", "lower"], "left_semi").select("key", "set_id", "lower")


def _whole(docs: DataFrame, base: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``set_id, size, tokens`` of the sets in ``wanted``, bucketed by set: joins on it move the other side alone."""
    one = base.join(wanted.select("set_id").distinct(), "set_id", "left_semi").groupBy("set_id").agg(F.min("doc_id").alias("__of"))
    texts = docs.join(one, docs["doc_id"] == one["__of"]).select("set_id", "body")

    def mapper(batches):
        for ids, bodies in blocks(batches, 0, 1):
            sets = _sets(bodies, n)
            flat, sizes = _flat(sets)
            same = as_long(_identities(flat, sizes)) == np.array(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[same]), pa.array(sizes[same]), pa.array([as_long(s) for s, x in zip(sets, same, strict=True) if x], pa.list_(pa.int64()))], names=["set_id", "size", "tokens"])

    def first(batches):
        last = None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            new = np.r_[len(ids) > 0 and ids[0] != last, ids[1:] != ids[:-1]][: len(ids)]
            last = ids[-1] if len(ids) else last
            yield batch.filter(pa.array(new))

    kind = "set_id long, size long, tokens array<long>"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.mapInArrow(mapper, kind).repartition(parts, "set_id").sortWithinPartitions("set_id").mapInArrow(first, kind)
    return bucketed(dealt, "set_id", parts)


def _partners(costly: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For ``costly`` (key, set_id, lower): keys of the segment with its partner (``about`` 1), or with its partner less one n-gram (0)."""
    edges = np.array(band_edges(percent))
    per_set = costly.groupBy("set_id").agg(F.collect_list(F.struct("key", "lower")).alias("keys"))  # as many as a set has segments

    def mapper(batches):
        for batch in batches:
            for set_id, wanted, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                tokens = listed.values.to_numpy().view(U64)
                full, less = [np.empty(0, U64)], [np.empty(0, U64)]
                for lower in {w["lower"] for w in wanted}:
                    own = np.array([w["key"] for w in wanted if w["lower"] == lower], np.int64).view(U64)
                    x = Segments(tokens, np.array([len(tokens)]), edges, percent, lower)
                    for i in np.flatnonzero(np.isin(x.keys, own)):
                        j = i ^ 1
                        finer = lambda sums, i=i: mix(mix(sums, 404) + x.keys[i], 405)  # noqa: B023, E731
                        if j < len(x.keys):
                            full.append(finer(x.sums[j : j + 1]))
                            less.append(finer(x.sums[j] - x.marks[x.segment == j]))
                        else:  # the last of an odd number stands alone: it tolerates no difference
                            full.append(finer(x.keys[i : i + 1]))
                full, less = np.unique(np.concatenate(full)), np.unique(np.concatenate(less))
                keys = np.r_[full, less]
                yield pa.RecordBatch.from_arrays([pa.array(as_long(keys)), pa.array(np.full(len(keys), set_id, np.int64)), pa.array(np.r_[np.ones(len(full), np.int64), np.zeros(len(less), np.int64)])], names=["key", "set_id", "about"])

    return per_set.join(sets.select("set_id", "tokens"), "set_id").select("set_id", "keys", "tokens").mapInArrow(mapper, "key long, set_id long, about long")


def _allocated(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``key, set_id``: keys of segments, or of segments and partners where the former cost more."""
    held = rows.join(rows.groupBy("key").agg(F.count("*").alias("n")), "key")
    dear = F.col("n") > BALANCE * partner_keys(percent)
    # sets whose partners are within one n-gram of each other agree in a key that is the whole partner of one
    finer = _shared(_partners(held.where(dear).select("key", "set_id", "lower"), sets, percent), whole=True)
    return materialize(held.where(~dear).select("key", "set_id").union(finer.select("key", "set_id")), "allocated")


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id) of the ids in ``edges`` (a, b).

    Each round every node takes its smallest neighbour's smallest neighbour as
    its name, edges take their ends' names, and those within one name go, so
    that each round works on a smaller graph than the one before.
    """
    left = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    names = None
    while True:
        both = left.union(left.select("b", "a"))
        near = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("name"))
        hop = near.select(F.col("id").alias("name"), F.col("name").alias("beyond"))
        near = materialize(near.join(hop, "name").select("id", F.col("beyond").alias("name")), "names")
        if names is None:
            names = near
        else:
            after = near.select(F.col("id").alias("name"), F.col("name").alias("beyond"))
            names = materialize(names.join(after, "name", "left").select("id", F.coalesce("beyond", "name").alias("name")), "names")
        of = lambda end: near.select(F.col("id").alias(end), F.col("name").alias(f"n{end}"))
        renamed = left.join(of("a"), "a").select("na", "b").distinct().join(of("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
        left = materialize(renamed.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if not left.head(1):
            return names.withColumnRenamed("name", "component")


def _homes(rows: DataFrame) -> DataFrame:
    """``set_id, home``: the hub of a key is the set that meets most sets over all keys; a set's home is the hub of most of its keys."""
    held = rows.join(rows.groupBy("key").agg(F.count("*").alias("n")), "key")
    met = held.groupBy("set_id").agg(F.sum("n").alias("met"))
    ranked = rows.join(met, "set_id").select("key", F.col("set_id").alias("id"), F.struct("met", "set_id").alias("rank"))
    hubs = ranked.groupBy("key").agg(F.max("rank").alias("hub"))
    each = ranked.join(hubs, "key").groupBy("id", "hub").agg(F.count("*").alias("n"))
    best = each.groupBy(F.col("id").alias("set_id")).agg(F.max(F.struct("n", "hub")).alias("best"))
    return materialize(best.select("set_id", F.col("best.hub.set_id").alias("home")), "homes")


def _links_within(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that connect what groups of ``members`` (grp, set_id, component) hold, from whole sets compared in blocks.

    A group is cut into slots of about ``SLOT`` n-grams, and each two slots
    meet in one task, which keeps only as many links as connect components.
    """
    sized = members.join(sets.select("set_id", "size"), "set_id")
    slots = sized.groupBy("grp").agg(F.greatest(F.ceil(F.sum("size") / SLOT), F.ceil(F.count("*") / SLOT_SETS)).cast("int").alias("slots"))
    placed = members.join(slots, "grp").withColumn("slot", F.pmod(F.xxhash64("set_id"), F.col("slots")).cast("int"))
    whole = placed.join(sets, "set_id")
    each = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    pairs = each.select("grp", F.least("slot", "other").alias("low"), F.greatest("slot", "other").alias("high"), "slot", "set_id", "component", "size", "tokens")

    def compare(table: pa.Table) -> pa.Table:
        ids, comps, sizes = (table.column(c).to_numpy() for c in ("set_id", "component", "size"))
        first = table.column("slot").to_numpy() == table.column("low")[0].as_py()
        kept: list[tuple[int, int]] = []
        if len(set(comps.tolist())) > 1:
            tokens = np.concatenate([c.flatten().to_numpy() for c in table.column("tokens").chunks])
            kept = _connecting(ids, comps, sizes, tokens, first, percent)
        return pa.table({"a": pa.array([k[0] for k in kept], pa.int64()), "b": pa.array([k[1] for k in kept], pa.int64())})

    return materialize(pairs.groupBy("grp", "low", "high").applyInArrow(compare, "a long, b long"), "links")


def _connecting(ids, comps, sizes, tokens, first, percent: int) -> list[tuple[int, int]]:
    """Links between the sets of ``first`` and the others (among themselves if there are no others) that connect components."""
    owner = np.repeat(np.arange(len(ids)), sizes)
    x, y = (np.flatnonzero(first), np.flatnonzero(~first)) if not first.all() else (np.flatnonzero(first),) * 2
    _, code, often = np.unique(tokens, return_inverse=True, return_counts=True)
    width = int((often > 1).sum())
    code = np.where(often[code] > 1, (np.cumsum(often > 1) - 1)[code], width)  # n-grams of one set are in no intersection
    row = np.zeros(len(ids), np.int64)
    row[y] = np.arange(len(y))
    row[x] = np.arange(len(x))
    in_x = first[owner]
    in_y = in_x if first.all() else ~in_x
    by = np.argsort(code, kind="stable")
    code, owner, in_x, in_y = code[by], owner[by], in_x[by], in_y[by]
    edges = np.searchsorted(code, np.arange(0, width + COLUMNS, COLUMNS).clip(max=width))
    shared = np.zeros((len(x), len(y)), np.float32)
    for at, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        columns = min(COLUMNS, width - at * COLUMNS)
        if columns <= 0:
            break
        left, right = np.zeros((len(x), columns), np.float32), np.zeros((len(y), columns), np.float32)
        c, o = code[a:b] - at * COLUMNS, owner[a:b]
        left[row[o[in_x[a:b]]], c[in_x[a:b]]] = 1
        right[row[o[in_y[a:b]]], c[in_y[a:b]]] = 1
        shared += left @ right.T
    shared = shared.astype(np.int64)
    linked = (100 * shared >= percent * (sizes[x][:, None] + sizes[y][None] - shared)) & (comps[x][:, None] != comps[y][None])
    root: dict[int, int] = {}

    def find(c):
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    kept = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = find(int(comps[x[i]])), find(int(comps[y[j]]))
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((int(ids[x[i]]), int(ids[y[j]])))
    return kept


def _connect(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``id, component`` of the sets that links connect, by way of the keys of ``rows``."""
    keyed = _allocated(rows, sets, percent)
    homes = _homes(keyed)
    hubs = homes.where("home <> set_id").select(F.col("home").alias("set_id"), "home").distinct()
    families = homes.union(hubs).distinct().select(F.col("home").alias("grp"), "set_id", F.col("set_id").alias("component"))
    links = _links_within(families, sets, percent)
    labels = components(links)
    known = homes.join(labels.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    named = keyed.join(known, "set_id")
    each = named.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("home").alias("h0"), F.max("home").alias("h1"), F.mode("home", True).alias("main"))
    apart = each.where("c0 < c1 and h0 < h1").select("key", F.col("main").alias("grp"))  # such keys' sets join the home of most of them
    left = materialize(named.join(apart, "key").select("grp", "set_id", "component").distinct(), "left")
    more = _links_within(left, sets, percent)
    return components(links.union(more)) if more.head(1) else labels


def ngram_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each document: the size of its set and the smallest ``doc_id`` that links reach."""
    source = text_bytes(docs).where(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long"))
    base = materialize(_base(source, n), "sets")
    shared = materialize(_shared(_keys(source, n, percent)), "shared")
    rows = materialize(_enough(shared), "rows")
    sets = _whole(source, base, rows, n)
    labels = _connect(rows, sets, percent)
    # a component's name is the smallest document of all its sets
    classes = base.where("size > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    of_class = classes.join(labels.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    of_component = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of_class.join(of_component, "component").select("set_id", "component_id")
    alone = F.when(F.col("size") > 0, F.col("set_id"))  # empty sets are linked with nothing
    joined = base.withColumn("__set", alone).join(named.withColumnRenamed("set_id", "__set"), "__set", "left")
    return joined.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the smallest ``doc_id`` of each component alone; rows with a null ``doc_id`` stay."""
    others = ngram_components(docs, n, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
