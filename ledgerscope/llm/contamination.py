"""Benchmark decontamination: which short test items stand inside long documents.

MinHash containment search with size partitions.  Documents are dealt into
partitions by their number of shingles, each twice as large as the one before.
A partition has as many bins as its largest document has shingles, so that the
smallest hash of a bin stands for about one shingle however long the document
is: a shingle that item and document share is the smallest of its bin in the
document with a probability of 0.63 at least, and an item of ``q`` shingles
that is contained to 0.8 escapes with at most ``0.37 ** (0.8 * q)``.  Such an
item is asked for in each partition with all of its shingles' bins, since a
document may lack any of its shingles.  Items for which that bound exceeds
``ESCAPE`` are short, and none may escape: documents offer every shingle that
the benchmark has, and an item is asked for by its smallest shingles, one more
than a document that contains it can lack.  Candidates are verified by the
exact share of the item's shingles that the document has.

What tasks need of the benchmark is a Bloom filter of fixed size; the exact
comparison is a join, so the benchmark may be of any size.

Words are runs of ASCII letters and digits and of anything beyond ASCII, in
lower case.  An item of fewer than five words is one shingle of as many words.
Defined results: null or empty texts match nothing; rows that repeat a
``doc_id`` or ``item_id`` count as one with the shingles of all; null keys match
nothing; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_long, block_words, blocks, mix, small_batches, window_hashes, within_texts

SHINGLE = 5
CONTAINMENT = 0.8
#: Bits of the filter that tasks hold of the benchmark: 8 MB, however large the benchmark is.
FILTER_BITS = 26
#: The smallest and the largest partition, as powers of two of a document's shingles.
LEAST_BINS, MOST_BINS = 4, 26
#: Items that bins might miss with a larger probability are asked for by shingles instead.
ESCAPE = 1e-9
#: Every byte but ASCII letters, digits and those beyond ASCII becomes a space.
PLAIN = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def _sets(bodies: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, starts = block_words([b.translate(PLAIN) for b in bodies])
    inside, owner = within_texts(starts, n)
    h = window_hashes(words, n)
    h, owner = h[inside], owner[inside]
    edges = np.searchsorted(owner, np.arange(len(bodies) + 1))
    return [np.unique(h[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _short(bodies: list[bytes], n: int) -> list[np.ndarray]:
    """Distinct shingles of ``n`` words, fewer than ``SHINGLE``, told apart from all others."""
    return [mix(h, 700 + n) for h in _sets(bodies, n)]


def _item_sets(bodies: list[bytes]) -> list[np.ndarray]:
    """Shingles of items: of fewer than ``SHINGLE`` words all of them are one."""
    sets = _sets(bodies)
    for i, body in enumerate(bodies):
        if not len(sets[i]) and (n := len(body.translate(PLAIN).split())):
            sets[i] = _short([body], n)[0]
    return sets


def _lengths(items: DataFrame, text: str = "text") -> list[int]:
    """Numbers of words, fewer than ``SHINGLE``, that items have."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9\\x{80}-\\x{10FFFF}]+", " ")), " ")
    short = items.select(F.when(F.array_contains(words, ""), 0).otherwise(F.size(words)).alias("n")).where(F.col("n").between(1, SHINGLE - 1))
    return sorted(r["n"] for r in short.distinct().collect())  # four numbers at most


def _bin_keys(hashes: np.ndarray, power: int) -> np.ndarray:
    """Keys of hashes as members of their bins, in a partition of ``2 ** power`` bins."""
    return mix(hashes, 200 + power)


def _whole_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of hashes as shingles, in no bin."""
    return mix(hashes, 199)


def _asked_keys(hashes: np.ndarray, containment: float) -> np.ndarray:
    """The keys by which an item is asked for."""
    needed = max(1, int(np.ceil(containment * len(hashes) - 1e-9)))
    if 0.37**needed > ESCAPE:
        return _whole_keys(np.sort(hashes)[: len(hashes) - needed + 1])
    return np.concatenate([_bin_keys(hashes, p) for p in range(LEAST_BINS, MOST_BINS + 1)])


def _lowered(df: DataFrame, key: str, text: str) -> DataFrame:
    return small_batches(df).where(F.col(key).isNotNull()).select(F.col(key).cast("long"), F.lower(F.coalesce(F.col(text), F.lit(""))).cast("binary").alias("body"))


def item_shingles(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, shingles`` (sorted distinct hashes) of the items that have any."""

    def mapper(batches):
        for ids, bodies in blocks(batches, 0, 1):
            sets = _item_sets(bodies)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([as_long(s) for s in sets], pa.list_(pa.int64()))], names=["item_id", "shingles"])

    found = _lowered(items, item, text).mapInArrow(mapper, "item_id long, shingles array<long>")
    return found.where(F.size("shingles") > 0).groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("shingles"))


def _filter_bits(shingles: DataFrame) -> np.ndarray:
    """A Bloom filter of the items' shingles, merged from one filter a task."""

    def mapper(batches):
        plane = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
            for row in range(2):
                plane[(mix(h, 300 + row) >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
        at = np.flatnonzero(np.packbits(plane, bitorder="little"))
        packed = np.packbits(plane, bitorder="little")[at]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(packed.astype(np.int32))], names=["at", "bits"])

    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    merged = shingles.select(F.explode("shingles").alias("h")).mapInArrow(mapper, "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    got = merged.toArrow()  # as many rows as the filter has bytes, at most
    bits[got.column("at").to_numpy()] = got.column("bits").to_numpy().astype(np.uint8)
    return bits


def _may(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    hit = np.ones(len(h), bool)
    for row in range(2):
        cell = (mix(h, 300 + row) >> U64(64 - FILTER_BITS)).astype(np.int64)
        hit &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return hit


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment`` of each item that a document contains to ``containment`` or more."""
    shingles = item_shingles(items)
    lengths = _lengths(items)
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(shingles))

    def mapper(batches):
        plane = bits.value
        for ids, bodies in blocks(batches, 0, 1):
            keys, shared, of = [], [], []
            short = [np.concatenate(x) for x in zip(*(_short(bodies, n) for n in lengths), strict=True)] if lengths else [np.empty(0, U64)] * len(bodies)
            for doc, h, few in zip(ids, _sets(bodies), short, strict=True):
                if not len(h) + len(few):
                    continue
                power = int(min(MOST_BINS, max(LEAST_BINS, np.ceil(np.log2(max(1, len(h)))))))
                bins = h >> U64(64 - power)
                new = np.ones(len(h), bool)
                new[1:] = bins[1:] != bins[:-1]
                least = h[new]  # sorted: the first of each bin is its smallest
                known = np.r_[h[_may(plane, h)], few[_may(plane, few)]]
                if len(known):
                    of.append(doc)
                    keys.append(as_long(np.r_[_whole_keys(known), _bin_keys(least[_may(plane, least)], power)]))
                    shared.append(as_long(known))
            if of:
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(shared, pa.list_(pa.int64()))], names=["doc_id", "keys", "shared"])

    def asked(batches):
        for batch in batches:
            for item, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = _asked_keys(np.array(h, np.int64).view(U64), containment)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), item, np.int64)), pa.array(as_long(keys))], names=["item_id", "key"])

    found = _lowered(docs, "doc_id", "text").mapInArrow(mapper, "doc_id long, keys array<long>, shared array<long>")
    wanted = shingles.mapInArrow(asked, "item_id long, key long")
    once = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    whole = found.groupBy("doc_id").agg(once("keys"), once("shared"))
    pairs = whole.select("doc_id", "shared", F.explode("keys").alias("key")).join(wanted, "key").groupBy("doc_id", "item_id").agg(F.first("shared").alias("shared"))
    n = F.size("shingles").cast("long")
    exact = pairs.join(shingles, "item_id").select("doc_id", "item_id", F.size(F.array_intersect("shared", "shingles")).cast("long").alias("n_shared"), n.alias("n_item"))
    return exact.where(F.col("n_shared") >= F.lit(float(containment)) * F.col("n_item")).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` without the documents that contain an item; rows with a null ``doc_id`` stay."""
    return docs.join(contained_items(docs, items, containment).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
