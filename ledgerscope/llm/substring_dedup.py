"""Substring deduplication over windows of words, behind a count-min prefilter.

A word goes if a window that covers it also starts in a document with a smaller
``doc_id``.  Rows are dealt into groups of about ``GROUP`` bytes once, in a
bucketed table, so that no later step moves texts.  The first pass sketches
each group's windows; the merged sketch, which lives in shards of the hash
range, overestimates, so a window that two documents share always looks
repeated.  The second pass sends only windows that look repeated, and of those
only what its own group cannot settle: of equal windows in a group all but the
smallest document's are known to go.  Windows are then grouped exactly by
96 bits of two hashes (both made of 64-bit hashes of the words), which gives
the smallest document of each.

Defined results: a null or empty text has no words and keeps none; a text of
fewer than ``window`` words has no window and stays; a null ``doc_id`` is
compared with nothing and its text stays; rows that repeat a ``doc_id`` count
as one document whose windows don't remove each other, and each row loses what
its own windows cover; equal windows within one document don't remove each
other; columns of the input named like an added one are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sketch
from .common import BLOCK_CHARS, MOST_BUCKETS, U64, as_long, block_words, bucketed, mix, small_batches, window_hashes, within_texts

WINDOW = 13
#: Bytes of text of a group, and of a bucket, which holds a few groups.
GROUP, BUCKET = 6 << 20, 24 << 20
ADDED = ("kept_text", "n_words", "n_removed")


def _packed(df: DataFrame, at: int) -> DataFrame:
    """``df`` with text column ``at`` compressed: texts cross the shuffle in half the bytes that Spark's codec takes."""
    fields = df.schema.fields
    names = df.columns

    def pack(batches):
        for batch in batches:
            packed = [None if t is None else zlib.compress(t.encode(), 1) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)], names=names)

    return small_batches(df).mapInArrow(pack, ", ".join(f"`{f.name}` {'binary' if i == at else f.dataType.simpleString()}" for i, f in enumerate(fields)))


def _group_of(row, groups: int):
    return F.pmod(F.xxhash64(row), F.lit(groups)).cast("int")


def _dealt(docs: DataFrame, size: int, groups: int, most: int = MOST_BUCKETS) -> DataFrame:
    """``docs`` with packed texts, a number for each row (``__row``) and its group (``__grp``), in buckets of groups; groups keep their size when buckets can't be more."""
    files = min(most, max(1, -(-size // BUCKET)))
    packed = _packed(docs, docs.columns.index("text")).withColumn("__row", F.monotonically_increasing_id())
    return bucketed(packed.withColumn("__grp", _group_of("__row", groups)).repartition(files, "__grp"), "__grp", files)


def _pieces(table: pa.Table):
    """Rows of a group that have a document, a piece of the texts at a time: (documents, row numbers, texts)."""
    docs, rows, texts = (table.column(c).to_pylist() for c in ("__doc", "__row", "text"))
    piece, total = ([], [], []), 0
    for doc, row, text in zip(docs, rows, texts, strict=True):
        if doc is not None and text is not None:
            body = zlib.decompress(text)
            for held, x in zip(piece, (doc, row, body), strict=True):
                held.append(x)
            total += len(body)
            if total >= BLOCK_CHARS:
                yield piece
                piece, total = ([], [], []), 0
    if piece[0]:
        yield piece


def _windows(table: pa.Table, window: int, salts: tuple[int, ...]):
    """Windows of a group: hashes for each salt, document, row number and position."""
    out = [[np.empty(0, U64)] for _ in salts] + [[np.empty(0, np.int64)] for _ in range(3)]
    for docs, rows, bodies in _pieces(table):
        words, starts = block_words(bodies)
        inside, owner = within_texts(starts, window)
        at = np.flatnonzero(inside)
        owner = owner[at]
        for held, salt in zip(out, salts, strict=False):
            held.append(window_hashes(words, window, salt)[at])
        for held, x in zip(out[len(salts) :], (np.array(docs, np.int64)[owner], np.array(rows, np.int64)[owner], at - starts[owner]), strict=True):
            held.append(x)
    return [np.concatenate(x) for x in out]


def _part(window: int, shards: int):
    def of(table: pa.Table) -> pa.Table:
        h, *_ = _windows(table, window, (0,))
        return sketch.part(table.column("__grp")[0].as_py(), np.unique(h), shards)

    return of


def _settled(h1, h2, doc, row, pos):
    """Rows ``h1, rest, doc_id, row, n``: undecided windows (n = 0), and runs of ``n`` windows that surely go."""
    by = np.lexsort((doc, h2, h1))
    h1, h2, doc, row, pos = h1[by], h2[by], doc[by], row[by], pos[by]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    gone = doc > doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
    rest = (h2 & U64(0xFFFFFFFF00000000)) | pos.astype(U64)
    r, p, d = row[gone], pos[gone], doc[gone]
    by = np.lexsort((p, r))
    r, p, d = r[by], p[by], d[by]
    first = np.ones(len(r), bool)
    first[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(first)
    n = np.diff(np.r_[first, len(r)])
    join = lambda a, b: np.concatenate([a, b])
    return join(h1[~gone], mix(r[first].astype(U64))), join(rest[~gone], p[first].astype(U64)), join(doc[~gone], d[first]), join(row[~gone], r[first]), join(np.zeros((~gone).sum(), np.int64), n)


def _suspects(window: int, shards: int):
    def of(table: pa.Table, answer: pa.Table) -> pa.Table:
        names = ["h1", "rest", "doc_id", "row", "n"]
        if not table.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4 + [pa.array([], pa.int32())], names=names)
        h1, h2, doc, row, pos = _windows(table, window, (0, 1))
        u, back = np.unique(h1, return_inverse=True)
        low, high = np.full(len(u), np.iinfo(np.int64).max), np.full(len(u), np.iinfo(np.int64).min)
        np.minimum.at(low, back, doc)
        np.maximum.at(high, back, doc)
        maybe = (sketch.repeated(answer, u, shards) | (low < high))[back]
        *longs, n = _settled(*(x[maybe] for x in (h1, h2, doc, row, pos)))
        return pa.table([*(pa.array(as_long(x)) for x in longs), pa.array(n.astype(np.int32))], names=names)

    return of


def repeated_runs(dealt: DataFrame, size: int, groups: int, window: int = WINDOW) -> DataFrame:
    """``row, pos, n``: of each row of a ``_dealt`` table the runs of ``n`` windows that a smaller document has too."""
    texts = dealt.where(F.col("doc_id").isNotNull()).select("__grp", F.col("doc_id").cast("long").alias("__doc"), "__row", "text")
    shards = sketch.shards_of(size / 6)
    told = sketch.answers(texts.groupBy("__grp").applyInArrow(_part(window, shards), sketch.PART))
    found = texts.groupBy("__grp").cogroup(told.groupBy("grp")).applyInArrow(_suspects(window, shards), "h1 long, rest long, doc_id long, row long, n int").repartition("h1")
    pos, h2 = F.col("rest").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"), F.shiftright("rest", 32)
    undecided = F.when(F.col("n") == 0, F.col("doc_id"))
    least = F.min(undecided).over(Window.partitionBy("h1", "h2"))
    gone = found.withColumn("h2", h2).withColumn("least", least).where((F.col("n") > 0) | (F.col("doc_id") > F.col("least")))
    return gone.select("row", pos.alias("pos"), F.greatest("n", F.lit(1)).alias("n"), _group_of("row", groups).alias("grp"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``kept_text`` (kept words joined by one space), ``n_words`` and ``n_removed``."""
    docs = docs.drop(*ADDED)
    columns = docs.columns
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    groups = max(1, -(-size // GROUP))
    dealt = _dealt(docs, size, groups)
    runs = repeated_runs(dealt, size, groups, window)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        row, pos, n = (found.column(c).to_numpy() for c in ("row", "pos", "n"))
        by = np.argsort(row, kind="stable")
        row, pos, n = row[by], pos[by].astype(np.int64), n[by].astype(np.int64)
        texts, kept, total, removed = [], [], [], []
        for packed, own in zip(table.column("text").to_pylist(), table.column("__row").to_pylist(), strict=True):
            body = b"" if packed is None else zlib.decompress(packed)
            texts.append(None if packed is None else body.decode())
            words = body.split()
            total.append(len(words))
            a, b = np.searchsorted(row, own), np.searchsorted(row, own, side="right")
            if a < b:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, pos[a:b], 1)
                np.add.at(edge, pos[a:b] + n[a:b] + window - 1, -1)
                keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                words = [words[i] for i in keep]
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words).decode())
        own = [pa.array(texts, pa.string()) if c == "text" else table.column(c) for c in columns]
        return pa.table([*own, pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*columns, *ADDED])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return dealt.groupBy("__grp").cogroup(runs.groupBy("grp")).applyInArrow(cut, f"{schema}, kept_text string, n_words long, n_removed long")
