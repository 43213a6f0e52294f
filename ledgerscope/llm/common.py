"""Helpers that several text operators share.

Word work follows one rule everywhere: a text is taken as UTF-8 bytes and cut
at ASCII white space (0x20, 0x09-0x0D); a null text has no words.  Hashes are
64-bit and computed for a block of documents at a time with numpy.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.sources.shared import materialize, shared_dir  # noqa: F401

U64 = np.uint64
#: Characters of text that a task turns into words at a time.
BLOCK_CHARS = 1_000_000
#: Bytes of rows that Spark hands to Python at a time.
BATCH_BYTES = 2 << 20


#: Buckets that Spark lets a table have (spark.sql.sources.bucketing.maxBuckets); with more data each bucket grows.
MOST_BUCKETS = 100_000


def bucketed(df: DataFrame, by: str, files: int, most: int = MOST_BUCKETS) -> DataFrame:
    """``df`` as a table in the shared folder, in ``files`` buckets (``most`` at most) of column ``by``: later joins and groups on it don't move it."""
    files = min(files, most)
    name = f"t{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(files, by).option("path", f"{shared_dir(df.sparkSession)}/{name}").saveAsTable(name)
    return df.sparkSession.table(name)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, once its session hands Python ``BATCH_BYTES`` at a time: long texts don't pile up in a task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) != str(BATCH_BYTES):
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def text_bytes(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key and text as UTF-8 bytes, a null text as none; no other column travels further."""
    return small_batches(docs).select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))


def held_out(modulus: int, remainder: int, key: str = "doc_id"):
    """Whether crc32 of the key written as text leaves ``remainder``; not so for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def blocks(batches, *columns: int, size: int = BLOCK_CHARS) -> Iterator[list[list]]:
    """Rows of Arrow batches as Python lists, ``size`` bytes of the last column at a time, one row at least."""
    for batch in batches:
        lists = [batch.column(c).to_pylist() for c in columns]
        start = total = 0
        for i, body in enumerate(lists[-1]):
            total += len(body)
            if total >= size:
                yield [x[start : i + 1] for x in lists]
                start, total = i + 1, 0
        if start < len(lists[-1]):
            yield [x[start:] for x in lists]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = h + U64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A keyed 64-bit hash of each word."""
    if not words:
        return np.empty(0, U64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def block_words(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block of texts, and where each text's words begin (one entry more than texts)."""
    each = [b.split() for b in bodies]
    starts = np.zeros(len(bodies) + 1, np.int64)
    np.cumsum([len(w) for w in each], out=starts[1:])
    return word_hashes([w for words in each for w in words]), starts


def window_hashes(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the ``n`` words that begin at each word; the last ``n - 1`` words begin none."""
    if len(h) < n:
        return np.empty(0, U64)
    h = mix(h, salt)
    m = len(h) - n + 1
    acc = h[:m].copy()
    for k in range(1, n):
        acc *= U64(0x9FB21C651E98DF25)
        acc += h[k : k + m]
    return mix(acc, salt + 7)


def within_texts(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of ``n`` words lie in one text, as (mask over windows, text of each window)."""
    total = int(starts[-1])
    m = max(0, total - n + 1)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return owner[:m] == owner[n - 1 : n - 1 + m], owner[:m]


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64) if h.dtype == U64 else h.astype(np.int64)
