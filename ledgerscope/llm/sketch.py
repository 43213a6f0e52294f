"""Count-min sketches of 64-bit hashes, merged over partitions and kept in shards.

The hashes are dealt into ranges, the shards, of about ``SHARD`` expected
hashes each, so that a shard's sketch has the same load at every size and none
ever leaves its task.  A partition's part of a shard's sketch is the list of
its distinct hashes there, cut to the 24 bits from which the cells of both rows
follow; a shard adds up the parts of all partitions and answers each of them
with one bit a hash: estimated in two partitions or more.  A sketch never
underestimates, and of single hashes about three in a hundred look repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, mix

DEPTH, WIDTH = 2, 1 << 21
SHARD = 1 << 18
#: Columns of an answer to a partition, and of a partition's part.
ANSWER = "grp int, shard int, bits binary"
PART = "shard int, grp int, prints binary"


def shards_of(items: float) -> int:
    return max(1, int(-(-items // SHARD)))


def _edges(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins among sorted hashes, and where the last one ends."""
    shard = ((hashes >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)
    return np.searchsorted(shard, np.arange(shards + 1))


def part(grp: int, hashes: np.ndarray, shards: int) -> pa.Table:
    """A partition's part, from its distinct hashes in order."""
    edges = _edges(hashes, shards)
    prints = np.ascontiguousarray((hashes & U64(0xFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
    some = np.flatnonzero(np.diff(edges))
    cut = [prints[edges[s] : edges[s + 1]].tobytes() for s in some]
    return pa.table([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), grp, np.int32)), pa.array(cut, pa.binary())], names=["shard", "grp", "prints"])


def _cells(data: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(data) // 3, 4), np.uint8)
    wide[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    prints = wide.view("<u4").ravel().astype(U64)
    return np.stack([(mix(prints, 101 + row) % U64(width)).astype(np.int64) for row in range(DEPTH)])


def answered(parts: list[bytes], width: int) -> list[bytes]:
    """A shard's answers to the parts of all partitions."""
    counts = np.zeros((DEPTH, width), np.int32)
    for data in parts:
        for row, cells in enumerate(_cells(data, width)):
            np.add.at(counts[row], cells, 1)
    bits = []
    for data in parts:
        cells = _cells(data, width)
        bits.append(np.packbits(np.min([counts[row][cells[row]] for row in range(DEPTH)], axis=0) > 1).tobytes())
    return bits


def answers(parts: DataFrame) -> DataFrame:
    """``grp, shard, bits`` for the parts (``PART``) of all partitions."""
    width = WIDTH

    def of(table: pa.Table) -> pa.Table:
        bits = answered(table.column("prints").to_pylist(), width)
        return pa.table([table.column("grp"), table.column("shard"), pa.array(bits, pa.binary())], names=["grp", "shard", "bits"])

    return parts.groupBy("shard").applyInArrow(of, ANSWER)


def repeated(answer: pa.Table, hashes: np.ndarray, shards: int) -> np.ndarray:
    """Which of a partition's distinct hashes, in order, the sketch holds as occurring in two partitions or more."""
    many = np.diff(_edges(hashes, shards))
    out = np.zeros(len(hashes), bool)
    begin = np.cumsum(many) - many
    for shard, bits in zip(answer.column("shard").to_pylist(), answer.column("bits").to_pylist(), strict=True):
        n = int(many[shard])
        out[begin[shard] : begin[shard] + n] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
    return out
