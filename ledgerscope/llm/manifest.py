"""Merkle manifest of a dataset: who holds the root can check any row from a short proof.

Every row is a leaf, the sha256 of its fields with their lengths.  The leaves
of a source, by key, form a tree of ``FAN`` children a node; the sources'
roots, by source, form one more tree in the same way.

A tree is cut into aligned blocks of ``TALL`` levels of edges, at most
``FAN ** TALL`` leaves each.  A block is one row of a stored table, its nodes
in van Emde Boas order: the upper half of its levels first, then the lower
subtrees from left to right, each laid out likewise.  ``address`` finds a node
by arithmetic alone; building a block and reading siblings use it.  The roots
of a tier of blocks are the leaves of the next tier, until each tree has one
block; proofs then come down tier by tier, each block getting the siblings
above its root by a join.  No task ever sees more than a block's leaves, and
the driver sees one row a partition (to number the leaves) and the root.

Defined results: sources ascend bytewise, null first, then the empty one;
within a source leaves ascend by key, null first, and rows of one key by their
digests, so that exact copies are separate leaves; a null field is written
``-``; a null key is never altered; an empty table has no rows; other columns
take no part, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

FAN, TALL = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_of(fields: dict[str, Column] | list[Column]) -> Column:
    """Hex digest of a row: each field as its length in bytes, ``:`` and its value, or ``-`` for null."""
    texts = [c.cast("string") for c in (fields.values() if isinstance(fields, dict) else fields)]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def nodes_of(levels: int) -> int:
    """How many nodes a whole tree of so many levels of nodes has."""
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, i: np.ndarray) -> np.ndarray:
    """Where the nodes ``i`` of a depth stand in a tree of ``levels`` levels of nodes in van Emde Boas order."""
    if levels == 1:
        return np.zeros_like(i)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, i)
    lower, under = levels - upper, FAN ** (depth - upper)
    return nodes_of(upper) + i // under * nodes_of(lower) + address(lower, depth - upper, i % under)


def counts(n: int, height: int) -> list[int]:
    """Nodes at each depth of a block with ``n`` leaves."""
    found = [n]
    for _ in range(height):
        found.append(-(-found[-1] // FAN))
    return found[::-1]


def height_of(n: int, block: int, tall: int = TALL) -> int:
    """Levels of edges of a block: all that blocks have, but for a tree's only block, which ends at its root."""
    if block:
        return tall
    height = 0
    while FAN**height < n:
        height += 1
    return height


def build(leaves: list[bytes], height: int) -> bytes:
    """The nodes of a block in van Emde Boas order, 32 bytes each, up to the last one that exists."""
    many = counts(len(leaves), height)
    at = [address(height + 1, depth, np.arange(n)) for depth, n in enumerate(many)]
    cells = np.zeros((max(int(a[-1]) for a in at) + 1, 32), np.uint8)
    cells[at[height]] = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, 32)
    run = 64 * FAN
    for depth in range(height - 1, -1, -1):
        below = cells[at[depth + 1]].tobytes().hex().encode()
        made = b"".join(hashlib.sha256(below[run * i : run * (i + 1)]).digest() for i in range(many[depth]))
        cells[at[depth]] = np.frombuffer(made, np.uint8).reshape(-1, 32)
    return cells.tobytes()


def lineage(nodes: bytes, n: int, height: int, above: list[str]) -> tuple[list[str], list[list[str]]]:
    """Hex digests of a block's leaves, and of each the siblings left and right of its node, level by level, up to the root."""
    many = counts(n, height)
    cells = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
    paths = [above]
    hexes = cells[0].tobytes().hex()
    for depth in range(1, height + 1):
        hexes = cells[address(height + 1, depth, np.arange(many[depth]))].tobytes().hex()
        own = []
        for i in range(many[depth]):
            first = i - i % FAN
            own.append([hexes[64 * first : 64 * i], hexes[64 * (i + 1) : 64 * (first + FAN)], *paths[i // FAN]])
        paths = own
    return [hexes[64 * i : 64 * (i + 1)] for i in range(n)], paths


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf has by its path: siblings to the left and right, level by level."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        leaf = hashlib.sha256(f"{left}{leaf}{right}".encode()).hexdigest()
    return leaf


def numbered(leaves: DataFrame, key: str = "key") -> DataFrame:
    """``leaves`` with the rank of their source (``tree``) and their own within it (``i``), both from 0.

    A sort by ranges deals every source over many tasks; each task numbers what it has, and what stands before it is
    one row a partition.
    """
    order = [F.col(c).asc_nulls_first() for c in ("source", key, "leaf", "nth")]
    names = leaves.columns

    def count(batches):
        from pyspark import TaskContext

        part, seen, tree, i = TaskContext.get().partitionId(), None, -1, 0
        for batch in batches:
            trees, places = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for k, source in enumerate(batch.column(names.index("source")).to_pylist()):
                if tree < 0 or source != seen:
                    seen, tree, i = source, tree + 1, 0
                trees[k], places[k], i = tree, i, i + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(trees), pa.array(places)], names=[*names, "part", "tree", "i"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema)
    local = materialize(leaves.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(count, f"{schema}, part int, tree long, i long"), "leaves")
    ends = local.groupBy("part").agg(F.max("tree").alias("trees"), F.min_by("source", "tree").alias("first"), F.max_by("source", "tree").alias("last"), F.max_by(F.col("i") + 1, F.struct("tree", "i")).alias("n")).orderBy("part").collect()
    rows, tree, n, last = [], -1, 0, None
    for r in ends:  # one a partition
        goes_on = tree >= 0 and r["first"] == last
        tree, n = (tree, n) if goes_on else (tree + 1, 0)
        rows.append((r["part"], tree, n))
        n, tree, last = r["n"] + (n if r["trees"] == 0 else 0), tree + r["trees"], r["last"]
    before = F.broadcast(local.sparkSession.createDataFrame(rows, "part int, trees_before long, before long"))
    first = F.col("tree") == 0
    return local.join(before, "part").select(*names, (F.col("tree") + F.col("trees_before")).alias("tree"), F.when(first, F.col("i") + F.col("before")).otherwise(F.col("i")).alias("i"))


def tiers(leaves: DataFrame, tall: int = TALL) -> list[DataFrame]:
    """Stored blocks of all trees, the tier of the leaves first; of ``leaves`` (``tree, i, leaf, key, altered``) each block keeps keys and altered leaves."""
    found = []
    kind = leaves.schema["key"].dataType.simpleString()
    while True:
        of = leaves.withColumn("block", F.expr(f"i div {FAN**tall}"))

        def block(keys, table):
            table = table.sort_by("i")
            n, number = table.num_rows, keys[1].as_py()
            nodes = build(table.column("leaf").to_pylist(), height_of(n, number, tall))
            own = [table.column(c).combine_chunks() for c in ("key", "altered")]
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c) for c in own]
            return pa.table([pa.array([keys[0].as_py()]), pa.array([number]), pa.array([n]), pa.array([nodes]), *lists], names=["tree", "block", "n", "nodes", "keys", "altered"])

        blocks = materialize(of.groupBy("tree", "block").applyInArrow(block, f"tree long, block long, n long, nodes binary, keys array<{kind}>, altered array<binary>"), f"tier{len(found)}")
        found.append(blocks)
        if not blocks.agg(F.max("block")).first()[0]:
            return found
        leaves = blocks.select("tree", F.col("block").alias("i"), F.substring("nodes", 1, 32).alias("leaf"), F.lit(None).cast(kind).alias("key"), F.lit(None).cast("binary").alias("altered"))


def _with_paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    return blocks.join(above, ["tree", "block"])


def _below(blocks: DataFrame, above: DataFrame, tall: int) -> DataFrame:
    """``tree, i, leaf, path, top``: the path of each leaf of the blocks, whose own paths are ``above``."""

    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                leaves, paths = lineage(r["nodes"], r["n"], height_of(r["n"], r["block"], tall), r["path"])
                first = r["block"] * FAN**tall
                n = len(leaves)
                yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * n, pa.int64()), pa.array(np.arange(first, first + n)), pa.array(leaves), pa.array(paths, pa.list_(pa.string())), pa.array([r["top"]] * n, pa.string())], names=["tree", "i", "leaf", "path", "top"])

    return _with_paths(blocks.select("tree", "block", "n", "nodes"), above).mapInArrow(rows, "tree long, i long, leaf string, path array<string>, top string")


def descend(found: list[DataFrame], tops: DataFrame, tall: int) -> DataFrame:
    """Paths (``tree, block, path, top``) of the blocks of the lowest tier, from those of each tree's root (``tree, path, top``)."""
    above = tops.select("tree", F.lit(0).cast("long").alias("block"), "path", "top")
    for blocks in found[:0:-1]:
        above = _below(blocks, above, tall).select("tree", F.col("i").alias("block"), "path", "top")
    return above


class Manifest:
    """The stored blocks of all trees: of each source (``blocks``, tier by tier) and of the sources' roots (``sources``)."""

    def __init__(self, blocks: list[DataFrame], sources: list[DataFrame], tall: int):
        self.blocks, self.sources, self.tall = blocks, sources, tall

    def root(self) -> str | None:
        """The digest of all; none for an empty table."""
        top = self.sources[-1].select(F.lower(F.hex(F.substring("nodes", 1, 32)))).first()
        return top and top[0]

    def subroots(self) -> DataFrame:
        """``tree, path, top``: of each source, by its rank, the siblings above its root, and that root."""
        top = self.sources[-1].sparkSession.createDataFrame([(0, [], None)], "tree long, path array<string>, top string")
        return _below(self.sources[0], descend(self.sources, top, self.tall), self.tall).select(F.col("i").alias("tree"), "path", F.col("leaf").alias("top"))

    def proofs(self) -> DataFrame:
        """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` of every leaf.

        What is folded is the altered leaf where there is one; the siblings are those of the untouched tree.
        """
        root, tall, kind = self.root(), self.tall, self.blocks[0].schema["keys"].dataType.elementType.simpleString()
        names = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

        def rows(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    r = batch.slice(i, 1)
                    n, number, nodes, above, top, altered = (r.column(c)[0].as_py() for c in ("n", "block", "nodes", "path", "top", "altered"))
                    leaves, paths = lineage(nodes, n, height_of(n, number, tall), above)
                    proof = [hashlib.sha256("".join(p).encode()).hexdigest() for p in paths]
                    folded = [fold(a.hex() if a else leaf, p) for a, leaf, p in zip(altered, leaves, paths, strict=True)]
                    own = r.column("keys").flatten()
                    yield pa.RecordBatch.from_arrays([own, pa.array(leaves), pa.array([top] * n), pa.array([root] * n), pa.array(proof), pa.array(folded), pa.array([f == root for f in folded])], names=names)

        told = _with_paths(self.blocks[0], descend(self.blocks, self.subroots(), tall))
        return told.mapInArrow(rows, f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, *, key: str = "doc_id", source: str = "source", fields: tuple[str, ...] = FIELDS, altered: dict[str, Column] | None = None, where: Column | None = None, tall: int = TALL) -> Manifest:
    """The manifest of ``docs``; ``altered`` gives fields that a tampered copy of the rows ``where`` has."""
    own = {f: F.col(f) for f in fields}
    hurt = F.when(where, F.unhex(leaf_of(own | (altered or {})))) if where is not None else F.lit(None).cast("binary")
    rows = docs.select(F.col(source).cast("string").alias("source"), F.col(key).alias("key"), F.unhex(leaf_of(own)).alias("leaf"), hurt.alias("altered"), F.monotonically_increasing_id().alias("nth"))
    leaves = numbered(materialize(rows, "digests"))
    blocks = tiers(leaves.select("tree", "i", "leaf", "key", "altered"), tall)
    roots = blocks[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.substring("nodes", 1, 32).alias("leaf"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("binary").alias("altered"))
    return Manifest(blocks, tiers(roots, tall), tall)


def lowered(text: str = "text") -> Column:
    """A text whose letters A-Z are small: what tampering does to it."""
    return F.translate(F.col(text), UPPER, LOWER)


def tampered_rows(docs: DataFrame, tall: int = TALL) -> DataFrame:
    """Every row's proof, and what a fifth of the rows, tampered with, fold to."""
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return manifest(docs, altered={"text": lowered()}, where=touched, tall=tall).proofs().withColumnRenamed("key", "doc_id")


def _levels_sql(name: str, leaves: str, levels: int) -> str:
    """Tables ``name0`` ... of the nodes (``s, i, h, n``) of trees, and ``name_up``: of each leaf the texts left and right of its nodes."""
    said = [f"{name}0 AS ({leaves})"]
    for k in range(levels):
        said.append(
            f"{name}{k}_up AS (SELECT s, i, n, h, coalesce(string_agg(h, '') OVER (PARTITION BY s, i // {FAN} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
            f" coalesce(string_agg(h, '') OVER (PARTITION BY s, i // {FAN} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"
        )
        said.append(f"{name}{k + 1} AS (SELECT s, i // {FAN} AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (any_value(n) + {FAN - 1}) // {FAN} AS n FROM {name}{k} GROUP BY s, i // {FAN})")
    joins = "".join(f" JOIN {name}{k}_up u{k} ON u{k}.s = a.s AND u{k}.i = a.i // {FAN**k}" for k in range(levels))
    paths = ", ".join(f"CASE WHEN u{k}.n > 1 THEN [u{k}.l, u{k}.r] END" for k in range(levels))
    said.append(f"{name}_up AS (SELECT a.s, a.i, a.h, t.h AS top, list_filter([{paths}], lambda x: x IS NOT NULL) AS path FROM {name}0 a JOIN {name}{levels} t ON t.s = a.s{joins})")
    return ",\n".join(said)


def manifest_sql(levels: int = 5) -> str:
    """The rows of ``tampered_rows`` for DuckDB, for trees of at most ``FAN ** levels`` leaves."""
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bits = "list_reduce(list_prepend(x, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c // 256, steps[(xor(c, b) % 256 + 1)::BIGINT])), 4294967295)"
    return rf"""
WITH st AS (SELECT list_transform(range(0, 256), lambda x: {bits}) AS steps),
d AS (SELECT doc_id, source, {leaf("text")} AS h, coalesce({crc} % 5 = 0, false) AS touched, {leaf("translate(text, '" + UPPER + "', '" + LOWER + "')")} AS altered FROM documents, st),
o AS (SELECT *, dense_rank() OVER (ORDER BY source IS NOT NULL, source) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d),
{_levels_sql("leaf", "SELECT s, i, h, count(*) OVER (PARTITION BY s) AS n FROM o", levels)},
{_levels_sql("src", f"SELECT 0 AS s, s AS i, h, count(*) OVER () AS n FROM leaf{levels}", levels)},
p AS (SELECT o.doc_id, o.h AS leaf, l.top AS subroot, q.top AS root, list_concat(l.path, q.path) AS path, CASE WHEN o.touched THEN o.altered ELSE o.h END AS start
 FROM o JOIN leaf_up l ON l.s = o.s AND l.i = o.i JOIN src_up q ON q.i = o.s),
f AS (SELECT *, sha256(coalesce(list_aggregate(list_transform(path, lambda x: x[1] || x[2]), 'string_agg', ''), '')) AS proof_sha256, list_reduce(list_prepend([start, ''], path), lambda c, x: [sha256(x[1] || c[1] || x[2]), ''])[1] AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f"""
