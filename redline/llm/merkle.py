"""Merkle dataset manifest (operator 13): a postorder append log.

Every row is a leaf; per tree (language) leaves ascend by id, and pairs of neighbours are
hashed level by level until one node is left, the last of an odd level alone. The trees'
tops, ordered by tree, are the leaves of one more tree, whose top is the root.

* Builders are aligned: builder c of a tree takes leaves ``c * 2^K`` to ``(c + 1) * 2^K - 1``,
  so what it makes is a whole subtree. It appends nodes to its log segment as they are
  completed (postorder). Its top is a leaf of the next tier, built alike, until a tier
  has one builder. Spark sorts the leaves and hands each builder its range.
* Positions are closed form. Before leaf i there are i leaves and, per level l, ``i >> l``
  finished nodes, so leaf i stands at ``2i - popcount(i)``. The nodes a leaf completes
  follow it, so node j of level l stands l places behind its last leaf. A proof therefore
  addresses each sibling by arithmetic, in one segment per tier.
* Proofs go down the tiers: a segment's path to the root is worked out once and shared by its
  leaves, which meet it in the task that holds the segment.

Defined cases: a null field is ``-`` (an empty text is ``0:``); a null tree is a tree of its
own, before all others; a null id sorts first; rows that share an id follow each other by leaf
hash; equal rows are leaves of their own; a lone leaf is its tree's top; an empty table has no
root and no rows; extra columns (of any name) are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from redline.llm.common import cut, ranked

K = 10                                  # levels of a builder: at most 1,024 leaves, 64 KB of log
TOP = "/"                               # name of the tree of tops; others start with "=" or are empty
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LOG_SCHEMA = "tree string, tier int, builder long, n long, m int, nodes binary, top binary"


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return (n - 1).bit_length()


def leaf_position(i):
    """Place of leaf i in the postorder log."""
    return 2 * i - np.bitwise_count(np.asarray(i, np.uint64)).astype(np.int64)


def position(level, j, leaves: int):
    """Place of node j of ``level`` in the postorder log of a tree of ``leaves`` leaves."""
    return leaf_position(np.minimum((np.asarray(j, np.int64) + 1) << level, leaves) - 1) + level


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def append_log(leaves: list[str], levels: int) -> list[str]:
    """Nodes over ``leaves`` in completion order, ``levels`` levels high."""
    m = len(leaves)
    log = [""] * (int(leaf_position(m - 1)) + levels + 1)
    level = leaves
    for depth in range(levels + 1):
        for at, h in zip(position(depth, np.arange(len(level)), m).tolist(), level, strict=True):
            log[at] = h
        if depth < levels:
            level = [digest(*level[i:i + 2]) for i in range(0, len(level), 2)]
    return log


def siblings(m: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(log places, sides), leaves by levels, of each leaf's siblings in a segment of
    m leaves; side 0: none, 1: on the left, 2: on the right."""
    at = np.full((m, levels), -1, np.int64)
    side = np.zeros((m, levels), np.int8)
    for level in range(levels):
        own = np.arange(m) >> level
        other = own ^ 1
        there = (other << level) < m
        at[there, level] = position(level, other[there], m)
        side[there, level] = np.where(other < own, 1, 2)[there]
    return at, side


def hash_leaf(fields: list) -> F.Column:
    """Leaf hash (32 bytes) of columns: each ``-`` if null, else byte count, ``:``, value."""
    part = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*part), 256))


def tree_key(col) -> F.Column:
    """The tree's name; a null sorts before all others, and bytes decide."""
    return F.when(col.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), col.cast("string")))


@dataclass
class Manifest:
    leaves: DataFrame                   # tree, idx (place in its tree), id, leaf and the columns kept
    log: DataFrame                      # LOG_SCHEMA, one row per builder
    root: str | None
    levels: int = K                     # of a builder

    def tops(self) -> DataFrame:
        """(tree, subroot)."""
        return self.log.filter((F.col("tree") != TOP) & (F.col("n") <= 1 << self.levels)).select(
            "tree", F.lower(F.hex("top")).alias("subroot"))


def _segments(rows: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows that share ``key`` in sorted batches; a run may span batches."""
    now, held = None, []
    for b in rows:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_pylist() for c in key]
        keys = list(zip(*cols, strict=True))
        start = 0
        while start < len(keys):
            stop = start + 1
            while stop < len(keys) and keys[stop] == keys[start]:
                stop += 1
            if keys[start] != now:
                if held:
                    yield now, held
                now, held = keys[start], []
            held.append(b.slice(start, stop - start))
            start = stop
    if held:
        yield now, held


def _build(tier: int, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, builder, n), held in _segments(batches, ("tree", "builder", "n")):
            leaves = [d.hex() for b in held for d in b.column("digest").to_pylist()]
            log = append_log(leaves, min(levels, height(n)))
            yield pa.RecordBatch.from_pylist(
                [{"tree": tree, "tier": tier, "builder": builder, "n": n, "m": len(leaves),
                  "nodes": bytes.fromhex("".join(log)), "top": bytes.fromhex(log[-1])}],
                schema=pa.schema([("tree", pa.string()), ("tier", pa.int32()), ("builder", pa.int64()), ("n", pa.int64()),
                                  ("m", pa.int32()), ("nodes", pa.binary()), ("top", pa.binary())]))
    return run


def _tiers(rows: DataFrame, name: str, levels: int) -> list[DataFrame]:
    """Logs of all tiers over ``rows`` (tree, idx, n, digest)."""
    logs = []
    while True:
        dealt = (rows.withColumn("builder", F.shiftright("idx", levels)).repartition("tree", "builder")
                 .sortWithinPartitions("tree", "builder", "idx"))
        log = cut(dealt.select("tree", "builder", "n", "digest").mapInArrow(_build(len(logs), levels), LOG_SCHEMA), f"{name}-{len(logs)}")
        logs.append(log)
        more = log.filter(F.col("n") > 1 << levels)
        if more.isEmpty():
            return logs
        rows = more.select("tree", F.col("builder").alias("idx"), F.shiftright(F.col("n") + ((1 << levels) - 1), levels).alias("n"),
                           F.col("top").alias("digest"))


def build(rows: DataFrame, tree: F.Column, id_: F.Column, leaf: F.Column, keep: dict | None = None, levels: int = K) -> Manifest:
    """The manifest of ``rows``: columns for the tree's name, the id and the leaf's hash
    (32 bytes); ``keep`` names further columns to carry beside the leaves."""
    src = rows.select(tree_key(tree).alias("tree"), id_.cast("long").alias("id"), leaf.alias("leaf"),
                      *[c.alias(k) for k, c in (keep or {}).items()])
    numbered = ranked(src, ["tree", F.col("id").asc_nulls_first(), "leaf"], "merkle-leaves")
    starts = cut(numbered.groupBy("tree").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("n")), "merkle-trees")
    placed = numbered.join(starts, "tree").withColumn("idx", F.col("rank") - F.col("start")).drop("rank", "start")
    logs = _tiers(placed.select("tree", "idx", "n", F.col("leaf").alias("digest")), "merkle-log", levels)
    tops = [x.filter(F.col("n") <= 1 << levels).select("tree", "top") for x in logs]
    every = tops[0]
    for t in tops[1:]:
        every = every.unionByName(t)
    order = ranked(every, ["tree"], "merkle-tops")
    n = starts.count()
    logs += _tiers(order.select(F.lit(TOP).alias("tree"), F.col("rank").alias("idx"), F.lit(n).cast("long").alias("n"),
                                F.col("top").alias("digest")), "merkle-root", levels)
    log = logs[0]
    for x in logs[1:]:
        log = log.unionByName(x)
    last = logs[-1].filter(F.col("n") <= 1 << levels).select(F.lower(F.hex("top"))).first()
    return Manifest(placed, log, last[0] if last else None, levels)


def _steps(nodes: bytes, at: np.ndarray, side: np.ndarray) -> bytes:
    """Path steps as bytes: side, then the sibling (zeros if there is none)."""
    return b"".join(bytes([s]) + (nodes[32 * p:32 * p + 32] if s else bytes(32)) for p, s in zip(at.tolist(), side.tolist(), strict=True))


def _paths(levels: int):
    """(tree, idx, path) of a segment's leaves: their siblings here, then those above."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                at, side = siblings(r["m"], min(levels, height(r["n"])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["tree"]] * r["m"]), pa.array((r["builder"] << levels) + np.arange(r["m"])),
                     pa.array([_steps(r["nodes"], at[i], side[i]) + r["path"] for i in range(r["m"])], pa.binary())], ["tree", "idx", "path"])
    return run


def fold(leaf: str, path: bytes) -> tuple[str, str]:
    """(root that ``leaf`` and its path give, hash of the path's siblings)."""
    found = []
    for i in range(0, len(path), 33):
        side, other = path[i], path[i + 1:i + 33].hex()
        if side:
            found.append(other)
        leaf = digest(leaf) if not side else digest(other, leaf) if side == 1 else digest(leaf, other)
    return leaf, digest(*found)


def _prove(keep: list[str], schema: pa.Schema, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = nodes = path = at = side = None
        for (tree, builder, kind), held in _segments(batches, ("tree", "builder", "kind")):
            if kind == 0:                                     # the segment comes first
                r = held[0].slice(0, 1).to_pylist()[0]
                here, nodes, path = (tree, builder), r["nodes"], r["path"]
                at, side = siblings(r["m"], min(levels, height(r["n"])))
                continue
            if here != (tree, builder):
                raise KeyError(f"no leaves {builder << levels} and on in tree {tree!r}")
            for b in held:
                own = [i & ((1 << levels) - 1) for i in b.column("idx").to_pylist()]
                out = [fold(x.hex(), _steps(nodes, at[i], side[i]) + path) for i, x in zip(own, b.column("claim").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in keep), pa.array([f for f, _ in out], pa.string()), pa.array([p for _, p in out], pa.string())],
                    schema=schema)
    return run


def upper_paths(manifest: Manifest) -> DataFrame:
    """(tree, builder, path): for every first-tier segment the way from its top to the root."""
    log, levels = manifest.log, manifest.levels
    empty = F.lit(b"").cast("binary")

    def down(tree_filter, above: DataFrame, tier: int) -> DataFrame:
        """Paths of the leaves of the segments of ``tier`` whose own paths are ``above``."""
        segments = log.filter(tree_filter & (F.col("tier") == tier)).join(above, ["tree", "builder"])
        return segments.select("tree", "builder", "n", "m", "nodes", "path").mapInArrow(_paths(levels), "tree string, idx long, path binary")

    def tiers(tree_filter) -> int:
        return (log.filter(tree_filter).agg(F.max("tier")).first()[0] or 0) + 1

    is_top = F.col("tree") == TOP
    above = None
    for tier in reversed(range(tiers(is_top))):
        if above is None:
            above = log.filter(is_top & (F.col("tier") == tier)).select("tree", "builder", empty.alias("path"))
        above = down(is_top, above, tier).withColumnRenamed("idx", "builder")
    order = ranked(manifest.tops().select("tree"), ["tree"], "merkle-order")
    whole = cut(order.join(above.select(F.col("builder").alias("rank"), "path"), "rank").select("tree", "path"), "merkle-top-paths")
    out = None
    for tier in reversed(range(tiers(~is_top))):
        here = log.filter(~is_top & (F.col("tier") == tier))
        single = here.filter(F.col("n") <= 1 << levels).join(whole, "tree").select("tree", "builder", "path")
        out = single if out is None else single.unionByName(out)
        if tier:
            out = cut(down(~is_top, out, tier).withColumnRenamed("idx", "builder"), f"merkle-paths-{tier}")
    return out


def prove(manifest: Manifest, claims: DataFrame, claim: str = "claim") -> DataFrame:
    """``claims`` (tree, idx, ``claim``: a leaf's hash as bytes, further columns) with the
    root that the claim folds to and the hash of the proof's siblings. A claim meets its
    segment in one task; a segment holds at most 2^levels leaves."""
    keep = [c for c in claims.columns if c not in ("tree", "idx", claim)]
    types = {f.name: f.dataType for f in claims.schema.fields}
    above = upper_paths(manifest)
    none = lambda c: F.lit(None).cast(types[c]).alias(c)
    shared = ["tree", "builder", "kind", "idx", "n", "m", "nodes", "path", "claim"]
    segments = (manifest.log.filter((F.col("tree") != TOP) & (F.col("tier") == 0)).join(above, ["tree", "builder"])
                .select("tree", "builder", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("idx"), "n", "m", "nodes", "path",
                        F.lit(None).cast("binary").alias("claim"), *[none(c) for c in keep]))
    asked = claims.select("tree", F.shiftright("idx", manifest.levels).alias("builder"), F.lit(1).alias("kind"), "idx",
                          F.lit(0).cast("long").alias("n"), F.lit(0).alias("m"), F.lit(None).cast("binary").alias("nodes"),
                          F.lit(None).cast("binary").alias("path"), F.col(claim).alias("claim"), *keep)
    both = segments.unionByName(asked).select(*shared, *keep).repartition("tree", "builder").sortWithinPartitions("tree", "builder", "kind", "idx")
    schema = StructType([*(claims.schema[c] for c in keep), StructField("folded_root", StringType()), StructField("proof_sha256", StringType())])
    return both.mapInArrow(_prove(keep, to_arrow_schema(schema), manifest.levels), schema)


def save(manifest: Manifest, path: str) -> None:
    """Write the log (one row per builder) for later proofs."""
    manifest.log.write.parquet(path)


def load_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)
