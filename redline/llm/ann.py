"""Approximate nearest neighbours (operator 6): hierarchical k-means tree with
best-bin-first search.

The tree is fitted on at most ``SAMPLE_BYTES`` of distinct vectors chosen by hash; every
distinct vector is then indexed in its leaf. A query walks the tree with a priority
queue over the similarity to the nodes' centres and visits leaves best first. The number
of leaves is widened until the calibration queries (at most ``CALIBRATE``, measured
against brute force over all vectors) reach ``RECALL`` of their true neighbours.

Every row takes part on its own, also where rows repeat an id: a query's own row alone is no
candidate. Equal vectors are one entry with the ``k + 1`` rows of smallest ids: ties go to smaller ids, so
no other row of the group can be among a query's k nearest. Vectors of different lengths have no
cosine: each length that holds a query is indexed and searched by itself. A leaf of more than
``LEAF_BLOCK`` entries is split into blocks by hash, each searched on its own; a
task holds one block and streams the queries that visit it.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component
take no part; a query whose vector has a length of its own has no result; each row that
repeats an id is a query and a candidate of its own (equal vectors of one id: the earlier
row comes first); a null id takes no part; extra columns are ignored; with fewer candidates
than k all are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from redline.llm.common import cut

SAMPLE_BYTES, SAMPLE_ROWS = 16 << 20, 16_384
BRANCH, LEAF_ROWS, LEAF_BLOCK = 12, 48, 4096
CALIBRATE, RECALL = 200, 0.97


def valid(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): every row that takes part, ``v`` in double precision."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


class Tree:
    """Nodes in breadth order: ``centre``, ``children`` (empty at leaves), ``leaf`` number."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.children: list[np.ndarray] = []
        centres, todo = [_unit_or_zero(sample.mean(axis=0))], [sample]
        at = 0
        while at < len(todo):
            rows = todo[at]
            kids = []
            if len(rows) > leaf_rows:
                groups = _kmeans(rows, branch, rng)
                if len(groups) > 1:
                    for centre, part in groups:
                        kids.append(len(todo))
                        todo.append(part)
                        centres.append(centre)
            self.children.append(np.array(kids, np.int64))
            todo[at] = None
            at += 1
        self.centre = np.array(centres)
        self.leaf = np.full(len(centres), -1)
        ends = [i for i, c in enumerate(self.children) if not len(c)]
        self.leaf[ends] = np.arange(len(ends))
        self.leaves = len(ends)

    def assign(self, unit: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child at every level."""
        node = np.zeros(len(unit), np.int64)
        while True:
            open_nodes = [n for n in np.unique(node) if len(self.children[n])]
            if not open_nodes:
                return self.leaf[node]
            for n in open_nodes:
                rows = np.flatnonzero(node == n)
                kids = self.children[n]
                node[rows] = kids[np.argmax(unit[rows] @ self.centre[kids].T, axis=1)]

    def best_bins(self, unit: np.ndarray, leaves: int, weight: np.ndarray, least: int) -> list[list[int]]:
        """Per query the first ``leaves`` leaves, best bin first; more while those hold
        under ``least`` vectors."""
        near = unit @ self.centre.T
        out = []
        for sims in near:
            heap, seen, got = [(-sims[0], 0)], [], 0
            while heap and (len(seen) < leaves or got < least):
                _, node = heapq.heappop(heap)
                kids = self.children[node]
                if len(kids):
                    for c in kids:
                        heapq.heappush(heap, (-sims[c], int(c)))
                elif weight[self.leaf[node]]:
                    seen.append(int(self.leaf[node]))
                    got += int(weight[self.leaf[node]])
            out.append(seen)
        return out


def _unit_or_zero(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum())
    return v / n if n > 0 else v


def _kmeans(rows: np.ndarray, k: int, rng, rounds: int = 8) -> list[tuple[np.ndarray, np.ndarray]]:
    centre = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(rows @ centre.T, axis=1)
        centre = np.array([_unit_or_zero(rows[near == j].sum(axis=0)) if (near == j).any() else centre[j] for j in range(len(centre))])
    near = np.argmax(rows @ centre.T, axis=1)
    return [(centre[j], rows[near == j]) for j in range(len(centre)) if (near == j).any()]


def _rows_of(column: pa.Array) -> list[list[tuple[int, int]]]:
    """The (id, row) pairs of each entry."""
    return [[(x["id"], x["row"]) for x in own] for own in column.to_pylist()]


def _top(qid: np.ndarray, q: np.ndarray, c: np.ndarray, ids: list[list[tuple[int, int]]], keep: int) -> list[tuple[int, int, int, float]]:
    """(qid, id, row, score) of each query's ``keep`` nearest rows among the entries."""
    qn, cn = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
    out = []
    rough = (q / qn[:, None]) @ (c / cn[:, None]).T
    for i in range(len(q)):
        row = rough[i]
        bar = np.partition(row, -keep)[-keep] - 1e-9 if len(row) > keep else -2.0
        some = np.flatnonzero(row >= bar)
        exact = np.einsum("ij,j->i", c[some], q[i]) / (cn[some] * qn[i])
        found = sorted((-s, x) for s, j in zip(exact.tolist(), some.tolist(), strict=True) for x in ids[j])
        out += [(int(qid[i]), *x, -s) for s, x in found[:keep]]
    return out


def _pairs_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      ["qid", "id", "row", "score", "leaf"])


PAIRS = "qid long, id long, row long, score double, leaf int"
ROWS = "array<struct<id:long,row:long>>"


class Index:
    """Every distinct vector in its leaf (``entries``), the tree and its leaf sizes."""

    def __init__(self, tree: Tree, entries: DataFrame, weight: np.ndarray):
        self.tree, self.entries, self.weight = tree, entries, weight
        self.blocks = np.maximum(1, -(-weight // LEAF_BLOCK))


def build(vectors: DataFrame, k: int = 5) -> Index | None:
    """Index all (id, row, v), vectors of one length; ``row`` tells rows apart. None if there are none."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id", "row"))
    entries = (vectors.withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy("v")
               .agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("ids")).withColumn("h", F.xxhash64("v")))
    entries = cut(entries, "ann-entries")
    some = entries.select(F.size("v")).first()
    if some is None:
        return None
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * some[0])))
    sample = entries.orderBy("h", F.col("ids")[0]["row"]).limit(most).select("v").toArrow()["v"].combine_chunks()
    tree = Tree(_unit(_matrix(sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = tree.assign(_unit(_matrix(b.column("v"))))
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), b.column("h"), b.column("v"), b.column("ids")],
                                                 ["leaf", "h", "v", "ids"])
    placed = cut(entries.select("h", "v", "ids").mapInArrow(run, f"leaf int, h long, v array<double>, ids {ROWS}"), "ann-index")
    weight = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():               # one row per leaf of the tree
        weight[r["leaf"]] = r["count"]
    return Index(tree, placed, weight)


def calibrate(index: Index, queries: DataFrame, k: int = 5, target: float = RECALL, most: int = CALIBRATE) -> int:
    """Leaves to visit: the fewest that hold ``target`` of the true neighbours of at
    most ``most`` queries (qid, v); ``qid`` is the query's row."""
    some = queries.orderBy(F.xxhash64("qid"), "qid").limit(most).toArrow()
    if not some.num_rows:
        return 1
    qid, q = some["qid"].to_numpy(), _matrix(some["v"].combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = _rows_of(b.column("ids"))
                leaf = {row: int(n) for i, n in zip(ids, b.column("leaf").to_pylist(), strict=True) for _, row in i}
                yield _pairs_batch([(*r, leaf[r[2]]) for r in _top(qid, q, _matrix(b.column("v")), ids, k + 1)])
    true = index.entries.mapInArrow(run, PAIRS).filter("qid <> row")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id", "row")
    true = true.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("qid", "leaf").collect()
    if not true:
        return 1
    bins = index.tree.best_bins(_unit(q), index.tree.leaves, index.weight, 0)
    place = {int(a): {leaf: i for i, leaf in enumerate(b, 1)} for a, b in zip(qid, bins, strict=True)}
    need = sorted(place[r["qid"]][r["leaf"]] for r in true)
    return need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)]


def search(index: Index, queries: DataFrame, leaves: int, k: int = 5) -> DataFrame:
    """(qid, id, row, score): up to k + 1 nearest rows per query vector (qid, v), found in
    the ``leaves`` best bins."""
    tree, weight, blocks = index.tree, index.weight, index.blocks
    b_ids = pa.list_(pa.struct([("id", pa.int64()), ("row", pa.int64())]))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                bins = tree.best_bins(_unit(_matrix(b.column("v"))), leaves, weight, k + 1)
                rows = [(i, n, x) for i, own in enumerate(bins) for n in own for x in range(int(blocks[n]))]
                take, leaf, block = (np.array(c) for c in zip(*rows, strict=True))
                take = pa.array(take)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf.astype(np.int32)), pa.array(block.astype(np.int64)), pa.array(np.ones(len(leaf), np.int8)),
                     b.column("qid").take(take), b.column("v").take(take), pa.nulls(len(leaf), b_ids)],
                    ["leaf", "block", "kind", "qid", "v", "ids"])
    schema = f"leaf int, block long, kind byte, qid long, v array<double>, ids {ROWS}"
    asked = queries.select("qid", "v").mapInArrow(route, schema)
    sizes = F.array(*[F.lit(int(n)) for n in blocks]) if int(blocks.max()) > 1 else None
    block = F.pmod("h", F.element_at(sizes, F.col("leaf") + 1).cast("long")) if sizes is not None else F.lit(0).cast("long")
    held = index.entries.select("leaf", block.alias("block"), F.lit(0).cast("byte").alias("kind"), F.lit(0).cast("long").alias("qid"), "v", "ids")
    both = held.unionByName(asked).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, c, ids = None, [], []                                    # the block at hand
        for b in batches:
            leaf, blk, kind = (b.column(n).to_numpy() for n in ("leaf", "block", "kind"))
            edge = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (blk[1:] != blk[:-1]) | (kind[1:] != kind[:-1]), True]) if len(leaf) else [0]
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                part, here = b.slice(a, z - a), (int(leaf[a]), int(blk[a]))
                if here != now:
                    now, c, ids = here, [], []
                if kind[a] == 0:
                    c.append(_matrix(part.column("v")))
                    ids += _rows_of(part.column("ids"))
                elif c:
                    c = [np.concatenate(c)]
                    q, qid = _matrix(part.column("v")), part.column("qid").to_numpy()
                    for i in range(0, len(q), 512):
                        yield _pairs_batch([(*r, now[0]) for r in _top(qid[i:i + 512], q[i:i + 512], c[0], ids, k + 1)])
    found = both.mapInArrow(scan, PAIRS)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).select("qid", "id", "row", "score")


def nearest(rows: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            target: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row for which
    ``is_query(id column)`` holds. One index per vector length that has a query."""
    vectors = cut(valid(rows, id_col, vec_col).withColumn("row", F.monotonically_increasing_id()), "ann-vectors")
    lengths = vectors.filter(is_query(F.col("id"))).select(F.size("v").alias("d")).distinct().collect()   # one row per length
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d in sorted(r["d"] for r in lengths):
        out = out.unionByName(_nearest(vectors.filter(F.size("v") == d), is_query, k, target))
    return out


def _nearest(vectors: DataFrame, is_query, k: int, target: float) -> DataFrame:
    index = build(vectors, k)
    asked = vectors.filter(is_query(F.col("id")))
    # equal query vectors are searched once
    distinct = cut(asked.groupBy("v").agg(F.min("row").alias("qid")), "ann-queries")
    hits = search(index, distinct, calibrate(index, distinct, k, target), k)
    own = asked.join(distinct, "v").select(F.col("id").alias("query_id"), F.col("row").alias("own"), "qid")
    order = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id", "row")
    return (own.join(hits.withColumnRenamed("id", "vec_id"), "qid").filter("row <> own")
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
