"""Embedding near-duplicates (operator 11): sorted projection passes.

* A pass gives every vector a key of 64 concatenated hashes (signs of random projections
  of the direction, less the mean direction), sorts vectors by (label, key) over the
  cluster, and compares each with its next ``WINDOW`` neighbours by a blocked matrix
  product. Pairs at the threshold or nearer are verified in double precision. Links leave a
  block as a forest, never as pairs; the forests of all passes are united into components.
* How sure a row is follows from its own windows: rows that agree with it in more first
  hashes than its window's edge does were all compared. So with ``s`` hashes shared at the
  edge, a linked partner was met with at least ``(1 - angle / pi) ^ (s + 1)``, angle being
  the largest between linked vectors as seen from the mean. Passes go on, for the rows still unsure, until each has missed a partner with odds of at most
  ``MISS``. Sparse stretches need few passes, dense ones more. A row whose window
  holds nothing but its own links lies inside a group of copies, whose links are counted in
  full below. Rows unsure after ``PASSES`` passes are compared with all rows of their
  label, in blocks.
* Links are counted inside components, all of them, so a count doesn't depend on the windows.
  A component of up to ``SMALL`` vectors is one matrix product. In a larger one
  vectors are ranged by their angle to its mean: two whose angles sum to the link angle at
  most are linked (triangle inequality) and are counted by a cumulative histogram, those
  whose angles differ by more are not, and only pairs in between are compared, in tiles of
  ``TILE`` vectors spread over the tasks.

Equal vectors of a label are one vector with a count from the start.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component, or
whose label is null, links with nothing and is its own component; vectors of one label but
of different lengths don't link; rows are vectors of their own, also where they repeat an id or
are equal (equal rows link); a null id is never the smallest unless its component holds no
other, and is then kept; extra columns (of any name) are ignored; an empty table has no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from redline.llm.common import cut, ranked, release
from redline.llm.simhash import _union, connected_components

BITS, WINDOW, BLOCK = 64, 256, 2048
BATCH, PASSES, MISS = 4, 32, 1e-3       # passes a job, at most, and odds of a miss
CERTAIN = -100.0
SMALL, TILE = 256, 512
SEED = 11


def finite(v) -> F.Column:
    """The vector has a direction: no null or non-finite component, not all zero."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def with_vector(rows: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(vec_id, label, v): single precision stays as it is, anything else is doubles."""
    kept = rows.schema[vec_col].dataType.simpleString() in ("array<float>", "array<double>")
    v = F.col(vec_col) if kept else F.col(vec_col).cast("array<double>")
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))


def classes(rows: DataFrame) -> DataFrame:
    """(node, label, dim, v, m): distinct vectors of each label, numbered, with their count."""
    good = rows.filter(F.col("label").isNotNull() & finite(F.col("v")))
    one = good.groupBy("label", "v").agg(F.count(F.lit(1)).alias("m"))
    return cut(one.select(F.monotonically_increasing_id().alias("node"), "label", F.size("v").alias("dim"), "v", "m"), "embed-classes")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows in double precision, scaled by powers of two (exactly) to about one."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows a[i], b[i] in double precision."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def linked(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray, threshold: float) -> np.ndarray:
    """Which of all pairs of a and b (with their directions ua, ub) reach the threshold.
    The product of directions decides unless it is within rounding of the threshold."""
    rough = ua @ ub.T
    out = rough >= threshold
    i, j = np.nonzero(np.abs(rough - threshold) < 1e-9)
    if len(i):
        out[i, j] = cosines(a[i], b[j]) >= threshold
    return out


def _by_dim(batches: Iterator[pa.RecordBatch], of: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dims = b.column("dim").to_numpy()
        for d in np.unique(dims):
            part = b.filter(pa.array(dims == d))
            yield of(part, _matrix(part.column("v")))


def mean_directions(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Mean direction by length of vector (bounded: one vector per length in use)."""
    def run(batches):
        def sums(b, m):
            return pa.RecordBatch.from_arrays([b.column("dim").slice(0, 1), pa.array([unit(m).sum(axis=0).tolist()]), pa.array([len(m)], pa.int64())], ["dim", "s", "n"])
        return _by_dim(batches, sums)
    parts = vectors.select("dim", "v").mapInArrow(run, "dim int, s array<double>, n long")
    n = parts.groupBy("dim").agg(F.sum("n").alias("n"))
    rows = (parts.select("dim", F.posexplode("s").alias("i", "x")).groupBy("dim", "i").agg(F.sum("x").alias("x"))
            .join(n, "dim").groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("i", (F.col("x") / F.col("n")).alias("x")))).alias("s")))
    return {r["dim"]: np.array([x["x"] for x in r["s"]]) for r in rows.collect()}


def keyed(vectors: DataFrame, passes: range, mean: dict[int, np.ndarray]) -> DataFrame:
    """(pass, key, node, label, dim) of every vector, once a pass."""
    def run(batches):
        planes = {}

        def keys(b, m):
            d = m.shape[1]
            u = unit(m) - mean.get(d, 0.0)
            out = []
            for p in passes:
                if (p, d) not in planes:
                    planes[p, d] = np.random.default_rng([SEED, p, d]).normal(size=(d, BITS))
                bits = np.packbits(u @ planes[p, d] > 0, axis=1)
                # big-endian, with the first bit flipped so that signed order is the order of bits
                out.append(bits.view(">u8")[:, 0].astype(np.uint64) ^ np.uint64(1 << 63))
            times = pa.array(np.tile(np.arange(len(m)), len(out)))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(passes, np.int32), len(m))), pa.array(np.concatenate(out).view(np.int64)),
                 *(b.column(c).take(times) for c in ("node", "label", "dim"))], ["pass", "key", "node", "label", "dim"])
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                yield from _by_dim(iter([b.slice(at, 4096)]), keys)
    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("node", "label", "dim", "v").mapInArrow(run, f"pass int, key long, node long, label {label}, dim int")


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal first hashes of two keys."""
    x = a ^ b
    out = np.full(len(x), BITS, np.int64)
    some = x != 0
    y = x[some].view(np.uint64)
    high = np.zeros(len(y), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        big = y >> np.uint64(step) != 0
        high[big] += step
        y = np.where(big, y >> np.uint64(step), y)
    out[some] = BITS - 1 - high
    return out


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Whole groups of rows that share ``key`` (rows come sorted by it)."""
    held: list[pa.RecordBatch] = []
    for b in itertools.chain((x for x in batches if x.num_rows), [None]):
        if b is None:
            pieces = []
        else:
            k = b.column(key).to_numpy()
            edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
            pieces = [b.slice(i, j - i) for i, j in zip(edge[:-1], edge[1:], strict=True)]
        for piece in [*pieces, *([None] if b is None else [])]:
            if held and (piece is None or piece.column(key)[0] != held[0].column(key)[0]):
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield whole.column(key)[0].as_py(), whole
                held = []
            if piece is not None:
                held.append(piece)


def _windows(window: int, block: int, threshold: float, mean: dict[int, np.ndarray]):
    """Per block: links as a forest (kind 0: a, b), and for either edge of a row's window the
    log of the odds that the pass misses a partner beyond it (kind 1: a, pass, odds)."""
    chord = 2 * math.sin(math.acos(threshold) / 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b in _runs(batches, "block"):
            rank, node, key = (b.column(c).to_numpy() for c in ("rank", "node", "key"))
            group, part = b.column("grp").to_numpy(), b.column("pass").to_numpy()
            n = len(rank)
            last = np.r_[np.flatnonzero(group[1:] != group[:-1]), n - 1]
            end = last[np.searchsorted(last, np.arange(n))] + 1           # of each row's label
            own = int(np.searchsorted(rank, (number + 1) * block))        # the rest belong to the next block
            labels, after = np.arange(n), np.zeros(n, np.int64)           # forest; links to the window's rows after a row
            wide = np.zeros(n)                                            # largest angle to a partner, seen from the mean
            for first in np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist():
                if first >= own:
                    break
                stop = int(end[first])
                m = _matrix(b.column("v").slice(first, stop - first))
                u = unit(m)
                far = np.sqrt(((u - mean.get(m.shape[1], 0.0)) ** 2).sum(axis=1))
                wide[first:stop] = np.where(far > chord, np.arcsin(np.minimum(1.0, chord / np.maximum(far, 1e-300))), math.pi)
                for i in range(first, min(stop, own), window):
                    j, z = min(i + window, stop, own), min(i + 2 * window, stop)
                    a, c = slice(i - first, j - first), slice(i - first, z - first)
                    hit = linked(m[a], m[c], u[a], u[c], threshold)
                    off = np.arange(i, z)[None, :] - np.arange(i, j)[:, None]
                    hit &= (off > 0) & (off <= window)
                    x, y = np.nonzero(hit)
                    labels = _union(labels, x + i, y + i)
                    after[i:j] = hit.sum(axis=1)
            tied = np.flatnonzero(labels != np.arange(n))
            yield _found(0, node[tied], b=node[labels[tied]])
            # rows i and i + window of one label stand at the edges of each other's windows
            i = np.arange(max(0, min(own, n - window)))
            i = i[end[i] > i + window]
            bits = _shared_bits(key[i], key[i + window]) + 1.0
            whole = np.r_[0, np.cumsum(after == window)]                  # all links: inside a group of copies
            for at, inside in ((i, after[i] == window), (i + window, whole[i + window] - whole[i] == window)):
                odds = np.log1p(-np.minimum((1 - wide[at] / math.pi) ** bits, 1 - 1e-12))
                yield _found(1, node[at], part=part[i], odds=np.where(inside, CERTAIN, odds))
    return run


def _found(kind: int, a: np.ndarray, b: np.ndarray | None = None, part: np.ndarray | None = None, odds: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int8)), pa.array(a), pa.array(np.zeros(n, np.int64) if b is None else b),
         pa.array(np.zeros(n, np.int32) if part is None else part), pa.array(np.zeros(n) if odds is None else odds)], ["kind", "a", "b", "pass", "odds"])


def sorted_passes(vectors: DataFrame, passes: range, mean: dict, threshold: float, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(kind, a, b, pass, odds) of ``passes`` over ``vectors``; see ``_windows``. Only keys
    are sorted; vectors are joined to their places."""
    order = ["pass", "label", "dim", "key", "node"]
    t = ranked(keyed(vectors, passes, mean), order, "embed-sorted")
    t = t.select("pass", "key", "rank", "node", F.xxhash64("pass", "label", "dim").alias("grp")).join(vectors.select("node", "v"), "node")
    at = F.floor(F.col("rank") / block)
    own = t.withColumn("block", at)
    halo = t.filter((F.col("rank") >= block) & (F.col("rank") % block < window)).withColumn("block", at - 1)
    cols = ["block", "rank", "grp", "pass", "node", "key", "v"]
    dealt = own.select(*cols).unionByName(halo.select(*cols)).repartition("block").sortWithinPartitions("block", "rank")
    return dealt.mapInArrow(_windows(window, block, threshold, mean), "kind byte, a long, b long, pass int, odds double")


def _against_all(threshold: float):
    """Rows (cell, asks, node, v) sorted by cell, members first: links of the asking rows
    with the members, as a forest. Members are at most a block; asking rows stream by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in _runs(batches, "cell"):
            asks, node = b.column("asks").to_numpy(zero_copy_only=False).astype(bool), b.column("node").to_numpy()
            m = _matrix(b.column("v"))
            u = unit(m)
            held, other = np.flatnonzero(~asks), np.flatnonzero(asks)
            labels = np.arange(len(m))
            for i in range(0, len(other), 512):
                some = other[i:i + 512]
                x, y = np.nonzero(linked(m[some], m[held], u[some], u[held], threshold))
                labels = _union(labels, some[x], held[y])
            tied = np.flatnonzero(labels != np.arange(len(m)))
            yield pa.RecordBatch.from_arrays([pa.array(node[labels[tied]]), pa.array(node[tied])], ["a", "b"])
    return run


def exhaustive(asking: DataFrame, vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b): links of the ``asking`` vectors with all of their label, in cells of about
    ``block`` members and as many asking rows."""
    sizes = vectors.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    asked = asking.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).alias("turns"))
    plan = sizes.join(asked, ["label", "dim"])
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    turn = F.pmod(F.xxhash64("node"), F.col("turns"))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1)
    cell = F.xxhash64("label", "dim", "part", "turn").alias("cell")
    held = vectors.join(plan, ["label", "dim"]).select("*", part.alias("part"), F.explode(upto("turns")).alias("turn")).select(
        cell, F.lit(False).alias("asks"), "node", "v")
    ask = asking.join(plan, ["label", "dim"]).select("*", turn.alias("turn"), F.explode(upto("parts")).alias("part")).select(
        cell, F.lit(True).alias("asks"), "node", "v")
    both = held.unionByName(ask).repartition("cell").sortWithinPartitions("cell", "asks")
    return both.mapInArrow(_against_all(threshold), "a long, b long")


def find_links(vectors: DataFrame, threshold: float, window: int = WINDOW, block: int = BLOCK, batch: int = BATCH,
               most: int = PASSES, miss: float = MISS) -> list[DataFrame]:
    """Forests (a, b) whose union has the components of the linked vectors."""
    mean = mean_directions(vectors)
    forests, unsure, before = [], vectors, None
    for first in range(0, most, batch):
        passes = range(first, first + batch)
        found = cut(sorted_passes(unsure, passes, mean, threshold, window, block), f"embed-passes-{first}")
        forests.append(found.filter("kind = 0").select("a", "b"))
        # per pass the worse edge counts; a row without one was compared with all of its label
        edges = found.filter("kind = 1").groupBy(F.col("a").alias("node")).agg(
            *[F.max(F.when(F.col("pass") == p, F.col("odds"))).alias(f"p{p}") for p in passes])
        now = edges.select("node", sum((F.col(f"p{p}") for p in passes), F.lit(0.0)).alias("odds"))
        if before is not None:
            now = now.join(before.withColumnRenamed("odds", "had"), "node").select("node", (F.col("odds") + F.col("had")).alias("odds"))
        before = cut(now.filter(F.col("odds") > math.log(miss)), f"embed-unsure-{first}")
        unsure = cut(vectors.join(before.select("node"), "node", "left_semi"), f"embed-open-{first}")
        release(vectors.sparkSession)
        if unsure.isEmpty():
            return forests
    forests.append(cut(exhaustive(unsure, vectors, threshold, block), "embed-rest"))
    return forests


def _count_small(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in _runs(batches, "root"):
            m, own = _matrix(b.column("v")), b.column("m").to_numpy().astype(np.float64)
            u = unit(m)
            hit = linked(m, m, u, u, threshold)
            np.fill_diagonal(hit, True)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(np.rint(hit @ own).astype(np.int64) - 1)], ["node", "n"])
    return run


def _count_tiles(threshold: float, angle: float, bins: int):
    """Rows (cell, side, node, m, bin, v) of a tile pair: links between pairs that the bins
    leave open, counted for both (the pair of a tile with itself: once a row)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in _runs(batches, "cell"):
            side, node, bin_ = (b.column(c).to_numpy() for c in ("side", "node", "bin"))
            own = b.column("m").to_numpy().astype(np.float64)
            m = _matrix(b.column("v"))
            u = unit(m)
            x = np.flatnonzero(side == 0)
            y = np.flatnonzero(side == 1) if (side == 1).any() else x
            for i in range(0, len(x), 512):
                some = x[i:i + 512]
                hit = linked(m[some], m[y], u[some], u[y], threshold)
                hit &= bin_[some][:, None] + bin_[y][None, :] + 2 > bins          # else counted by bins
                if y is x:
                    hit[np.arange(len(some)), np.searchsorted(x, some)] = False
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(node[y]), pa.array(np.rint(own[some] @ hit).astype(np.int64))], ["node", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(np.rint(hit @ own[y]).astype(np.int64))], ["node", "n"])
    return run


def count_large(members: DataFrame, threshold: float, tile: int = TILE, bins: int = 256) -> DataFrame:
    """(node, n): linked vectors of each member (root, node, v, m) of a large component."""
    angle = math.acos(threshold)
    width = (angle - 1e-7) / bins

    def sums(batches):
        def partial(b, m):
            roots, at = np.unique(b.column("root").to_numpy(), return_inverse=True)
            s = np.zeros((len(roots), m.shape[1]))
            np.add.at(s, at, unit(m))
            return pa.RecordBatch.from_arrays([pa.array(roots), pa.array(list(s))], ["root", "s"])
        return _by_dim(batches, partial)

    def angles(batches):
        def placed(b, m):
            c = b.column("c").flatten().to_numpy().reshape(len(m), -1)
            length = np.sqrt((c * c).sum(axis=1))
            cos = np.einsum("ij,ij->i", unit(m), c) / np.where(length > 0, length, 1.0)
            at = np.floor(np.arccos(np.clip(cos, -1, 1)) / width).astype(np.int64)
            return pa.RecordBatch.from_arrays([*(b.column(x) for x in ("root", "node", "v", "m")), pa.array(at)], ["root", "node", "v", "m", "bin"])
        return _by_dim(batches, placed)
    vec = members.schema["v"].dataType.simpleString()
    sized = members.withColumn("dim", F.size("v"))
    centre = (sized.select("root", "dim", "v").mapInArrow(sums, "root long, s array<double>").select("root", F.posexplode("s").alias("i", "x"))
              .groupBy("root", "i").agg(F.sum("x").alias("x")).groupBy("root")
              .agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c")))
    centre = cut(centre, "embed-centres")
    placed = sized.join(centre, "root").select("root", "node", "dim", "v", "m", "c").mapInArrow(
        angles, f"root long, node long, v {vec}, m long, bin long")
    t = ranked(placed, ["root", "bin", "node"], "embed-shells").withColumn("tile", F.floor(F.col("rank") / tile))
    # surely linked: everything in the shells that sum to the angle with one's own
    shells = t.groupBy("root", "bin").agg(F.sum("m").alias("m"))
    upto = Window.partitionBy("root").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    inside = shells.select("root", "bin", F.sum("m").over(upto).alias("upto"))
    per = inside.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("bin", "upto"))).alias("shells"))   # at most pi / width rows
    reach = F.lit(bins - 2) - F.col("bin")
    sure = F.aggregate("shells", F.lit(0).cast("long"), lambda acc, s: F.when(s["bin"] <= reach, s["upto"]).otherwise(acc))
    by_shell = shells.select("root", "bin").join(per, "root").select("root", "bin", sure.alias("sure"))
    direct = t.join(by_shell, ["root", "bin"]).select(
        "node", F.when(2 * F.col("bin") + 2 <= bins, F.col("sure") - 1).otherwise(F.col("sure") + F.col("m") - 1).alias("n"))
    # tiles whose shells leave pairs open
    tiles = t.groupBy("root", "tile").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    one = tiles.select("root", F.col("tile").alias("x"), F.col("lo").alias("xl"), F.col("hi").alias("xh"))
    two = tiles.select("root", F.col("tile").alias("y"), F.col("lo").alias("yl"), F.col("hi").alias("yh"))
    pairs = cut(one.join(two, "root").filter((F.col("x") <= F.col("y")) & (F.col("xh") + F.col("yh") + 2 > bins) & (F.col("yl") - F.col("xh") <= bins + 1))
                .select("root", "x", "y", F.xxhash64("root", "x", "y").alias("cell")), "embed-tiles")
    cols = ["cell", "side", "node", "m", "bin", "v"]
    left = t.join(pairs.withColumnRenamed("x", "tile"), ["root", "tile"]).withColumn("side", F.lit(0)).select(*cols)
    right = t.join(pairs.filter("x < y").withColumnRenamed("y", "tile"), ["root", "tile"]).withColumn("side", F.lit(1)).select(*cols)
    open_pairs = left.unionByName(right).repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(
        _count_tiles(threshold, angle, bins), "node long, n long")
    return direct.unionByName(open_pairs).groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicates(rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
                    window: int = WINDOW, block: int = BLOCK, small: int = SMALL, tile: int = TILE, **passes) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    src = with_vector(rows, id_col, label_col, vec_col)
    vectors = classes(src)
    forests = find_links(vectors, threshold, window, block, **passes)
    links = forests[0]
    for f in forests[1:]:
        links = links.unionByName(f)
    tree = cut(connected_components(links, "embed"), "embed-tree")
    member = cut(vectors.join(tree, "node").select("root", "node", "v", "m").unionByName(
        vectors.join(tree.select(F.col("root").alias("node")).distinct(), "node").select(F.col("node").alias("root"), "node", "v", "m")), "embed-members")
    crowded = member.groupBy("root").count().filter(F.col("count") > small).select("root")
    few = member.join(crowded, "root", "left_anti").repartition("root").sortWithinPartitions("root")
    counts = few.select("root", "node", "v", "m").mapInArrow(_count_small(threshold), "node long, n long").unionByName(
        count_large(cut(member.join(crowded, "root", "left_semi"), "embed-large"), threshold, tile))
    found = cut(member.select("root", "node").join(counts, "node"), "embed-counts")
    named = cut(vectors.select("node", "label", "v", "m").join(found, "node", "left").select(
        "label", "v", F.coalesce("root", "node").alias("root"), F.coalesce("n", F.col("m") - 1).alias("n_links")), "embed-named")
    good = F.col("label").isNotNull() & finite(F.col("v"))
    own = src.filter(good).join(named, ["label", "v"]).select("vec_id", "root", "n_links")
    low = own.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    alone = src.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = own.join(low, "root").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
