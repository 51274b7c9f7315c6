"""SimHash near-duplicates (operator 8): bit-sliced comparison.

``fingerprints`` hashes word shingles into 64-bit SimHash values. ``components``
links values at ``radius`` or fewer differing bits and returns the connected
components. Only distinct values are compared, so a group of copies is one value.

* Candidates: two values within 2 bits agree on at least two of four 16-bit
  blocks, so each value goes to the six buckets of its block pairs. A bucket above
  ``HOT`` values is refined by pairs of the 8-bit quarters of the other bits: 48 bits
  are then equal, which bounds a bucket at 2^16 distinct values.
* Comparison: a bucket's values are kept as vertical bit planes (64 values per
  word). A carry-save counter adds one plane after another for 64 values at a
  time, and a word is abandoned once all its values exceed the radius.
* Links leave a bucket as a spanning forest, never as all pairs; components are
  joined across buckets by star contraction with a written table per round.

Defined cases: null or empty text has value 0, linked like any other; repeated
rows get equal results; a null doc_id is kept and is the smallest only when its
component holds no other id; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from redline.llm.common import binary_parts, bounded, cut, fresh

HOT = 4096
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
PAIRS = list(itertools.combinations(range(4), 2))


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of one UTF-8 text (ASCII lower-cased, ASCII blanks)."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, seed) for g in grams], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: id, ``text_hash`` (tells rows with one id apart), ``fp``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", 4 << 20):
            raw, off = binary_parts(b.column("text"))
            data = raw.tobytes()
            fps = np.array([simhash(data[off[i]:off[i + 1]], shingle, seed) for i in range(b.num_rows)], dtype="<u8")
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("text_hash"), pa.array(fps.view(np.int64))], ["id", "text_hash", "fp"])
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType),
                           T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])
    return src.mapInArrow(run, schema)


def _union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the pairs (a, b) into a flat forest of smallest members."""
    while True:
        ra, rb = labels[a], labels[b]
        apart = ra != rb
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            flat = labels[labels]
            if np.array_equal(flat, labels):
                break
            labels = flat


def bit_sliced_links(keys: np.ndarray, fps: np.ndarray, radius: int, chunk: int = 1 << 14) -> np.ndarray:
    """Smallest row linked (transitively) to each row; rows are grouped by key.

    The counter starts at ``2^bits - 1 - radius``, so its carry-out marks exactly
    the lanes whose distance exceeds the radius."""
    n = len(fps)
    labels = np.arange(n)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[first, n])
    end = np.repeat(first + size, size)                      # end of each row's bucket
    words = (n + 63) // 64
    padded = np.zeros(words * 64, "<u8")
    padded[:n] = fps
    planes = np.empty((64, words), np.uint64)
    for bit in range(64):
        lane = ((padded >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
        planes[bit] = np.packbits(lane, bitorder="little").view("<u8")
    rows = np.flatnonzero(end - np.arange(n) > 1)            # rows with a later row in their bucket
    span = (end[rows] - 1) // 64 - rows // 64 + 1
    bits = max(1, int(radius).bit_length())
    bias = (1 << bits) - 1 - radius
    done = 0
    while done < len(rows):
        stop = done + max(1, int(np.searchsorted(np.cumsum(span[done:done + chunk]), chunk, side="right")))
        q = np.repeat(rows[done:stop], span[done:stop])
        w = _word_index(rows[done:stop] // 64, span[done:stop])
        done = stop
        low = np.clip(q + 1 - 64 * w, 0, 64).astype(np.uint64)
        high = np.clip(end[q] - 64 * w, 0, 64).astype(np.uint64)
        over = ~(_below(high) & ~_below(low))                # lanes outside the bucket count as exceeded
        count = [np.full(len(q), FULL if bias >> i & 1 else 0, np.uint64) for i in range(bits)]
        for bit in range(64):
            mask = np.uint64(0) - ((fps[q] >> np.uint64(bit)) & np.uint64(1))
            carry = planes[bit][w] ^ mask
            for i in range(bits):
                count[i], carry = count[i] ^ carry, count[i] & carry
            over |= carry
            if bit % 8 == 7:                                 # abandon words whose lanes all exceed
                live = over != FULL
                if not live.all():
                    q, w, over = q[live], w[live], over[live]
                    count = [c[live] for c in count]
                if not len(q):
                    break
        if len(q):
            lanes = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, lane = np.nonzero(lanes)
            labels = _union(labels, q[at], 64 * w[at] + lane)
    return labels


def _word_index(start: np.ndarray, span: np.ndarray) -> np.ndarray:
    ends = np.cumsum(span)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - span), span)


def _below(n: np.ndarray) -> np.ndarray:
    """Mask of the lowest n bits, 0 <= n <= 64."""
    return np.where(n >= 64, FULL, (np.uint64(1) << np.minimum(n, np.uint64(63))) - np.uint64(1))


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_k, keep_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                k = np.r_[keep_k, batch.column("key").to_numpy()]
                f = np.r_[keep_f, batch.column("fp").to_numpy().view(np.uint64)]
                cut_at = int(np.searchsorted(k, k[-1])) if len(k) else 0   # the last bucket may go on
            else:
                k, f = keep_k, keep_f
                cut_at = len(k)
            keep_k, keep_f = k[cut_at:], f[cut_at:]
            k, f = k[:cut_at], f[:cut_at]
            if len(k):
                labels = bit_sliced_links(k, f, radius)
                linked = np.flatnonzero(labels != np.arange(len(k)))
                s = f.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s[labels[linked]]), pa.array(s[linked])], ["a", "b"])
    return run


def _field(i: int):
    """16-bit block i of ``fp``."""
    return F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))


def near_links(values: DataFrame, radius: int = 2, hot: int = HOT) -> DataFrame:
    """Links (a, b) whose transitive closure equals that of all pairs of distinct
    ``fp`` at ``radius`` <= 2 or fewer differing bits."""
    if not 0 <= radius <= 2:
        raise ValueError("block pairs find all links up to 2 bits")
    fps = values.select("fp").distinct()
    coarse = F.array(*[F.struct(F.lit(p).cast("long").alias("p"),
                                F.shiftleft(_field(i), 16).bitwiseOR(_field(j)).alias("v"))
                       for p, (i, j) in enumerate(PAIRS)])
    rows = fps.select("fp", F.inline(coarse))
    key = F.shiftleft(F.col("p"), 58).bitwiseOR(F.col("v"))
    rows = rows.withColumn("key", key)
    crowded = rows.groupBy("key").count().filter(F.col("count") > hot).select("key")
    calm = rows.join(crowded, "key", "left_anti").select("key", "fp")
    # the two blocks that a crowded bucket does not fix, as four quarters of 8 bits
    finer = []
    for p, (i, j) in enumerate(PAIRS):
        rest = [b for b in range(4) if b not in (i, j)]
        quarter = [F.shiftrightunsigned(_field(b), s).bitwiseAND(F.lit(0xFF)) for b in rest for s in (0, 8)]
        for s, (x, y) in enumerate(PAIRS):
            finer.append(F.when(F.col("p") == p, F.shiftleft(F.lit(8 + 6 * p + s).cast("long"), 56)
                                .bitwiseOR(F.shiftleft(quarter[x], 40)).bitwiseOR(F.shiftleft(quarter[y], 32))
                                .bitwiseOR(F.col("v"))))
    dense = (rows.join(crowded, "key", "left_semi")
             .select(F.explode(F.filter(F.array(*finer), lambda k: k.isNotNull())).alias("key"), "fp"))
    buckets = calm.unionByName(dense).repartition("key").sortWithinPartitions("key", "fp")
    return buckets.mapInArrow(_bucket_links(radius), "a long, b long")


def connected_components(links: DataFrame, name: str = "cc", max_rounds: int = 50) -> DataFrame:
    """(node, root) of every linked node; root is the component's smallest node.

    Alternating large-star and small-star contraction; each round is written, so
    a lost executor costs one round at most."""
    edges = (links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .filter("u <> v").distinct())
    edges = cut(edges, f"{name}-0")
    state = None
    for i in range(1, max_rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = cut(small, f"{name}-{i}")
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        now = (row["n"], row["s"])
        if now == state or now[0] == 0:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(prints: DataFrame, radius: int = 2, hot: int = HOT) -> DataFrame:
    """``prints`` (id, text_hash, fp) with ``root`` (a value of the component)
    and ``component_id`` (its smallest id). Read ``prints`` from a written table:
    it is scanned three times."""
    values = prints.groupBy("fp").agg(F.min("id").alias("low"))
    tree = connected_components(near_links(values, radius, hot), "simhash")
    labelled = (values.join(tree, values["fp"] == tree["node"], "left")
                .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    named = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = labelled.select("fp", "root").join(named, "root")
    return prints.join(classes, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """id, text_hash, fp, root, component_id for every row of ``docs``."""
    return components(cut(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints"), radius)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component the row with
    the smallest (id, text hash) stays; of equal rows, one. All columns stay."""
    found = near_duplicates(docs, id_col, text_col, **params)
    best_id, best_hash, text_hash, copy = fresh(docs, "best_id", "best_hash", "text_hash", "copy")
    best = (found.groupBy("root").agg(F.min(F.struct("id", "text_hash")).alias("best"))
            .select(F.col("best.id").alias(best_id), F.col("best.text_hash").alias(best_hash)).distinct())
    marked = docs.withColumn(text_hash, F.xxhash64(text_col))
    kept = marked.join(best, marked[id_col].eqNullSafe(best[best_id]) & (marked[text_hash] == best[best_hash]), "left_semi")
    order = Window.partitionBy(id_col, text_hash).orderBy(F.xxhash64(*docs.columns))
    return kept.withColumn(copy, F.row_number().over(order)).filter(F.col(copy) == 1).select(*docs.columns)
