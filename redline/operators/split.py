"""Seeded splits, samples and batches.

Every seeded order uses ``h = md5('<seed>|' || key)`` (first 8 hex digits as
BIGINT), ties by ``pair_id``; the same expression runs in DuckDB.

``global_rank`` gives every row its position in that total order without a
window over the whole table (which would pull all rows into one task): rows are
spread over ``2**bucket_bits`` hash buckets, a partial aggregation counts rows
per bucket (a table of at most ``2**bucket_bits`` rows, safe to broadcast), a
small window turns counts into offsets, and ``row_number`` runs per bucket.
The order key must be a hash of a unique key (``pair_id``) so the buckets are
uniform and no bucket can hold a hot group. Deterministic, so recomputing a
lost partition gives the same ranks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redline.functions.text import seeded_hash, tokens
from redline.plans.session import cut_lineage

SEED = 42


def hash_split(df: DataFrame, key: str = "correct", seed: int = SEED,
               buckets=((8, "train"), (1, "val"), (1, "test"))) -> DataFrame:
    """W1 (hash form, default): ``h % total`` picks the split. No shuffle; keyed
    on the correct text, so all wrong forms of a sentence share a split."""
    total = sum(w for w, _ in buckets)
    r = seeded_hash(seed, key) % total
    expr, lo = None, 0
    for w, name in buckets:
        cond = r < lo + w
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
        lo += w
    return df.withColumn("split", expr)


def _bucket_rank(x: DataFrame, order: list[str]) -> DataFrame:
    """Rank rows of ``x`` (which carries a ``_bkt`` column, buckets ordered like
    ``order``) -> adds ``_idx`` and ``_n``.

    ``x`` is stored first: the counts read one column of it, and its shuffle carries
    other columns than theirs would, so without that the input is computed twice."""
    x = cut_lineage(x, "rank-rows")
    ranked = x.withColumn("_rn", F.row_number().over(Window.partitionBy("_bkt").orderBy(*order)))
    counts = x.groupBy("_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    whole = Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_bkt", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(whole).alias("_n"))
    return (ranked.join(F.broadcast(offsets), "_bkt", "left")
            .withColumn("_idx", F.col("_off") + F.col("_rn") - 1)
            .drop("_bkt", "_off", "_rn"))


BUCKET_BITS_CONF = "redline.rank.bucketBits"


def _bucket_bits(df: DataFrame, bucket_bits: int | None) -> int:
    """Explicit value, else the session setting, else sized from the data:
    about 1 MB per bucket by Catalyst's size estimate, never fewer buckets than
    4x the cluster's parallelism, between 2^4 and 2^20. Few buckets cost
    nothing per bucket; the bounds keep every bucket window small (an unknown
    size estimate is huge and gives the maximum)."""
    if bucket_bits is None:
        conf = df.sparkSession.conf.get(BUCKET_BITS_CONF, None)
        if conf is not None:
            bucket_bits = int(conf)
        else:
            size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            cores = df.sparkSession.sparkContext.defaultParallelism
            by_size = math.ceil(math.log2(max(size, 1) / (1 << 20))) if size > (1 << 20) else 0
            by_cores = math.ceil(math.log2(4 * max(cores, 1)))
            bucket_bits = max(by_size, by_cores)
    return max(4, min(int(bucket_bits), 20))


def global_rank(df: DataFrame, seed: int = SEED, key: str = "pair_id",
                tie: str = "pair_id", bucket_bits: int | None = None) -> DataFrame:
    """Adds ``_h`` (order key), ``_idx`` (0-based rank in ``(_h, tie)`` order)
    and ``_n`` (row count)."""
    bucket_bits = _bucket_bits(df, bucket_bits)
    x = df.withColumn("_h", seeded_hash(seed, key))
    x = x.withColumn("_bkt", F.shiftright("_h", 32 - bucket_bits))
    return _bucket_rank(x, ["_h", tie])


def rank_by(df: DataFrame, col: str = "pair_id") -> DataFrame:
    """Adds ``_idx`` (0-based rank in ascending order of a unique column) and ``_n``.

    A sample sort: Spark samples the column for range bounds, so ranges are even
    whatever the values (a single outlier changes nothing), sorts each range, and
    the sorted table is written once (the bounds come from a sample, so two
    evaluations may differ). A row's rank is its place in its range plus the
    rows of the ranges before (one row per range, broadcast)."""
    t = cut_lineage(df.repartitionByRange(col).sortWithinPartitions(col)
                    .withColumn("_at", F.monotonically_increasing_id()), "rank")
    part = F.shiftright("_at", 33)
    counts = t.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_cnt"))
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
                            F.sum("_cnt").over(whole).alias("_n"))
    return (t.join(F.broadcast(offsets), part == F.col("_part"))
            .withColumn("_idx", F.col("_off") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_at", "_part", "_off"))


def exact_split(df: DataFrame, seed: int = SEED, test_size: float = 0.2,
                key: str = "pair_id") -> DataFrame:
    """W1 (exact form): scikit-learn sizes. ``ceil(test_size * n)`` rows are held
    out, ``ceil(half)`` of those are test, the rest val."""
    r = global_rank(df, seed, key)
    hold = F.ceil(F.lit(test_size) * F.col("_n"))
    n_test = F.ceil(F.lit(0.5) * hold)
    n_train = F.col("_n") - hold
    split = (F.when(F.col("_idx") < n_train, "train")
             .when(F.col("_idx") < F.col("_n") - n_test, "val").otherwise("test"))
    return r.withColumn("split", split).drop("_h", "_idx", "_n")


def ratio_split(df: DataFrame, seed: int = SEED, train_fraction: float = 0.75,
                key: str = "pair_id") -> DataFrame:
    """Shuffle, then the first ``int(train_fraction * n)`` rows are train.
    Keeps ``_h`` / ``_idx`` (the shuffled order) for W4."""
    r = global_rank(df, seed, key)
    n_train = F.floor(F.lit(train_fraction) * F.col("_n"))
    return r.withColumn("split", F.when(F.col("_idx") < n_train, "train").otherwise("test"))


SAMPLE_BITS = 16
MAX_BROADCAST_GROUPS = 1 << 20   # thresholds (one row a group) are broadcast up to here, joined beyond


def below_threshold(df: DataFrame, n: int, seed: int = SEED, group: str = "lang", key: str = "pair_id",
                    bits: int = SAMPLE_BITS) -> DataFrame:
    """The rows of each group that can be among its first ``n`` in hash order, with
    their hash ``_h``: ``n`` rows and at most one hash bucket more.

    ``df`` is read once: each task keeps its own first ``n`` rows a group (a partial
    group limit before the shuffle), and these are stored. Their counts by group and
    bucket give the threshold."""
    x = df.withColumn("_h", seeded_hash(seed, key)).withColumn("_task", F.spark_partition_id())
    own = Window.partitionBy(group, "_task").orderBy("_h", key)
    x = x.withColumn("_rn", F.row_number().over(own)).where(F.col("_rn") <= n).drop("_rn", "_task")
    x = cut_lineage(x, "sample-candidates").withColumn("_b", F.shiftright("_h", 32 - bits).cast("int"))
    counts = x.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    kept = counts.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0))).where(F.col("_before") < n)
    last = cut_lineage(kept.groupBy(F.col(group).alias("_g")).agg(F.max("_b").alias("_last")), "sample-thresholds")
    few = last.count() <= MAX_BROADCAST_GROUPS
    return x.join(F.broadcast(last) if few else last, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") <= F.col("_last"))
                  ).drop("_g", "_last", "_b")


def sample_per_group(df: DataFrame, n: int | None, seed: int = SEED,
                     group: str = "lang", key: str = "pair_id", bits: int = SAMPLE_BITS) -> DataFrame:
    """Seeded sample of at most ``n`` rows per group, without replacement.

    Threshold selection: every task's first ``n`` rows a group are counted by group
    and the first ``bits`` bits of their hash (summed map-side, at most ``2**bits``
    rows a group), the counts say in which bucket a group's ``n``-th row lies, and
    rows beyond it are dropped where they are read. Only what is left is ranked, so no task
    sees much more than ``n`` rows a group, however many rows or tasks a group has.
    ``n=None`` keeps all rows; rows of a null group are one group.
    """
    if n is None:
        return df
    below = below_threshold(df, n, seed, group, key, bits)
    w = Window.partitionBy(group).orderBy("_h", key)
    return below.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn", "_h")


def word_range(col: str, low: int = 5, high: int = 25):
    """``low < words < high``, both strict."""
    n = F.size(tokens(col))
    return (n > low) & (n < high)


def few_shot_pick(ranked: DataFrame, k: int = 3, lang: str = "en",
                  text: str = "source") -> DataFrame:
    """The first ``k`` training rows in shuffled order, one language,
    ``5 < words < 25``. Planned as TakeOrderedAndProject (top-k, no full sort)."""
    return (ranked.where((F.col("split") == "train") & (F.col("lang") == lang)
                         & word_range(text))
            .orderBy("_idx").limit(k))


def minibatches(df: DataFrame, batch_size: int, seed: int = SEED, epoch: int = 0,
                shuffle: bool = True) -> DataFrame:
    """Fixed-size batches (the last may be short). Shuffled by
    ``md5(seed|epoch|pair_id)`` when training; in ``pair_id`` order otherwise."""
    if shuffle:
        keyed = df.withColumn("_key", F.concat_ws("|", F.lit(str(epoch)), F.col("pair_id").cast("string")))
        r = global_rank(keyed, seed, "_key").drop("_key")
    else:
        r = rank_by(df, "pair_id")
    return (r.withColumn("batch", F.floor(F.col("_idx") / batch_size).cast("bigint"))
            .withColumnRenamed("_idx", "batch_pos").drop("_h", "_n"))


def expected_exact_sizes(n: int, test_size: float = 0.2) -> tuple[int, int, int]:
    """(train, val, test) sizes of the exact split, for tests."""
    hold = math.ceil(test_size * n)
    test = math.ceil(0.5 * hold)
    return n - hold, hold - test, test
