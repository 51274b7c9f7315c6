"""Joins and partitions that stand a few very heavy keys or rows.

``split_join`` answers the keys that hold a large share of the rows from a
bounded table (broadcast) and joins only the others: heavy rows still pass through
the shuffle, but under a spread key, so no task gets more than its share.

``heavy_keys`` bounds that table by arithmetic: at most ``1 / share`` keys can hold
``share`` of the total weight each.

``pack`` deals rows out by cost instead of by number: rows that cost a large
part of a partition are placed first, largest to the emptiest, and the rest fill
up what is left of each partition.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redline.plans.session import cut_lineage

SHARE = 1 / 512
SPREAD = 4096


def heavy_keys(counts: DataFrame, weight: str, share: float = SHARE, total=None) -> DataFrame:
    """Rows of ``counts`` (one per key) that hold at least ``share`` of all
    ``weight``: at most ``1 / share`` rows, whatever the input. ``total`` is the sum
    of all ``weight`` where the caller has it cheaper."""
    if total is None:
        total = counts.select(F.sum(weight).cast("double")).scalar()
    return counts.where(F.col(weight) >= total * F.lit(share))


def split_join(rows: DataFrame, table: DataFrame, keys: list[str], value: str,
               heavy: DataFrame, spread_by: list[str]) -> DataFrame:
    """``rows`` left-joined with ``table`` (``keys`` + ``value``, one row per key).

    ``heavy`` (``keys`` + ``value``; bounded) answers its keys, with null where
    the table has no row for them. The last key must be a string; rows that
    ``heavy`` answered go through the join under that key spread by a hash of
    ``spread_by``, where they meet nothing."""
    last = keys[-1]
    h = F.broadcast(heavy.select(*[F.col(k).alias(f"_h_{k}") for k in keys],
                                 F.col(value).alias("_h_value"), F.lit(True).alias("_h_hit")))
    on = [rows[k] == F.col(f"_h_{k}") for k in keys]
    x = rows.join(h, on, "left").drop(*[f"_h_{k}" for k in keys])
    away = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*spread_by), F.lit(SPREAD)).cast("string"))
    x = x.withColumn("_j", F.when(F.col("_h_hit"), away).otherwise(F.col(last)))
    t = table.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col(value).alias("_t_value"))
    joined = x.join(t, [*[F.col(k) == F.col(f"_t_{k}") for k in keys[:-1]], F.col("_j") == F.col(f"_t_{last}")], "left")
    picked = F.when(F.col("_h_hit"), F.col("_h_value")).otherwise(F.col("_t_value"))
    return joined.withColumn(value, picked).drop("_j", "_h_value", "_h_hit", "_t_value", *[f"_t_{k}" for k in keys])


def pack(df: DataFrame, cost, key: str = "pair_id", parts: int | None = None) -> DataFrame:
    """``df`` dealt into ``parts`` partitions of near equal summed ``cost``.

    One aggregation gives the total; rows that cost more than an eighth of a
    partition's share (at most ``8 * parts`` of them) are dealt largest first to the
    emptiest partition. All others choose a slot by a hash of ``key``, and slots
    are handed out by what each partition has left."""
    spark = df.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    costs = cut_lineage(df.select(key, cost.cast("double").alias("_cost")), "costs")
    total = costs.agg(F.sum("_cost")).first()[0] or 0.0
    large = [(r[key], r["_cost"]) for r in costs.where(F.col("_cost") > total / (8 * parts)).collect()] if total else []
    costed = df
    bins = [(0.0, p) for p in range(parts)]
    place = {}
    for k, c in sorted(large, key=lambda r: (-r[1], r[0])):
        used, p = heapq.heappop(bins)
        place[k] = p
        heapq.heappush(bins, (used + c, p))
    load = {p: used for used, p in bins}
    left = _level(load, total - sum(c for _, c in large))
    slots, at = [], 0.0
    for p in range(parts):                                    # slot s belongs to the partition its share covers
        at += left[p] * SPREAD
        slots += [p] * (min(SPREAD, round(at)) - len(slots))
    slots += [max(left, key=left.get)] * (SPREAD - len(slots))
    slot = F.element_at(F.array(*[F.lit(p) for p in slots]), (F.pmod(F.xxhash64(key), F.lit(SPREAD)) + 1).cast("int"))
    if place:
        named = spark.createDataFrame(list(place.items()), T.StructType([T.StructField(key, df.schema[key].dataType),
                                                                         T.StructField("_place", T.IntegerType())]))
        costed = costed.join(F.broadcast(named), key, "left")  # at most 8 * parts rows
        slot = F.coalesce("_place", slot)
    return costed.withColumn("_part", slot).repartitionById(parts, "_part").select(*df.columns)


def _level(load: dict[int, float], rest: float) -> dict[int, float]:
    """Shares of ``rest`` that fill partitions with ``load`` up to one level."""
    if rest <= 0:
        return {p: 1 / len(load) for p in load}
    order = sorted(load.values())
    level, below = order[0], 0.0
    for i, x in enumerate(order):
        level = (rest + below + x) / (i + 1)
        below += x
        if i + 1 == len(order) or level <= order[i + 1]:
            break
    return {p: max(0.0, level - x) / rest for p, x in load.items()}
