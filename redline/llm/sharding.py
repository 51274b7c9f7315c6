"""Sharding over fixed virtual slots (operator 3), DataFrame functions only.

Records hash into ``SLOTS`` virtual slots by id and content. Bytes are summed per slot, and a
versioned table maps slots to shards: version 1 deals slots out largest first, each
to the shard with the fewest bytes so far; ``rebalance`` edits the latest version,
moving only the slots that a shard holds beyond its share. Every version lists all
``SLOTS`` slots, empty ones too, so records that come later have a shard. The map has
``SLOTS`` rows whatever the input, so it is broadcast and folded in one row.

The law is ``bytes``: shard sizes are near equal (they differ by less than the
largest slot, in practice far less).

A slot is drawn by id and text. Records of equal text thus needn't share a shard; under
the law ``bytes`` only sizes decide, and a large group of copies is spread.

Defined cases: a null text has size 1 and CRC 0; fully equal rows share a slot; a
null id is hashed like any value; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOTS = 4096
MAP_SCHEMA = "version int, vslot int, shard int, bytes long"


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of every row; texts are not carried on."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash")).withColumn(
        "vslot", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(slots)).cast("int"))


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, n) of every slot, those without records too."""
    held = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    none = F.lit(0).cast("long")
    return every.join(held, "vslot", "left").select("vslot", F.coalesce("bytes", none).alias("bytes"), F.coalesce("n", none).alias("n"))


def _deal(slots: DataFrame, shards: int, load=None) -> DataFrame:
    """(vslot, shard, bytes): slots largest first to the lightest shard. ``load`` (a
    one-row frame with an array) holds the bytes that shards already have."""
    ordered = slots.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "vslot"))).alias("todo"))
    if load is None:
        ordered = ordered.withColumn("load", F.array_repeat(F.lit(0).cast("long"), shards))
    else:
        ordered = ordered.crossJoin(F.broadcast(load))       # one row by one row

    def step(state, item):
        at = F.array_position(state["load"], F.array_min(state["load"])).cast("int")
        grown = F.transform(state["load"], lambda x, i: F.when(i + 1 == at, x - item["neg"]).otherwise(x))
        return F.struct(grown.alias("load"),
                        F.concat(state["out"], F.array(F.struct(item["vslot"].alias("vslot"), (at - 1).alias("shard"),
                                                                (-item["neg"]).alias("bytes")))).alias("out"))
    start = F.struct(F.col("load"), F.expr("cast(array() as array<struct<vslot:int,shard:int,bytes:bigint>>)").alias("out"))
    return ordered.select(F.inline(F.aggregate("todo", start, step, lambda s: s["out"])))


def first_map(slots: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the slot-to-shard map."""
    return _deal(slots, shards).select(F.lit(1).alias("version"), "vslot", "shard", "bytes")


def rebalance(current: DataFrame, slots: DataFrame, shards: int) -> DataFrame:
    """Next version of the map for the slots' present bytes and ``shards`` shards.
    Each shard keeps slots, largest first, up to its equal share of the bytes; only the
    others (and those of shards that are gone, and new slots) move."""
    now = slots.select("vslot", "bytes").join(F.broadcast(current.select("vslot", "shard")), "vslot", "left")
    share = now.agg((F.sum("bytes") / F.lit(shards)).alias("share"))
    run = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    placed = (now.crossJoin(F.broadcast(share))              # the share is one row
              .withColumn("upto", F.sum("bytes").over(run))
              .withColumn("stays", F.col("shard").isNotNull() & (F.col("shard") < shards) & (F.col("upto") <= F.col("share"))))
    kept = placed.filter("stays").select("vslot", "shard", "bytes")
    per = kept.groupBy("shard").agg(F.sum("bytes").alias("b"))
    load = per.agg(F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("m")).select(
        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("load"))
    moved = _deal(placed.filter(~F.col("stays")).select("vslot", "bytes"), shards, load)
    version = current.agg((F.max("version") + 1).alias("version"))
    return (kept.unionByName(moved).crossJoin(F.broadcast(version))
            .select("version", "vslot", "shard", "bytes"))


def save_map(version: DataFrame, path: str) -> None:
    """Add a version to the stored map (earlier versions stay)."""
    version.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version; the latest if none is given."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == version).select("version", "vslot", "shard", "bytes")


def place(rows: DataFrame, version: DataFrame) -> DataFrame:
    """Each record with its ``shard`` and ``slot``, its place in the shard (gapless
    from 0): the rank inside its virtual slot plus the rows of the shard's earlier slots.
    Any version of the map serves; a slot that it doesn't list is an error."""
    known = version.select("vslot", F.col("shard").alias("on"))
    sizes = rows.groupBy("vslot").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(known), "vslot", "left").withColumn(
        "shard", F.when(F.col("on").isNotNull(), F.col("on")).otherwise(
            F.raise_error(F.concat(F.lit("no shard for slot "), F.col("vslot").cast("string"))).cast("int")))
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("vslot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "text_hash")
    return (rows.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(offsets), "vslot")
            .withColumn("slot", (F.col("base") + F.col("rank") - 1).cast("long")))
