"""Prefix trie of conversations (operator 12): truncation peeling.

Each distinct sequence of a conversation's first d turns is a node at depth d; the textless
root is at depth 0. Equal conversations are merged first. Peeling then starts at the
greatest depth that two different conversations share and goes up: at each depth the
conversations that end their shared part there join the nodes that survive from below, all
are grouped by their prefix, the group's sums are the node's, and the node's last turn
is stripped so that it enters the next depth as one row. A node is found and its
subtree summed in the same grouping; every depth is written, so a lost executor costs one.

What a conversation shares with no other is a path without branches, whose nodes are
written down in closed form from running sums, however long it is. So the rounds number the
greatest shared depth, not the longest conversation.

No conversation meets in one task: turns are numbered by one distributed sort (see
``common.ranked``), prefixes are named by running 128-bit XOR sums of turn hashes,
taken over stretches of ``STRETCH`` turns whose totals are then added. (Sequences that
differ share a name with odds of 2^-128 a pair.) All groupings add up map-side. Only the
digest of a node's ended conversations is sequential by its definition: its ids stream
sorted through one task, which holds one batch.

Defined cases: a null role or text is empty; rows are ordered by turn (null first), then
role, then text; repeated rows are turns of their own; rows without a conv_id belong to no
conversation; a conversation without turns is a member of the root; extra columns (of any
name) are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from redline.llm.common import cut, ranked

STRETCH = 1024
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, pos from 1, a, b (hashes of role and text), size; conversations:
    conv_id, n)."""
    src = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn",
                      *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))).filter("conv_id is not null")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    slim = ["conv_id", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"),
            F.octet_length("text").cast("long").alias("size")]
    t = ranked(src, order, "trie-turns", [*order[:3], F.substring("text", 1, 64)], slim)
    convs = cut(t.groupBy("conv_id").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("n")), "trie-convs")
    turns = t.join(convs.select("conv_id", "start"), "conv_id").select("conv_id", (F.col("rank") - F.col("start") + 1).alias("pos"), "a", "b", "size")
    return turns, convs.drop("start")


def graft(turns: DataFrame, convs: DataFrame, block: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on shared beginnings: the first h turns of conversation
    ``c - c % block`` (none if absent), then c's own turns after its first h, with
    h = crc32(decimal c) % ``most``. Same columns as ``numbered``."""
    c = F.col("conv_id")
    plan = convs.select("conv_id", "n", (c - c % block).alias("from_id"), (F.crc32(c.cast("string")) % most).alias("h"))
    first = convs.filter(c % block == 0).select(c.alias("from_id"), F.col("n").alias("there"))
    plan = cut(plan.join(first, "from_id", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0)))).drop("there"), "trie-plan")
    heads = (turns.filter((c % block == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "from_id")
             .join(plan.filter("k > 0").select("conv_id", "from_id", "k"), "from_id").filter("pos <= k"))
    tails = turns.join(plan.select("conv_id", "h", "k"), "conv_id").filter("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("k"))
    cols = ["conv_id", "pos", "a", "b", "size"]
    return (heads.select(*cols).unionByName(tails.select(*cols)),
            plan.select("conv_id", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, n, d, size, p, q, upto): the name (p, q) of each conversation's first d
    turns and the bytes of their texts, by sums over stretches of turns."""
    t = turns.join(convs, "conv_id").select(
        "conv_id", "n", F.col("pos").alias("d"), "size", F.xxhash64("pos", "a", "b").alias("x"), F.xxhash64("b", "pos", "a").alias("y"),
        F.floor((F.col("pos") - 1) / STRETCH).alias("stretch"))
    run = Window.partitionBy("conv_id", "stretch").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    inner = t.select("conv_id", "n", "d", "size", "stretch", F.bit_xor("x").over(run).alias("p"), F.bit_xor("y").over(run).alias("q"),
                     F.sum("size").over(run).alias("upto"))
    past = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    total = t.filter(F.col("n") > STRETCH).groupBy("conv_id", "stretch").agg(
        F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("size").alias("s"))
    before = total.select("conv_id", "stretch", *(F.coalesce(f(c).over(past), F.lit(0)).alias(c)
                                                  for f, c in ((F.bit_xor, "x"), (F.bit_xor, "y"), (F.sum, "s"))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return inner.join(before, ["conv_id", "stretch"], "left").select(
        "conv_id", "n", "d", "size", F.col("p").bitwiseXOR(zero("x")).alias("p"), F.col("q").bitwiseXOR(zero("y")).alias("q"),
        (F.col("upto") + zero("s")).alias("upto"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of equal (n, p, q): smallest id, count and digest of all ids."""
    now, low, m, h = None, 0, 0, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([now[0]], pa.int64()), pa.array([m], pa.int64()),
                                           pa.array([h.hexdigest()])], ["rep", "n", "m", "ends"])
    for b in batches:
        ids = b.column("conv_id").to_pylist()
        keys = list(zip(*(b.column(c).to_pylist() for c in ("n", "p", "q")), strict=True))
        start = 0
        while start < len(ids):
            stop = start + 1
            while stop < len(ids) and keys[stop] == keys[start]:
                stop += 1
            if keys[start] != now:
                if now is not None:
                    yield row()
                now, low, m, h = keys[start], ids[start], 0, hashlib.sha256()
            h.update((("," if m else "") + ",".join(map(str, ids[start:stop]))).encode())
            m += stop - start
            start = stop
    if now is not None:
        yield row()


def sequences(named: DataFrame, convs: DataFrame) -> DataFrame:
    """(rep, n, m, ends): each distinct conversation by its smallest id, with its length, its
    number of copies and the digest of their ids."""
    whole = named.filter("d = n").select("conv_id", "n", "p", "q").unionByName(
        convs.filter("n = 0").select("conv_id", "n", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q")))
    many = whole.groupBy("n", "p", "q").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("m"))
    one = many.filter("m = 1").select("rep", "n", "m", F.sha2(F.col("rep").cast("string"), 256).alias("ends"))
    copied = whole.join(many.filter("m > 1").select("n", "p", "q"), ["n", "p", "q"], "left_semi")
    streamed = copied.repartition("n", "p", "q").sortWithinPartitions("n", "p", "q", "conv_id")
    return one.unionByName(streamed.select("conv_id", "n", "p", "q").mapInArrow(_digests, "rep long, n long, m long, ends string"))


def build(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes (``NODE``) of the conversations ``convs`` (conv_id, n) with ``turns``."""
    spark = convs.sparkSession
    named = cut(prefixes(turns, convs), "trie-prefixes")
    seqs = cut(sequences(named, convs), "trie-sequences")
    root = seqs.agg(F.min("rep")).first()[0]
    if root is None:
        return spark.createDataFrame([], NODE)
    own = named.join(seqs.select(F.col("rep").alias("conv_id"), "m"), "conv_id")
    shared = (own.groupBy("d", "p", "q").agg(F.count(F.lit(1)).alias("reps"), F.min("conv_id").alias("low"))
              .filter("reps > 1").select("d", "p", "q", "low"))
    shared = cut(shared, "trie-shared")     # a plain join can split a hot prefix
    marked = cut(own.join(shared, ["d", "p", "q"], "left").select("conv_id", "n", "m", "d", "size", "upto", "low"), "trie-marked")

    # a conversation's shared part: its nodes' names (smallest members) and text sizes by depth
    in_common = F.col("low").isNotNull()
    parts = marked.groupBy(F.col("conv_id").alias("rep")).agg(
        F.max("upto").alias("total"), F.coalesce(F.max(F.when(in_common, F.col("upto"))), F.lit(0)).alias("common"),
        F.sort_array(F.collect_list(F.when(in_common, F.struct("d", "low", "size")))).alias("chain"))
    heads = seqs.join(parts, "rep", "left").withColumn(
        "chain", F.coalesce("chain", F.expr("cast(array() as array<struct<d:bigint,low:bigint,size:bigint>>)")))
    heads = cut(heads.withColumn("u", F.size("chain")).withColumn("rest", (F.col("m") - 1) * (F.col("total") - F.col("common"))), "trie-heads")

    # the unshared ends, in closed form
    last = F.coalesce(F.get("chain", F.col("u") - 1)["low"], F.lit(root))
    ends = marked.filter(~in_common).drop("m", "n").withColumnRenamed("conv_id", "rep").join(
        heads.select("rep", "n", "m", "u", "total", "ends", last.alias("above")), "rep")
    more = (F.col("d") < F.col("n"))
    nodes = ends.select(
        F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("u") + 1, F.col("above")).otherwise(F.col("rep")).alias("parent_conv_id"),
        F.col("m").alias("n_convs"), more.cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("m") - 1) * (F.col("total") - F.col("upto") + F.col("size"))).alias("saved_tokens"),
        F.when(more, EMPTY).otherwise(F.col("ends")).alias("ends_sha256"))

    # peeling of the shared part
    whole = F.col("n") == F.col("u")
    entering = heads.select("u", "chain", F.col("m").alias("convs"), F.when(whole, 0).otherwise(1).cast("long").alias("children"),
                            F.when(whole, 0).otherwise(1).cast("long").alias("leaves"),
                            F.when(whole, F.lit(0)).otherwise(F.col("rest")).alias("saved"), F.when(whole, F.col("ends")).alias("ends"))
    survivors = None
    for d in range(heads.agg(F.max("u")).first()[0], -1, -1):
        here = entering.filter(F.col("u") == d).drop("u")
        here = here if survivors is None else here.unionByName(survivors)
        low = F.get("chain", F.lit(d - 1))["low"] if d else F.lit(root)
        size = F.get("chain", F.lit(d - 1))["size"] if d else F.lit(0)
        group = here.withColumn("conv_id", low).groupBy("conv_id").agg(
            F.sum("convs").alias("convs"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"),
            F.sum("saved").alias("saved"), F.max("ends").alias("ends"), F.first("chain").alias("chain"))
        found = cut(group.withColumn("leaves", F.greatest("leaves", F.lit(1))).withColumn("saved", F.col("saved") + (F.col("convs") - 1) * size),
                    f"trie-depth-{d}")
        above = F.lit(None).cast("long") if d == 0 else F.lit(root) if d == 1 else F.get("chain", F.lit(d - 2))["low"]
        nodes = nodes.unionByName(found.select(
            "conv_id", F.lit(d).cast("long").alias("depth"), above.alias("parent_conv_id"), F.col("convs").alias("n_convs"),
            F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
            F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256")))
        survivors = found.select(F.slice("chain", 1, max(d - 1, 0)).alias("chain"), "convs", F.lit(1).cast("long").alias("children"),
                                 "leaves", "saved", F.lit(None).cast("string").alias("ends"))
    return nodes
