"""Label counts, label vocabulary and id lookups.

``label_counts`` is one hash aggregation with map-side partial aggregation:
``$KEEP`` dominates the edit table, but only one partial row per label and task
crosses the shuffle, never the raw edits. The vocabulary is then a top-K of a
table with one row per distinct label (``TakeOrderedAndProject``), and it is
at most ``top_k + 2`` rows, which is the size bound that makes the broadcast
lookups (J2, J3) safe.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redline.operators.edits import DELETE, KEEP
from redline.plans.session import cut_lineage

TOP_K = 5000
FIXED = (KEEP, DELETE)


def label_counts(edits: DataFrame) -> DataFrame:
    """A3: ``label, freq, first_pair, first_pos`` (first occurrence in pair order)."""
    # The first occurrence is packed into one DECIMAL(38,0) (pair ids up to 2^63,
    # positions below 2^31), whose minimum stays in the hash aggregation.
    at = F.col("pair_id").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos")
    counts = edits.groupBy("label").agg(F.count(F.lit(1)).alias("freq"), F.min(at.cast("decimal(38,0)")).alias("_first"))
    pos = F.expr(f"pmod(_first, cast({1 << 31} as decimal(10,0)))")
    return counts.withColumn("first_pos", pos.cast(edits.schema["pos"].dataType)).select(
        "label", "freq",
        F.expr(f"(_first - first_pos) div {1 << 31}").alias("first_pair"), "first_pos")


def label_vocab(edits_or_counts: DataFrame, top_k: int = TOP_K, materialize: bool = True) -> DataFrame:
    """A4 + W5 + W6 + T10: ``label, label_id, freq``.

    The top-K cut is taken with KEEP/DELETE included; they are then removed and
    put first as ids 0 and 1. The rest get ids from 2 in (freq desc, first
    seen) order, as ``Counter.most_common`` orders ties by first insertion.
    """
    counts = edits_or_counts if "freq" in edits_or_counts.columns else label_counts(edits_or_counts)
    if materialize:
        # one row per distinct label, read by the top-K and the fixed-label
        # branches: stored once so the edits (and their alignment) are not
        # computed twice
        counts = cut_lineage(counts, "label-counts")
    top = counts.orderBy(F.desc("freq"), "first_pair", "first_pos").limit(top_k)
    rest = top.where(~F.col("label").isin(*FIXED))
    # The ranked table holds at most top_k rows: a window without partition is bounded.
    w = Window.orderBy(F.desc("freq"), "first_pair", "first_pos")
    ranked = rest.select("label", (F.row_number().over(w) + 1).alias("label_id"), "freq")
    # KEEP / DELETE frequencies from a one-row conditional aggregate over the
    # same counts: nothing can be pushed below it, so this branch shares the
    # counts' shuffle instead of re-reading (and re-aligning) the edits
    ff = counts.agg(F.max(F.when(F.col("label") == KEEP, F.col("freq"))).alias("k"),
                    F.max(F.when(F.col("label") == DELETE, F.col("freq"))).alias("d"))
    fixed = ff.select(F.inline(F.array(
        F.struct(F.lit(KEEP).alias("label"), F.lit(0).alias("label_id"),
                 F.coalesce("k", F.lit(0)).cast("bigint").alias("freq")),
        F.struct(F.lit(DELETE).alias("label"), F.lit(1).alias("label_id"),
                 F.coalesce("d", F.lit(0)).cast("bigint").alias("freq")))))
    return fixed.unionByName(ranked.select("label", F.col("label_id").cast("int"), "freq"))


def label_vocab_by(edits: DataFrame, group: str = "lang", top_k: int = TOP_K, materialize: bool = True) -> DataFrame:
    """S6 + A4: one vocabulary per ``group`` in one job: ``group, label, label_id,
    freq``, each with its own top-K cut and its own ids from 2.

    Labels are counted by group map-side. The cut is a partial group limit
    (each task keeps a heap of ``top_k`` labels a group) before its shuffle, so a
    group's final rank sees at most ``top_k`` rows a task."""
    at = F.col("pair_id").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos")
    counts = edits.groupBy(group, "label").agg(F.count(F.lit(1)).alias("freq"), F.min(at.cast("decimal(38,0)")).alias("_first"))
    if materialize:
        counts = cut_lineage(counts, "label-counts-by")
    order = Window.partitionBy(group).orderBy(F.desc("freq"), "_first")
    top = counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top_k)
    rest = top.where(~F.col("label").isin(*FIXED)).withColumn("_r", F.row_number().over(order) + 1)
    none = F.lit(0).cast("bigint")
    fixed = counts.groupBy(group).agg(
        *[F.coalesce(F.max(F.when(F.col("label") == x, F.col("freq"))), none).alias(f"_{i}") for i, x in enumerate(FIXED)])
    fixed = fixed.select(group, F.inline(F.array(*[F.struct(F.lit(x).alias("label"), F.lit(i).alias("label_id"), F.col(f"_{i}").alias("freq"))
                                                   for i, x in enumerate(FIXED)])))
    return fixed.unionByName(rest.select(group, "label", F.col("_r").cast("int").alias("label_id"), "freq"))


#: A vocabulary is broadcast up to so many rows (some 100 MB), joined beyond.
MAX_BROADCAST = 1 << 20


def _small(vocab: DataFrame, top_k: int | None) -> DataFrame:
    """``vocab`` with a broadcast hint if its bound allows it. One that holds a group
    column has ``top_k + 2`` rows a group, and groups have no bound: Spark's
    own size estimate decides."""
    grouped = "lang" in vocab.columns
    return vocab if grouped or (top_k or 0) + 2 > MAX_BROADCAST else F.broadcast(vocab)


def label_ids(edits: DataFrame, vocab: DataFrame, top_k: int | None = None) -> DataFrame:
    """Label -> id, out-of-vocabulary -> ``$KEEP`` (0). A vocabulary per
    language (with a ``lang`` column) is looked up by language. One vocabulary has
    ``top_k + 2`` rows and is broadcast up to ``MAX_BROADCAST``."""
    keys = ["lang", "label"] if "lang" in vocab.columns else ["label"]
    v = _small(vocab.select(*keys, "label_id"), top_k)
    return edits.join(v, keys, "left").withColumn(
        "label_id", F.coalesce("label_id", F.lit(0)))


def label_id_arrays(labels, vocab: DataFrame) -> Column:
    """J2 on an ``array<string>`` of labels: ``array<int>``, out-of-vocabulary ->
    ``$KEEP`` (0). The words of a sentence stay together: none is a row of a join.
    ``vocab`` (one for all languages, ``top_k + 2`` rows) is read when this is called."""
    rows = vocab.select("label", "label_id").collect()
    known, ids = pa.array([r.label for r in rows], pa.string()), pa.array([r.label_id for r in rows], pa.int32())

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def look_up(a: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(a), 0)
        ends = pc.cumulative_sum(size).cast(pa.int32())
        starts = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        found = pc.fill_null(pc.take(ids, pc.index_in(a.flatten(), value_set=known)), 0)
        return pa.ListArray.from_arrays(starts, found, mask=pc.is_null(a))
    return look_up(labels)


def id_labels(ids: DataFrame, vocab: DataFrame, id_col: str = "label_id", top_k: int | None = None) -> DataFrame:
    """Id -> label, unknown id -> ``$KEEP``; by language for a vocabulary per language."""
    keys = ["lang", id_col] if "lang" in vocab.columns else [id_col]
    v = _small(vocab.withColumnRenamed("label_id", id_col).select(*keys, "label"), top_k)
    return ids.join(v, keys, "left").withColumn("label", F.coalesce("label", F.lit(KEEP)))
