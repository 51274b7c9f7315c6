"""Plan properties that matter at scale, checked on the physical plans."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from redline.operators import scoring, split, tagger

SMALL = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_language_filter_reaches_the_scan(spark):
    plan = _plan(E.queries()["corpus_clean"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,es)]" in plan


def test_sample_is_a_partial_top_n(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("pair_id"),
                                     F.when(F.col("id") % 3 == 0, "es").otherwise("en").alias("lang"))
    assert "WindowGroupLimit" in _plan(split.sample_per_group(df, 10))


def test_global_rank_never_sends_rows_to_one_partition(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("pair_id"))
    plan = _plan(split.global_rank(df))
    # the only single-partition exchange is the one over the bucket counts
    singles = [m.start() for m in re.finditer("Exchange SinglePartition", plan)]
    assert len(singles) <= 1
    assert "BroadcastHashJoin" in plan


def test_nbest_uses_group_limit_not_sort_aggregate(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 2, True, "a")],
                               "sent_id long, rank int, score double, n_tokens int, finished boolean, text string")
    plan = _plan(scoring.nbest_select(df))
    assert "WindowGroupLimit" in plan and "SortAggregate" not in plan


def test_tagger_fit_aggregates_are_hash_based(spark):
    train = spark.createDataFrame([(1, "en", ["a", "b"], ["$KEEP", "$DELETE"])],
                                  "pair_id long, lang string, src_tok array<string>, labels array<string>")
    v = spark.createDataFrame([("$KEEP", 0, 1), ("$DELETE", 1, 1)], "label string, label_id int, freq long")
    ctx = tagger.label_ids(tagger.contexts(train), v)
    counts = tagger._level_counts(ctx, materialize=False)
    best = counts["bi"].groupBy("lang", "prev", "word").agg(F.max(tagger._packed("n", "label_id")).alias("b"))
    for plan in (*[_plan(t) for t in counts.values()], _plan(best)):
        assert "Expand" not in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_no_nested_loop_or_row_python_in_registered_queries(spark):
    for name in ("eval_identity", "few_shot_prompts", "edit_table", "split_exact", "encode_seq2seq"):
        plan = _plan(E.queries()[name](spark, SMALL))
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, name
        assert "BatchEvalPython" not in plan, name
