"""The fit stores its counts once, in buckets, and its levels need no further shuffle."""

import re

import pytest
from pyspark.sql import functions as F

from redline.operators import edits, tagger, vocab
from redline.plans.session import cut_lineage


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _fitted(spark, rows):
    train = cut_lineage(edits.with_labels(spark.createDataFrame(
        rows, "pair_id long, lang string, incorrect string, correct string")).select("pair_id", "lang", "src_tok", "labels"))
    return train, tagger.fit(train, vocab.label_vocab(vocab.label_counts(edits.edit_table(train))))


ROWS = [(i, "en" if i % 3 else "es", w, c) for i, (w, c) in enumerate(
    [("he go home", "he goes home"), ("i go home", "i go home"), ("a a a b", "a b"), ("go go go go", "go"), ("x y z", "x z")] * 5)]


def test_levels_are_read_off_the_buckets(spark):
    _, m = _fitted(spark, ROWS)
    for t in (m.tri, m.bi, m.counts["tri"], m.counts["bi"]):
        assert "Exchange" not in _plan(t)
    decisive = _plan(tagger._decisive(m.tables(), m.changes))
    # the trigrams meet the bigrams' changes where both lie
    assert "ShuffledHashJoin" in decisive and not re.search(r"Exchange hashpartitioning\(lang#\d+, prev#\d+", decisive)


@pytest.mark.parametrize("share", [1 / 64, 2.0])        # with and without words that are counted first
def test_counts_are_those_of_the_words(spark, monkeypatch, share):
    monkeypatch.setattr(tagger, "HOT_SHARE", share)
    train, m = _fitted(spark, ROWS)
    ctx = vocab.label_ids(tagger.contexts(train), m.vocab)
    for name, t in tagger._level_counts(ctx, materialize=False).items():
        assert sorted(map(tuple, t.collect())) == sorted(map(tuple, m.counts[name].select(*t.columns).collect())), name
        key = ["lang", *tagger.LEVELS[name]]
        want = t.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("m"), "label_id")).alias("b"), F.sum("n").alias("s"))
        got = m.tables()[name].select(*key, f"{name}_id", f"{name}_n")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*key, "b.label_id", "s").collect())), name


def test_best_label_of_large_and_small_counts(spark):
    big = 1 << 31
    rows = [("a", big - 1, 0), ("a", big, 5), ("a", big, 4), ("b", 3, 2), ("b", 3, 1), ("c", 1 << 40, (1 << 31) - 1), ("d", big - 1, 7)]
    df = spark.createDataFrame(rows, "k string, n long, label_id int").groupBy("k").agg(*tagger._best("n", "label_id"))
    assert dict(map(tuple, df.select("k", tagger._best_id()).collect())) == {"a": 4, "b": 1, "c": (1 << 31) - 1, "d": 7}


def test_label_ids_of_arrays(spark):
    v = spark.createDataFrame([("$KEEP", 0), ("$DELETE", 1), ("$REPLACE_a", 2)], "label string, label_id int")
    df = spark.createDataFrame([(1, ["$DELETE", "$KEEP", "?"]), (2, []), (3, None), (4, ["$REPLACE_a", None])], "i int, labels array<string>")
    got = df.select("i", vocab.label_id_arrays("labels", v).alias("ids")).collect()
    assert {r.i: r.ids for r in got} == {1: [1, 0, 0], 2: [], 3: None, 4: [2, 0]}
