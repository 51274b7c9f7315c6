"""The validation loss asks each level only for what the levels above it do not know."""

import math
from collections import Counter, defaultdict

import pytest

from redline.operators import edits, tagger, vocab
from redline.plans import queries
from redline.plans.session import cut_lineage

TRAIN = [(i, "en" if i % 4 else "es", w, c) for i, (w, c) in enumerate(
    [("he go home", "he goes home"), ("i go home", "i go home"), ("a a a b", "a b"), ("he go out", "he goes out"), ("x y z", "x z")] * 6)]
VAL = [(1, "en", "he go home", "he goes home"), (2, "en", "he go far", "he goes far"), (3, "es", "q r", "q"), (4, "en", "y a a", "y a"),
       (4, "en", "go", "goes"), (5, None, "he go", "he go"), (6, "en", "x y z", "x z"), (7, "en", "not in a batch", "not")]
BATCHES = [(1, 0), (2, 0), (3, 1), (4, 1), (4, 1), (5, 2), (6, 2)]
SCHEMA = "pair_id long, lang string, incorrect string, correct string"


def _words(rows, ids):
    for pair, lang, w, c in rows:
        src = w.split()
        for i, (word, label) in enumerate(zip(src, edits.pair_labels(src, c.split()))):
            yield pair, lang, src[i - 1] if i else "<s>", word, src[i + 1] if i + 1 < len(src) else "</s>", ids.get(label, 0)


def _expected(ids):
    levels = [lambda p, w, n: (p, w, n), lambda p, w, n: (p, w), lambda p, w, n: (w,)]
    counts = [defaultdict(Counter) for _ in levels]
    for _, lang, p, w, n, label in _words(TRAIN, ids):
        for c, of in zip(counts, levels):
            c[lang, of(p, w, n)][label] += 1
    loss, used = defaultdict(list), Counter()
    for pair, lang, p, w, n, label in _words(VAL, ids):
        level = next((i for i, of in enumerate(levels) if lang is not None and (lang, of(p, w, n)) in counts[i]), 3)
        here = counts[level][lang, levels[level](p, w, n)] if level < 3 else Counter()
        used[level] += 1
        for _ in (b for q, b in BATCHES if q == pair):
            batch = next(b for q, b in BATCHES if q == pair)
            loss[batch].append(-math.log((here[label] + 1) / (sum(here.values()) + len(ids))))
    assert set(used) == {0, 1, 2, 3}
    return sum(sum(x) / len(x) for x in loss.values()) / len(loss), len(loss), sum(map(len, loss.values()))


@pytest.mark.parametrize("materialize", [True, False])
def test_loss_is_that_of_the_most_specific_context(spark, monkeypatch, materialize):
    labelled = [cut_lineage(edits.with_labels(spark.createDataFrame(rows, SCHEMA)).select("pair_id", "lang", "src_tok", "labels")) for rows in (TRAIN, VAL)]
    v = vocab.label_vocab(vocab.label_counts(edits.edit_table(labelled[0])))
    m = tagger.fit(labelled[0], v, materialize=materialize)
    tables, real = {}, tagger.cut_lineage

    def cut(df, name="table", **more):
        tables[name] = real(df, name, **more)
        return tables[name]
    monkeypatch.setattr(tagger, "cut_lineage", cut)
    got = tagger.validation_nll(labelled[1], m, spark.createDataFrame(BATCHES, "pair_id long, batch long")).first()
    want = _expected({r.label: r.label_id for r in v.collect()})
    assert (got.n_batches, got.n_tokens) == want[1:] and got.val_loss == pytest.approx(want[0], abs=1e-8)
    if materialize:
        asked = {name: tables[f"val-{name}"].count() for name in tagger.LEVELS}
        known = {name: tables[f"val-{name}"].where("n is not null").count() for name in tagger.LEVELS}
        assert asked["bi"] == asked["tri"] - known["tri"] and asked["uni"] == asked["bi"] - known["bi"]
        assert all(known.values())


def test_asked_contexts_come_to_the_counts(spark):
    labelled = cut_lineage(edits.with_labels(spark.createDataFrame(TRAIN, SCHEMA)).select("pair_id", "lang", "src_tok", "labels"))
    m = tagger.fit(labelled, vocab.label_vocab(vocab.label_counts(edits.edit_table(labelled))))
    asked = cut_lineage(m.counts["tri"].limit(5))
    with tagger.setting(spark, tagger.CO_PARTITION_CONF, "false"):
        plan = m.counts["tri"].join(asked.hint("shuffle_hash"), ["lang", *tagger.LEVELS["tri"]], "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ShuffledHashJoin" in plan


def test_both_splits_are_labelled_in_one_pass(spark, monkeypatch):
    names, real = [], queries.cut_lineage

    def cut(df, name="table", **more):
        names.append(name)
        return real(df, name, **more)
    monkeypatch.setattr(queries, "cut_lineage", cut)
    queries.q_val_loss(spark, "/root/testdata/sf0.001")
    assert names == ["labelled"]
