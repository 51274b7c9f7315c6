"""Golden cases: alignment/labels/apply (G1-G13), metrics, reply cleaning,
blanks."""

import pytest
from pyspark.sql import functions as F

from redline.functions import prompts
from redline.functions.text import norm_text, py_strip, tokens
from redline.operators import edits, metrics

GOLDEN = [
    ("She go to", "She goes to", "$KEEP $REPLACE_goes $INSERT_goes", "She goes goes to"),
    ("a x b", "a b", "$KEEP $REPLACE_a $KEEP", "a a b"),
    ("I like cat", "I like cats", "$KEEP $KEEP $DELETE", "I like"),
    ("x a", "a", "$DELETE $KEEP", "a"),
    ("a b", "a p q b", "$KEEP $INSERT_p", "a p b"),
    ("b", "a b", "$INSERT_a", "a b"),
    ("a", "a b", "$KEEP", "a"),
    ("a", "a a", "$INSERT_a", "a a"),
    ("x b", "a b", "$REPLACE_a $INSERT_a", "a a b"),
    ("x", "y", "$DELETE", ""),
    ("a x y b", "a p q b", "$KEEP $REPLACE_q $REPLACE_q $INSERT_p", "a q q p b"),
    ("the  cat sat", "the cat sat", "$KEEP $KEEP $KEEP", "the cat sat"),
    ("", "a b", "", ""),
]


def test_golden_labels_and_apply(spark):
    df = spark.createDataFrame([(i, s, t) for i, (s, t, _, _) in enumerate(GOLDEN)],
                               "pair_id long, incorrect string, correct string")
    got = (edits.with_labels(df)
           .select("pair_id", F.array_join("labels", " ").alias("l"),
                   edits.apply_labels("src_tok", "labels").alias("a"))
           .orderBy("pair_id").collect())
    for (src, tgt, want_l, want_a), r in zip(GOLDEN, got):
        assert (r.l, r.a) == (want_l, want_a), (src, tgt)


def test_g8_alignment_is_right_greedy(spark):
    df = spark.createDataFrame([(0, "a", "a a")], "pair_id long, incorrect string, correct string")
    r = edits.with_labels(df).select(edits.alignment_text("alignment").alias("al")).first()
    assert r.al == "0:1"


def _report(spark, rows, fn):
    df = spark.createDataFrame(rows, "lang string, prediction string, reference string")
    return fn(df).first()


@pytest.mark.parametrize("pred,ref,lcs_prf,set_prf", [
    ("a a b", "a b", (0.6667, 1.0, 0.7143), (1.0, 1.0, 1.0)),
    ("the cat", "the cat sat", (1.0, 0.6667, 0.9091), (1.0, 0.6667, 0.9091)),
])
def test_metric_cases(spark, pred, ref, lcs_prf, set_prf):
    r = _report(spark, [("en", pred, ref)], metrics.f05_lcs)
    assert tuple(round(x, 4) for x in (r.precision, r.recall, r.f05)) == lcs_prf
    r = _report(spark, [("en", pred, ref)], metrics.f05_set)
    assert tuple(round(x, 4) for x in (r.precision, r.recall, r.f05)) == set_prf


def test_empty_report_is_zero(spark):
    df = spark.createDataFrame([], "lang string, prediction string, reference string")
    r = metrics.empty_report(df).first()
    assert (r.precision, r.recall, r.f05, r.exact_match, r.n_rows) == (0.0, 0.0, 0.0, 0.0, 0)


def test_exact_match_ignores_case_and_blanks(spark):
    r = _report(spark, [("en", "The  Cat", "the cat"), ("en", "a", "b")], metrics.exact_match)
    assert r.exact_match == 0.5


@pytest.mark.parametrize("reply,source,want", [
    ("Corrected: Answer: x", "s", "x"),
    ("Answer: Corrected: x", "s", "Corrected: x"),
    ("corregida:  y ", "s", "y"),
    ("   ", "src", "src"),
    (None, "src", "src"),
])
def test_reply_cleaning_order(spark, reply, source, want):
    df = spark.createDataFrame([(reply, source)], "reply string, source string")
    assert df.select(prompts.clean_reply("reply", "source").alias("x")).first().x == want


def test_cut_prompt_by_characters(spark):
    df = spark.createDataFrame([("PROMPT", "PROMPT  Corrected: ok")], "p string, g string")
    assert df.select(prompts.cut_prompt("g", "p").alias("x")).first().x == "Corrected: ok"


def test_python_blanks(spark):
    text = "a b c\u001cd\te  "
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(tokens("t").alias("tok"), py_strip("t").alias("s"), norm_text("t").alias("n")).first()
    assert r.tok == text.split()
    assert r.s == text.strip()
    assert r.n == " ".join(text.lower().split())
