"""Calls of a fixed size cost one frame a batch; texts are stripped once."""

import re

import pandas as pd
from pyspark.sql import functions as F

from redline.functions import prompts
from redline.functions.text import py_strip, rest_from, strip_prefix, tokens
from redline.operators import corpus, scoring


def test_a_frame_holds_many_calls():
    batches = [pd.DataFrame({"source": [f"s{i}" for i in range(a, b)]}) for a, b in ((0, 10), (10, 11), (11, 23))]
    got = list(scoring.chunked(iter(batches), 4))
    assert [len(x) for x in got] == [8, 12, 3]
    assert [s for x in got for s in x["source"]] == [f"s{i}" for i in range(23)]


def test_a_prefix_in_any_case(spark):
    rows = [("Corrected: a",), ("CORRECTED:  a ",), ("corrected:",), ("Corrected",), ("İcorrected: a",), ("ORACIÓN CORREGIDA: ñ",), ("",), (None,),
            ("Oración corregida: x",), ("Korrected: a",)]
    df = spark.createDataFrame(rows, "t string")
    for p in prompts.REPLY_PREFIXES:
        whole = F.when(F.startswith(F.lower("t"), F.lit(p.lower())), py_strip(rest_from("t", F.lit(len(p) + 1)))).otherwise(F.col("t"))
        assert all(r[0] == r[1] for r in df.select(strip_prefix("t", p), whole).collect())


def test_filters_do_not_strip_again(spark):
    raw = spark.createDataFrame([(1, " fix grammar: a b ", "a c"), (2, "a ", " a"), (3, "  ", "a"), (4, None, "a"), (5, "Fix Grammar:", "x"), (6, "b", None)],
                                "pair_id long, modified string, sentence string")
    x = corpus.noop_filtered_pairs(raw)
    assert [tuple(r) for r in x.collect()] == [(1, "a b", "a c", "en")]
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and not any("trim(" in line for line in plan.splitlines() if "Filter" in line)


def test_words_of_plain_texts_need_no_expression(spark):
    texts = ["a b", "a  b", " a b ", "a\tb", "a b", "ñ b", "ñ b  c", "", "  ", "　", "a​b", "ä\nb", None, "a\x1fb", "\x85a b ", "ab"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.w for r in df.select("i", tokens("t").alias("w")).collect()}
    assert got == {i: None if t is None else t.split() for i, t in enumerate(texts)}
    plan = df.select(tokens("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"ELSE split\(trim\(.*?\)\),  , -1\)", plan, re.S)        # by one blank
