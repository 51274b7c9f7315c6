"""Property tests: the Arrow LCS / alignment against a plain DP, native LCS
cross-check, label invariants, splits and samples."""

from functools import lru_cache

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from redline.operators import edits, split
from redline.operators.align import lcs_align, lcs_len, lcs_length, lcs_length_native

tok = st.lists(st.sampled_from(list("abcd")), max_size=14)


@lru_cache(maxsize=None)
def longest(x: str, y: str) -> int:
    """By definition: the last word of ``x`` is left out, or meets its last copy in ``y``."""
    if not x or not y:
        return 0
    at = y.rfind(x[-1])
    return max(longest(x[:-1], y), longest(x[:-1], y[:at]) + 1 if at >= 0 else 0)


def ruled(x: str, y: str) -> list:
    """The tie rule: equal last words meet; else the last word of ``x`` goes if the
    rest is as long without it; else the last word of ``y`` goes."""
    if not x or not y:
        return []
    if x.endswith(y[-1]):
        return [*ruled(x[:-1], y[:-1]), (len(x) - 1, len(y) - 1)]
    return ruled(x[:-1], y) if longest(x[:-1], y) == longest(x, y) else ruled(x, y[:-1])


@settings(max_examples=400, deadline=None)
@given(tok, tok)
def test_lcs_and_alignment_match_definition(a, b):
    x, y = "".join(a), "".join(b)
    al = ruled(x, y)
    assert lcs_len(a, b) == len(al) == longest(x, y)
    assert lcs_align(a, b) == al
    assert lcs_align(a, b, full_table_bits=0) == al   # checkpointed rows, same result
    assert all(a[s] == b[t] for s, t in al)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(al, al[1:]))


def test_long_sentences_are_whole():
    a = [f"w{i % 97}" for i in range(3000)]
    b = a[1:] + a[:1]  # a rotation: LCS is everything but one word
    assert lcs_len(a, b) == 2999
    assert len(lcs_align(a, b)) == 2999
    assert lcs_align(a, b, full_table_bits=0) == lcs_align(a, b)


def test_udf_equals_native(spark):
    import random
    rnd = random.Random(3)
    rows = [(i, [rnd.choice("abc") for _ in range(rnd.randint(0, 9))],
             [rnd.choice("abc") for _ in range(rnd.randint(0, 9))]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a array<string>, b array<string>")
    bad = df.where(lcs_length("a", "b") != lcs_length_native("a", "b")).count()
    assert bad == 0


def test_label_invariants(spark):
    import random
    rnd = random.Random(5)
    rows = []
    for i in range(500):
        s = [rnd.choice("abcx") for _ in range(rnd.randint(0, 10))]
        rows.append((i, " ".join(s), " ".join(s if i % 4 == 0 else [rnd.choice("abc") for _ in s])))
    df = spark.createDataFrame(rows, "pair_id long, incorrect string, correct string")
    x = edits.with_labels(df)
    assert x.where(F.size("labels") != F.size("src_tok")).count() == 0
    same = x.where(F.col("incorrect") == F.col("correct"))
    assert same.where(F.exists("labels", lambda l: l != "$KEEP")).count() == 0


def test_splits_partition_rows(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("pair_id"), F.lit("en").alias("lang"),
                                     F.concat(F.lit("s"), (F.col("id") % 1777).cast("string")).alias("correct"))
    ex = split.exact_split(df)
    counts = {r.split: r.n for r in ex.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert (counts["train"], counts["val"], counts["test"]) == split.expected_exact_sizes(5000)
    assert ex.select("pair_id").distinct().count() == 5000
    # hash split keeps copies of a sentence together
    hs = split.hash_split(df)
    assert hs.groupBy("correct").agg(F.countDistinct("split").alias("k")).where("k > 1").count() == 0
    # global rank is a permutation of 0..n-1
    r = split.global_rank(df)
    agg = r.agg(F.min("_idx"), F.max("_idx"), F.countDistinct("_idx")).first()
    assert tuple(agg) == (0, 4999, 5000)


def test_sample_is_bounded(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("pair_id"),
                                     F.when(F.col("id") % 10 == 0, "es").otherwise("en").alias("lang"))
    s = split.sample_per_group(df, 200)
    got = {r.lang: r.n for r in s.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"en": 200, "es": 200}
    assert split.sample_per_group(df, 200).exceptAll(split.sample_per_group(df, 200)).count() == 0
