"""Steps that are computed once, and shortcuts that change no result."""

import random
import re

from pyspark.sql import functions as F

from redline.operators import align, edits, encode, split, tagger, vocab
from redline.plans import jobs, queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def stored(monkeypatch, module):
    names, real = [], module.cut_lineage

    def cut(df, name="table", **more):
        names.append(name)
        return real(df, name, **more)
    monkeypatch.setattr(module, "cut_lineage", cut)
    return names


def test_vocabulary_is_counted_once(spark):
    texts = spark.createDataFrame([(["a", "b", "a"],), (["c"],)], "tok array<string>")
    v = encode.token_vocab(texts)
    assert "Generate" not in plan(v)
    assert {r.token: r.freq for r in v.collect()} == {"a": 2, "b": 1, "c": 1}
    assert sorted(r.token_id for r in v.collect()) == [4, 5, 6]


def test_ranking_computes_its_input_once(spark):
    x = spark.range(50).withColumnRenamed("id", "pair_id").withColumn("t", F.concat(F.lit("x"), "pair_id"))
    r = split.global_rank(x)
    assert "Range" not in plan(r)
    assert sorted(q._idx for q in r.collect()) == list(range(50))


def test_alignment_shortcut_walks_like_the_table():
    def table(src, tgt):
        m, n = len(src), len(tgt)
        dp = [[0] * (n + 1) for _ in range(m + 1)]
        for i in range(m):
            for j in range(n):
                dp[i + 1][j + 1] = dp[i][j] + 1 if src[i] == tgt[j] else max(dp[i][j + 1], dp[i + 1][j])
        out = []
        while m and n:
            if src[m - 1] == tgt[n - 1]:
                m, n = m - 1, n - 1
                out.append((m, n))
            elif dp[m - 1][n] >= dp[m][n - 1]:
                m -= 1
            else:
                n -= 1
        return out[::-1]
    rng = random.Random(3)
    for _ in range(5000):
        tgt = [rng.choice("abc") for _ in range(rng.randint(0, 7))]
        src = list(tgt)
        for _ in range(rng.randint(0, 2)):
            k = rng.randint(0, len(src))
            src[k:k + rng.randint(0, 1)] = rng.choice([[], ["a"], ["d"], ["b", "a"]])
        assert align.lcs_align(src, tgt) == table(src, tgt), (src, tgt)


def test_labels_need_no_alignment_column(spark):
    rows = [(1, "a b c", "a b c"), (2, "b c a", "a b c"), (3, "x a", "a"), (4, None, "a"), (5, "a b", "c  a b d"),
            (6, "  ", "a"), (7, "a bx c", "a b c"), (8, "a c", "a b c"), (9, "q", "r s")]
    x = edits.with_labels(spark.createDataFrame(rows, "pair_id long, incorrect string, correct string"))
    assert "_align_udf" not in plan(x.select("pair_id", "labels"))
    both = x.select("pair_id", "labels", edits.edit_labels("src_tok", "tgt_tok", "alignment").alias("native")).collect()
    assert len(both) == len(rows) and all(r.labels == r.native for r in both)


def fitted(spark):
    rows = [(i, "en", w, c) for i, (w, c) in enumerate([("he go home", "he goes home"), ("i go home", "i go home"),
                                                        ("he go out", "he goes out"), ("a a b", "a b")] * 3)]
    train = edits.with_labels(spark.createDataFrame(rows, "pair_id long, lang string, incorrect string, correct string"))
    return tagger.fit(train, vocab.label_vocab(vocab.label_counts(edits.edit_table(train))))


def test_tagging_looks_up_visible_words_only(spark):
    m = fitted(spark)
    s = spark.createDataFrame([(1, "en", "he go home"), (2, "en", "they he go out"), (3, "en", " "), (4, None, "he go")],
                              "pair_id long, lang string, text string")
    t = tagger.tag(s, m, max_words=2)
    assert re.search(r"Filter .*pos#\d+ < 2", plan(t))
    assert {r.pair_id: r.labels for r in t.collect()} == {
        1: ["$KEEP", "$REPLACE_goes", "$KEEP"], 2: ["$KEEP"] * 4, 3: [], 4: ["$KEEP"] * 2}
    assert {r.pair_id: r.labels for r in tagger.tag(s, m).collect()}[2] == ["$KEEP", "$KEEP", "$REPLACE_goes", "$INSERT_goes"]


def test_tagging_keeps_all_words_of_a_repeated_id(spark):
    s = spark.createDataFrame([(1, "en", "he go home"), (1, "en", "i go"), (None, "en", "he go home")],
                              "pair_id long, lang string, text string")
    got = sorted((r.text, r.pair_id is None, r.labels) for r in tagger.tag(s, fitted(spark)).collect())
    merged = ["$KEEP", "$KEEP", "$KEEP", "$REPLACE_goes", "$KEEP"]
    assert got == [("he go home", False, merged), ("he go home", True, []), ("i go", False, merged)]


def test_each_level_meets_only_the_changes_below(spark):
    m = fitted(spark)
    assert len(re.findall(r"\bJoin ", plan(tagger._decisive(m.tables(), m.changes)))) == 2


def test_prompts_are_stored_once(spark, monkeypatch, tmp_path):
    names = stored(monkeypatch, jobs)
    r = spark.createDataFrame([(1, "en", "a b", "a b", "test"), (2, "es", "c", "c", "train")],
                              "pair_id long, lang string, source string, target string, split string")
    done = jobs.resumable_prompt_job(r, lambda: lambda batch: [p + " ok" for p in batch], f"{tmp_path}/replies", slices=2)
    assert names == ["prompts-open"] and [q.prediction for q in done.collect()] == ["ok"]


def test_rows_read_twice_are_stored(spark, monkeypatch):
    names = stored(monkeypatch, queries)
    queries.q_align_pairs(spark, "/root/testdata/sf0.001")
    queries.q_few_shot_prompts(spark, "/root/testdata/sf0.001")
    assert names == ["align-rows", "ranked"]
