"""The paths that keep work even: worklist, threshold sample, sample sort, heavy keys,
cost packing; and the stores and plug points that survive a failure."""

import os
import random

import pytest
from pyspark.sql import functions as F

from redline.operators import align, encode, scoring, skew, split, tagger, vocab
from redline.plans import jobs
from redline.plans import queries as Q
from redline.sources import pairs as pair_io

SMALL = "/root/testdata/sf0.001"


def _largest_task(df):
    """(rows, largest share of a task) of what the last shuffle of ``df`` dealt out."""
    per = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    return sum(per), max(per)


# ---------------------------------------------------------------- E6: worklist

def test_later_passes_see_only_changed_sentences(spark, monkeypatch):
    model = Q.fitted_tagger(spark, SMALL)
    text = Q._test_text(spark, SMALL).cache()
    seen, real = [], tagger._pass

    def spy(state, *rest):
        seen.append({r["pair_id"] for r in state.select("pair_id").collect()})
        return real(state, *rest)
    monkeypatch.setattr(tagger, "_pass", spy)
    out = {r["pair_id"]: r for r in tagger.correct(text, model, max_passes=3).collect()}
    assert len(seen) == 3 and len(seen[0]) == len(out) == text.count() > len(seen[1]) >= len(seen[2])
    # whoever stopped in a pass is in no later one
    for k, ids in enumerate(seen, 1):
        assert ids == {i for i, r in out.items() if r["passes_used"] >= k}
    # each pass is one application of the tagger
    once = {r["pair_id"]: r["next_text"] for r in tagger.correct_once(text, model).collect()}
    assert all(out[i]["corrected"] == once[i] for i in out if out[i]["passes_used"] == 1)


def test_correct_edges(spark):
    model = Q.fitted_tagger(spark, SMALL)
    rows = [(1, "en", "", 5), (2, "en", "  ", 5), (3, "xx", "unknown words only", 5), (4, None, "no language", 5)]
    df = spark.createDataFrame(rows, "pair_id long, lang string, text string, extra int")
    got = {r["pair_id"]: (r["corrected"], r["passes_used"], r["extra"]) for r in tagger.correct(df, model).collect()}
    assert got == {1: ("", 1, 5), 2: ("", 2, 5), 3: ("unknown words only", 1, 5), 4: ("no language", 1, 5)}
    assert tagger.correct(df.limit(0), model).count() == 0


def test_edits_between_copied_stretches(spark):
    labels = ["$DELETE", "$KEEP", "$REPLACE_x", "$INSERT_y", "$KEEP", "$DELETE"]
    df = spark.createDataFrame([(list("abcdef"), [(i, x) for i, x in enumerate(labels) if x != "$KEEP"]), (list("ab"), [(1, "$INSERT_q")])],
                               "tok array<string>, found array<struct<pos:int,label:string>>")
    got = [r[0] for r in df.select(tagger._edited(F.col("tok"), F.col("found"))).collect()]
    assert got == [["b", "x", "y", "d", "e"], ["a", "q", "b"]]


# ---------------------------------------------------------------- W3: threshold selection

@pytest.mark.parametrize("bits", [1, 6, 16])
def test_sample_keeps_the_same_rows(spark, bits):
    df = spark.range(6000).select(F.col("id").alias("pair_id"), F.when(F.col("id") % 3 > 0, "en").when(F.col("id") % 2 == 0, "es").alias("lang"))
    df = df.union(spark.createDataFrame([(9001, "rare"), (9002, "rare")], df.schema))
    got = sorted((r["lang"] or "", r["pair_id"]) for r in split.sample_per_group(df, 50, bits=bits).collect())
    by = {}
    for r in df.withColumn("h", split.seeded_hash(42, "pair_id")).collect():
        by.setdefault(r["lang"] or "", []).append((r["h"], r["pair_id"]))
    assert got == sorted((g, i) for g, rows in by.items() for _, i in sorted(rows)[:50])
    assert split.sample_per_group(df.limit(0), 50, bits=bits).count() == 0 == split.sample_per_group(df, 0, bits=bits).count()


def test_sample_ranks_little_more_than_it_keeps(spark):
    df = spark.range(200_000, numPartitions=64).select(F.col("id").alias("pair_id"), F.when(F.col("id") % 10 > 0, "en").otherwise("es").alias("lang"))
    left = {r["lang"]: r["count"] for r in split.below_threshold(df, 100).groupBy("lang").count().collect()}
    assert set(left) == {"en", "es"} and all(100 <= n <= 120 for n in left.values())


# ---------------------------------------------------------------- W11: sample sort

def test_rank_by_spreads_ids_with_an_outlier(spark, monkeypatch):
    tables, real = [], split.cut_lineage
    monkeypatch.setattr(split, "cut_lineage", lambda df, name: tables.append(real(df, name)) or tables[-1])
    ids = spark.range(200_000).select(F.col("id").alias("pair_id")).union(spark.createDataFrame([(2**62,), (-5,)], "pair_id long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = split.rank_by(ids)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per = [r["n"] for r in tables[0].groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]   # one file a range
    n = sum(per)
    assert n == 200_002 and len(per) == 8 and max(per) <= 2 * n / 8
    rows = ranked.orderBy("pair_id").collect()
    assert [r["_idx"] for r in rows] == list(range(n)) and {r["_n"] for r in rows} == {n}
    assert split.rank_by(ids.limit(0)).count() == 0


# ---------------------------------------------------------------- F16, M3: heavy keys

def test_a_token_that_is_a_third_of_all_words_is_spread(spark):
    t = spark.range(4000).select(F.col("id").alias("pair_id"), F.array(F.lit("the"), F.concat(F.lit("w"), F.col("id") % 500), F.concat(F.lit("v"), F.col("id"))).alias("tok"))
    v = encode.token_vocab(t.select("tok")).cache()
    ids = {r["token"]: r["token_id"] for r in v.collect()}
    got = {r["pair_id"]: r["ids"] for r in encode.token_ids(t, v, {"tok": "ids"}).collect()}
    assert got == {i: [ids["the"], ids[f"w{i % 500}"], ids[f"v{i}"]] for i in range(4000)}
    words = t.select("pair_id", F.posexplode("tok").alias("pos", "token"))
    hot = skew.heavy_keys(v, "freq", 1 / 64)
    assert [r["token"] for r in hot.collect()] == ["the"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n, most = _largest_task(skew.split_join(words, v.select("token", "token_id"), ["token"], "token_id", hot, ["pair_id", "pos"]))
        plain, worst = _largest_task(words.join(v, "token", "left"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert n == plain == 12_000 and worst > n / 3 and most < 1.5 * n / 8


def test_split_join_answers_like_a_left_join(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["en", "es", None]), rng.choice(["a", "b", "c", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "pair_id long, lang string, word string")
    table = spark.createDataFrame([("en", "a", 1), ("en", "b", 2), ("es", "a", 3), ("es", "z", 4)], "lang string, word string, uni_id int")
    heavy = spark.createDataFrame([("en", "a", 1), ("es", "c", None)], "lang string, word string, uni_id int")
    want = {r["pair_id"]: r["uni_id"] for r in df.join(table, ["lang", "word"], "left").collect()}
    got = skew.split_join(df, table, ["lang", "word"], "uni_id", heavy, ["pair_id"]).collect()
    assert {r["pair_id"]: r["uni_id"] for r in got} == want and len(got) == 300


# ---------------------------------------------------------------- E1, E2: cost packing

def test_alignment_is_packed_by_cost(spark):
    long_ = [(i, 30_000 if i % 5 == 0 else 8_000 + 100 * i) for i in range(32)]
    rows = [(i, n) for i, n in long_] + [(100 + i, 20) for i in range(20_000)]
    df = spark.createDataFrame(rows, "pair_id long, n int").select(
        "pair_id", F.array_repeat(F.lit("a"), F.col("n")).alias("src_tok"), F.array_repeat(F.lit("b"), F.col("n")).alias("tgt_tok"))
    packed = align.balanced(df, parts=8)
    per = packed.groupBy(F.spark_partition_id().alias("p")).agg(
        F.sum(F.size("src_tok").cast("double") * F.size("tgt_tok")).alias("cost"), F.count(F.lit(1)).alias("n")).collect()
    costs = sorted(r["cost"] for r in per)
    assert sum(r["n"] for r in per) == 20_032 and len(per) == 8
    assert costs[-1] <= 2 * costs[len(costs) // 2]
    assert align.balanced(df.limit(0)).count() == 0


# ---------------------------------------------------------------- S3: headers by file

def test_csv_folders_of_mixed_headers(spark, tmp_path):
    root = tmp_path / "mixed"
    (root / "lang=es").mkdir(parents=True)
    (root / "lang=en").mkdir()
    (root / "lang=es" / "a.csv").write_text("incorrect,correct,transformation\nbad a,good a,t\n\"two\nlines\",\"say \"\"x\"\"\",t\n")
    (root / "lang=es" / "b.csv").write_text("\ufefftransformation,pair_id,correct,incorrect\nt,7,good b,bad b\n")
    (root / "lang=en" / "c.csv").write_text("correct,incorrect,transformation,notes,pair_id\ngood c,bad c,NA,some,8\ngood d,NA,t,,9\n")
    (root / "lang=en" / "empty.csv").write_text("")
    (root / "lang=en" / "head.csv").write_text("incorrect,correct,transformation\n")
    got = {tuple(r) for r in pair_io.read_pairs_csv(spark, str(root)).collect()}
    assert got == {(None, "bad a", "good a", "t", "es"), (None, "two\nlines", 'say "x"', "t", "es"), (7, "bad b", "good b", "t", "es"),
                   (8, "bad c", "good c", None, "en")}
    (root / "lang=en" / "bad.csv").write_text("incorrect,transformation\nx,y\n")
    with pytest.raises(ValueError, match="bad.csv: no column correct"):
        pair_io.read_pairs_csv(spark, str(root))


# ---------------------------------------------------------------- S5, S6: vocabularies

def test_a_failed_save_leaves_the_old_vocabulary(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "vocab")
    one = spark.createDataFrame([("$KEEP", 0, 5)], "label string, label_id int, freq long")
    assert pair_io.load_vocab(spark, path, None, 1) is None
    first = pair_io.save_vocab(one, path, None, 1)
    reader = pair_io.load_vocab(spark, path, None, 1)

    def fail(*_):
        raise RuntimeError("lost between write and switch")
    with monkeypatch.context() as m:
        m.setattr(pair_io, "_switch", fail)
        with pytest.raises(RuntimeError):
            pair_io.save_vocab(one.withColumn("freq", F.lit(6).cast("long")), path, None, 1)
    current, versions = pair_io.vocab_versions(spark, path)
    assert current == first and len(versions) == 2
    assert pair_io.load_vocab(spark, path, None, 1).first()["freq"] == 5
    pair_io.save_vocab(one.withColumn("freq", F.lit(7).cast("long")), path, None, 1)
    assert pair_io.load_vocab(spark, path, None, 1).first()["freq"] == 7 and reader.first()["freq"] == 5
    assert pair_io.load_vocab(spark, path, "es", 1) is None and pair_io.load_vocab(spark, path, None, 2) is None


def test_vocabulary_by_language_equals_one_of_each(spark):
    e = Q.train_edits(spark, SMALL, materialize=True)
    both = vocab.label_vocab_by(e, "lang", 40)
    for lang in ("en", "es"):
        want = {tuple(r) for r in vocab.label_vocab(vocab.label_counts(e.where(F.col("lang") == lang)), 40).collect()}
        assert {tuple(r) for r in both.where(F.col("lang") == lang).drop("lang").collect()} == want
    ids = vocab.label_ids(e, both)
    back = vocab.id_labels(ids.drop("label"), both)
    known = e.join(both.select("lang", "label"), ["lang", "label"], "left_semi").count()
    assert back.where(F.col("label") != "$KEEP").count() + e.where(F.col("label") == "$KEEP").count() == known
    assert "WindowGroupLimit" in vocab.label_vocab_by(e, "lang", 40, materialize=False)._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- M1, M6: batches and restarts

def test_batches_of_a_fixed_size_across_arrow_batches(spark):
    df = spark.range(23, numPartitions=1).select(F.col("id").alias("pair_id"), F.concat(F.lit("s"), "id").alias("source"))

    def factory():
        def fn(batch):
            return [f"{len(batch)}" for _ in batch]
        return fn
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = [r["prediction"] for r in scoring.apply_corrector(df, factory, batched=True, batch_size=4).orderBy("pair_id").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == ["4"] * 20 + ["3"] * 3

    def failing():
        def fn(batch):
            if any(s in ("s6", "s13") for s in batch):
                raise ValueError
            return batch if len(batch) < 4 else [s + "!" for s in batch]
        return fn
    rows = {r["source"]: (r["prediction"], r["had_error"]) for r in scoring.apply_corrector(df, failing, batched=True, batch_size=4).collect()}
    assert {s for s, (_, bad) in rows.items() if bad} == {"s6", "s13"} and rows["s5"] == ("s5", False) and rows["s0"] == ("s0!", False)
    with pytest.raises(ValueError):
        scoring.apply_corrector(df, factory, batched=True, batch_size=0)


def test_a_restarted_prompt_job_sends_no_prompt_twice(spark, tmp_path):
    ranked = spark.createDataFrame([(i, f"source {i}", f"target {i}", "en", "test" if i % 4 else "train") for i in range(80)],
                                   "pair_id long, source string, target string, lang string, split string")
    log, out = tmp_path / "log", str(tmp_path / "out")
    log.mkdir()

    def generator(broken):
        def factory():
            def fn(batch):
                import uuid
                (log / uuid.uuid4().hex).write_text("\n".join(p.split("Sentence: ")[-1].split("\n")[0] for p in batch))
                return [p + " Corrected: fixed" for p in batch]
            return fn
        return factory
    # a run that dies after some slices: its kept replies stay
    calls, real = [], jobs._replies

    def dying(*a):
        calls.append(1)
        if len(calls) > 3:
            raise RuntimeError("lost")
        return real(*a)
    jobs._replies = dying
    try:
        with pytest.raises(RuntimeError):
            jobs.resumable_prompt_job(ranked, generator(True), out, batch_size=4, slices=8)
    finally:
        jobs._replies = real
    half = spark.read.parquet(out).count()
    assert 0 < half < 60
    done = jobs.resumable_prompt_job(ranked, generator(False), out, batch_size=4, slices=8)
    assert done.count() == done.select("pair_id").distinct().count() == 60 and done.where("had_error or prediction <> 'fixed'").count() == 0
    sent = [s for f in os.listdir(log) for s in (log / f).read_text().split("\n")]
    assert len(sent) == len(set(sent)) == 60
    assert all(len((log / f).read_text().split("\n")) <= 4 for f in os.listdir(log))


# ---------------------------------------------------------------- W7, A10: positions

def test_split_words_are_cut_at_the_frame(spark):
    df = spark.createDataFrame([([2, 0, 3],), ([],), ([9, 9],), ([0, 0, 0, 0, 0, 0, 1],)], "n array<int>")
    got = [r[0] for r in df.select(encode.split_word_ids(F.col("n"), 8)).collect()]
    assert got == [[None, 0, 0, 2, 2, 2, None, None], [None] * 8, [None, 0, 0, 0, 0, 0, 0, None], [None, 6] + [None] * 6]


def test_masked_array_loss_equals_the_long_form(spark):
    from redline.operators import runs
    rows = [(0, [1.0, 2.0, None], [5, -100, 3]), (0, [4.0], [0, 1]), (1, [3.0, 1.0], [-100, -100]), (2, [0.5, 0.25], [1, 1])]
    got = runs.masked_array_loss(spark.createDataFrame(rows, "batch int, losses array<double>, labels array<int>")).first()
    assert (got["loss"], got["n_batches"], got["n_positions"]) == ((2.5 + 0.375) / 2, 3, 4)
    long_ = spark.createDataFrame([(b, x, y) for b, l, k in rows for x, y in zip(l, k) if x is not None], "batch int, nll double, label int")
    assert runs.masked_loss(long_).first()["loss"] == got["loss"]
    none = runs.masked_array_loss(spark.createDataFrame([], "batch int, losses array<double>, labels array<int>")).first()
    assert (none["loss"], none["n_batches"], none["n_positions"]) == (0.0, 0, 0)
