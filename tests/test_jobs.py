"""End-to-end jobs, the corrector plug point, and raw-set handling."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from redline.operators import corpus, scoring
from redline.plans import jobs
from redline.plans import queries as Q
from redline.sources import fixtures
from redline.sources import pairs as pair_io

SMALL = "/root/testdata/sf0.001"


def test_corrector_errors_fall_back_to_source(spark):
    df = spark.createDataFrame([(1, "good"), (2, "boom"), (3, "none")], "pair_id long, source string")

    def factory():
        def fn(s):
            if s == "boom":
                raise ValueError("bad row")
            return None if s == "none" else s.upper()
        return fn

    got = {r.pair_id: (r.prediction, r.had_error)
           for r in scoring.apply_corrector(df, factory).collect()}
    assert got == {1: ("GOOD", False), 2: ("boom", True), 3: ("none", True)}


def test_batched_corrector_and_fallback(spark):
    df = spark.createDataFrame([(i, f"s{i}") for i in range(50)], "pair_id long, source string")
    calls = []

    def factory():
        def fn(batch):
            calls.append(len(batch))
            return [s + "!" for s in batch]
        return fn

    out = scoring.apply_corrector(df, factory, batched=True)
    assert out.where(F.col("prediction") != F.concat("source", F.lit("!"))).count() == 0
    assert out.count() == 50


def test_project_raw_defaults_and_lang_error(spark):
    raw = spark.createDataFrame([(1, "a b", "a c", "replace")],
                                "pair_id long, modified string, sentence string, transformation string")
    p = corpus.project_raw(raw).first()
    assert (p.incorrect, p.correct, p.lang) == ("a b", "a c", "en")
    with pytest.raises(ValueError):
        corpus.filter_lang(raw, "es")


def test_read_raw_many_split_paths(spark):
    base = tempfile.mkdtemp(prefix="redline-raw-")
    p = fixtures.gec_pairs(spark, SMALL)
    raw = fixtures.raw_multilingual(p)
    raw.where("pair_id % 2 = 0").write.parquet(os.path.join(base, "train"))
    raw.where("pair_id % 2 = 1").write.parquet(os.path.join(base, "test"))
    both = pair_io.read_raw(spark, [os.path.join(base, "train"), os.path.join(base, "test")])
    assert both.count() == raw.count()


def test_build_corpus_job_writes_split_lang_folders(spark):
    base = tempfile.mkdtemp(prefix="redline-job-")
    p = fixtures.gec_pairs(spark, SMALL)
    fixtures.raw_english(p).write.parquet(os.path.join(base, "en"))
    fixtures.raw_multilingual(p).write.parquet(os.path.join(base, "multi"))
    counts = jobs.build_corpus_job(spark, os.path.join(base, "en"), os.path.join(base, "multi"),
                                   os.path.join(base, "out"))
    got = {(r.split, r.lang): r.n for r in counts.collect()}
    want = {(r.split, r.lang): r.n for r in Q.q_split_lang_counts(spark, SMALL).collect()}
    assert got == want
    assert os.path.isdir(os.path.join(base, "out", "split=train", "lang=en"))


def test_evaluate_job_identity_equals_registered_query(spark):
    test = Q.split_corpus(spark, SMALL).where(F.col("split") == "test")
    got = {r.lang: (r.lcs, r.n_pred, r.n_ref) for r in jobs.evaluate_job(test).collect()}
    want = {r.lang: (r.lcs, r.n_pred, r.n_ref) for r in Q.q_eval_identity(spark, SMALL).collect()}
    assert got == want


def test_label_fit_and_tagger_evaluation(spark):
    s = Q.split_corpus(spark, SMALL)
    vpath = os.path.join(tempfile.mkdtemp(prefix="redline-v-"), "vocab")
    model = jobs.label_and_fit_job(s.where(F.col("split") == "train"), vocab_path=vpath)
    assert pair_io.load_vocab(spark, vpath, None, 5000) is not None
    rep = jobs.evaluate_job(s.where(F.col("split") == "test"), model=model)
    assert {r.lang for r in rep.collect()} >= {"*"}


def test_prompt_job_with_echo_generator(spark):
    ranked = Q.ranked_noop(spark, SMALL)

    def echo():
        return lambda prompts: [p + " Corrected: fixed" for p in prompts]

    out = jobs.prompt_job(ranked, echo, few_shot=True)
    assert out.where(F.col("prediction") != "fixed").count() == 0
    assert out.where("had_error").count() == 0


def test_drop_tables_removes_written_tables(spark):
    from redline.plans.session import cut_lineage, drop_tables

    drop_tables(spark)
    t = cut_lineage(spark.range(10), "probe")
    assert t.count() == 10
    path = t.inputFiles()[0].split("/part-")[0].replace("file:", "")
    assert os.path.isdir(path)
    assert drop_tables(spark) == 1
    assert not os.path.exists(path)


def test_stage_shared_copies_into_checkpoint_folder(spark):
    from redline.plans.session import checkpoint_dir, stage_shared

    src = os.path.join(tempfile.mkdtemp(prefix="redline-stage-"), "x.zip")
    with open(src, "wb") as f:
        f.write(b"PK-test")
    shared = stage_shared(spark, src, "probe.zip")
    assert shared.startswith(checkpoint_dir(spark).rstrip("/"))
    with open(shared.replace("file:", ""), "rb") as f:
        assert f.read() == b"PK-test"
