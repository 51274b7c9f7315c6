"""CSV round trip with pandas semantics, vocabulary store, corpus stream."""

import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from redline.sources import pairs as pair_io
from redline.streaming import corpus_stream

SMALL = "/root/testdata/sf0.001"

TRICKY = [
    (1, 'say "hi"', "line1\nline2", "none", "en"),
    (2, "  lead and trail  ", "back\\slash", "dup", "en"),
    (3, "NA", "ok", "drop", "en"),
    (4, "None", "ok", "drop", "es"),
    (5, "", "ok", "drop", "es"),
    (6, None, "ok", "drop", "es"),
    (7, "fine", "fine too", None, "en"),
]


def test_csv_roundtrip_matches_pandas(spark):
    df = spark.createDataFrame(TRICKY, pair_io.PAIR_SCHEMA).withColumn("split", F.lit("train"))
    out = tempfile.mkdtemp(prefix="redline-csv-")
    pair_io.write_splits(df, out, fmt="csv")
    back = pair_io.read_pairs_csv(spark, out).orderBy("pair_id").collect()
    # what pandas reads from the same files
    files = [os.path.join(r, f) for r, _, fs in os.walk(out) for f in fs if f.endswith(".csv")]
    pdf = pd.concat([pd.read_csv(f) for f in files]).dropna(subset=["incorrect", "correct"])
    assert sorted(pdf.pair_id.tolist()) == [r.pair_id for r in back] == [1, 2, 7]
    got = {r.pair_id: (r.incorrect, r.correct) for r in back}
    assert got[1] == ('say "hi"', "line1\nline2")
    assert got[2] == ("  lead and trail  ", "back\\slash")
    # keeping literal NA texts is an option
    kept = pair_io.read_pairs_csv(spark, out, na_tokens=()).select("pair_id").collect()
    assert {r.pair_id for r in kept} >= {1, 2, 3, 4, 7}


def test_vocab_store_checks_parameters(spark):
    v = spark.createDataFrame([("$KEEP", 0, 9), ("$DELETE", 1, 3)], "label string, label_id int, freq long")
    path = os.path.join(tempfile.mkdtemp(prefix="redline-vocab-"), "v")
    pair_io.save_vocab(v, path, "es", 5000)
    assert pair_io.load_vocab(spark, path, "es", 5000).count() == 2
    assert pair_io.load_vocab(spark, path, "en", 5000) is None
    assert pair_io.load_vocab(spark, path + "-absent", "es", 5000) is None


def test_corpus_stream_equals_batch(spark):
    from redline.operators import corpus, split
    from redline.sources import fixtures

    out = tempfile.mkdtemp(prefix="redline-stream-out-")
    ckpt = tempfile.mkdtemp(prefix="redline-stream-ckpt-")
    docs_dir = tempfile.mkdtemp(prefix="redline-stream-in-")
    spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3).write.mode("overwrite").parquet(docs_dir)
    q = corpus_stream.start(spark, docs_dir, out, ckpt)
    q.awaitTermination(300)
    streamed = spark.read.parquet(out).select("pair_id", "split", "lang")
    p = fixtures.gec_pairs(spark, SMALL)
    batch = split.hash_split(corpus.build_corpus(fixtures.raw_english(p), fixtures.raw_multilingual(p), "es"))
    batch = batch.select("pair_id", "split", "lang")
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0


def test_corpus_stream_resumes_from_checkpoint(spark):
    from pyspark.sql import functions as F

    from redline.operators import corpus, split
    from redline.sources import fixtures

    out = tempfile.mkdtemp(prefix="redline-stream2-out-")
    ckpt = tempfile.mkdtemp(prefix="redline-stream2-ckpt-")
    docs_dir = tempfile.mkdtemp(prefix="redline-stream2-in-")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.where(F.col("doc_id") % 2 == 0).write.mode("append").parquet(docs_dir)
    corpus_stream.start(spark, docs_dir, out, ckpt).awaitTermination(300)
    first = spark.read.parquet(out).count()
    # new input arrives; the restarted query reads only the new file
    docs.where(F.col("doc_id") % 2 == 1).write.mode("append").parquet(docs_dir)
    corpus_stream.start(spark, docs_dir, out, ckpt).awaitTermination(300)
    streamed = spark.read.parquet(out).select("pair_id", "split", "lang")
    p = fixtures.gec_pairs(spark, SMALL)
    batch = split.hash_split(corpus.build_corpus(fixtures.raw_english(p), fixtures.raw_multilingual(p), "es"))
    batch = batch.select("pair_id", "split", "lang")
    assert 0 < first < streamed.count() == batch.count()
    assert streamed.select("pair_id").distinct().count() == streamed.count()
    assert streamed.exceptAll(batch).count() == 0
