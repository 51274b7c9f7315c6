"""End-to-end jobs over real sources (paths), composed from the operators.

* ``build_corpus_job``: raw sets -> clean pairs -> split -> one partitioned write.
* ``label_and_fit_job``: train split -> alignment + labels -> vocabulary (reused
  from storage when built with the same parameters) -> tagger tables.
* ``evaluate_job``: test split -> per-language sample -> corrector -> report.
* ``prompt_job``: pairs -> prompts -> any generator -> cleaned replies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.functions import prompts
from redline.operators import corpus, edits, metrics, scoring, split, tagger, vocab
from redline.plans.session import cut_lineage
from redline.sources import pairs as pair_io


def build_corpus_job(spark: SparkSession, english_paths, multilingual_paths, out: str,
                     fmt: str = "parquet", lang: str = "es", id_col: str = "pair_id") -> DataFrame:
    """The first corpus variant written as one job, one folder per split and
    language. Raw sets must carry a stable ``pair_id``."""
    en = pair_io.read_raw(spark, english_paths)
    multi = pair_io.read_raw(spark, multilingual_paths)
    built = split.hash_split(corpus.build_corpus(en, multi, lang))
    pair_io.write_splits(built, out, fmt=fmt, partition_by=("split", "lang"))
    return corpus.group_counts(spark.read.format(fmt).options(
        **({"header": "true"} if fmt == "csv" else {})).load(out), "split", "lang")


def label_and_fit_job(train: DataFrame, vocab_path: str | None = None, lang: str | None = None,
                      top_k: int = vocab.TOP_K) -> tagger.TaggerModel:
    """Edit labels of the training pairs, the label vocabulary and the tagger."""
    train = corpus.filter_lang(corpus.drop_null_subset(train), lang)
    labelled = cut_lineage(edits.with_labels(train).select("pair_id", "lang", "src_tok", "labels"),
                           "labelled-train")
    v = pair_io.load_vocab(train.sparkSession, vocab_path, lang, top_k) if vocab_path else None
    if v is None:
        v = vocab.label_vocab(vocab.label_counts(edits.edit_table(labelled)), top_k, materialize=False)
        if vocab_path:
            pair_io.save_vocab(v, vocab_path, lang, top_k)
    return tagger.fit(labelled, v)


def evaluate_job(test: DataFrame, corrector: Callable | None = None, model: tagger.TaggerModel | None = None,
                 sample: int | None = 200, lang: str | None = None, set_based: bool = False,
                 max_passes: int = 3) -> DataFrame:
    """Read -> drop nulls -> language filter -> seeded sample -> correct -> report.

    ``corrector`` is any Python factory (run through ``mapInPandas``); ``model``
    runs the Spark tagger instead; neither = the identity baseline."""
    rows = corpus.filter_lang(corpus.drop_null_subset(test), lang)
    rows = split.sample_per_group(rows, sample)
    if model is not None:
        fixed = tagger.correct(rows.select("pair_id", "lang", F.col("incorrect").alias("text")),
                               model, max_passes=max_passes)
        preds = fixed.select("pair_id", F.col("corrected").alias("prediction"))
    else:
        preds = scoring.apply_corrector(rows.select("pair_id", F.col("incorrect").alias("source")),
                                        corrector or scoring.identity_corrector).select("pair_id", "prediction")
    refs = rows.select("pair_id", "lang", F.col("correct").alias("reference"))
    joined = metrics.pair_predictions(preds, refs)
    if set_based:
        return metrics.f05_set(joined, total_row=True)
    return metrics.f05_lcs(joined, total_row=True)


def _prompts(pairs_ranked: DataFrame, few_shot: bool) -> DataFrame:
    test = pairs_ranked.where(F.col("split") == "test")
    if few_shot:
        block = prompts.example_block(split.few_shot_pick(pairs_ranked))
        msg = prompts.few_shot("source", "lang", block)
    else:
        msg = prompts.zero_shot("source")
    return test.select("pair_id", "lang", "source", "target", prompts.chat_wrap(msg, "lang").alias("prompt"))


def _replies(asked: DataFrame, generator: Callable, batch_size: int | None) -> DataFrame:
    gen = scoring.apply_corrector(asked, generator, "prompt", "generated", batched=True, batch_size=batch_size)
    # a failed generation gives the prompt back: nothing is left of it but the source
    return gen.select("pair_id", "lang", "source", "target",
                      prompts.clean_reply(prompts.cut_prompt("generated", "prompt"), "source").alias("prediction"),
                      "had_error")


def prompt_job(pairs_ranked: DataFrame, generator: Callable, few_shot: bool = False,
               batch_size: int | None = None) -> DataFrame:
    """Prompts for the test rows, generation through ``apply_corrector`` in
    batches (``generator() -> fn(list[str]) -> list[str]``), then the
    prompt cut and reply cleaning; a failed generation falls back to the source."""
    return _replies(_prompts(pairs_ranked, few_shot), generator, batch_size)


REPLY = "pair_id long, lang string, source string, target string, prediction string, had_error boolean"


def resumable_prompt_job(pairs_ranked: DataFrame, generator: Callable, out: str, few_shot: bool = False,
                         batch_size: int | None = None, slices: int = 16) -> DataFrame:
    """M6 for generators that cost more than anything else: replies are kept by
    ``pair_id`` in ``out``, and a restart sends no kept prompt again.

    Prompts go out in ``slices`` by a hash of ``pair_id``. A slice's replies are
    appended in one write, which commits whole or not at all, and slices whose
    pairs are all answered are not run. A restart therefore repeats at most the slice
    at hand. Rows that failed (``had_error``) are kept too; delete them from
    ``out`` to ask again."""
    spark = pairs_ranked.sparkSession
    asked = _prompts(pairs_ranked, few_shot).withColumn("_slice", F.pmod(F.xxhash64("pair_id"), F.lit(slices)).cast("int"))
    kept = _kept_replies(spark, out)
    todo = cut_lineage(asked.join(kept.select("pair_id"), "pair_id", "left_anti"), "prompts-open", partition_by=("_slice",))
    for s in sorted(r["_slice"] for r in todo.select("_slice").distinct().collect()):      # at most ``slices`` rows
        part = todo.where(F.col("_slice") == s).drop("_slice")
        _replies(part, generator, batch_size).write.mode("append").parquet(out)
    return _kept_replies(spark, out)


def _kept_replies(spark: SparkSession, out: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], REPLY)
    return spark.read.schema(REPLY).parquet(out)
