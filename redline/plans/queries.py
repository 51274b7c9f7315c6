"""Registered queries: one per operator group (see README for the map).

Each takes ``(spark, sf_dir)`` and returns a DataFrame built from the given
tables (``documents`` via the ``gec_pairs`` fixture, ``conversations``,
``embeddings``, ``events``); no query runs on made-up input alone and none
cuts rows or texts to stay cheap. Column names match the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.functions import prompts
from redline.functions.text import norm_text, py_strip, seeded_hash, tokens
from redline.operators import corpus, edits, encode, metrics, runs, scoring, split, tagger, vocab
from redline.operators.align import alignment, balanced, lcs_length
from redline.plans import jobs
from redline.plans.session import cut_lineage, scratch_path
from redline.sources import fixtures
from redline.sources import pairs as pair_io

EVAL_SAMPLE = 200


# ---------------------------------------------------------------- building blocks

def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.gec_pairs(spark, sf_dir)


def clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First corpus variant: English + Spanish, nulls and blanks removed."""
    p = pairs(spark, sf_dir)
    return corpus.build_corpus(fixtures.raw_english(p), fixtures.raw_multilingual(p), "es")


def noop_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second corpus variant: all languages, real corrections only."""
    p = pairs(spark, sf_dir)
    return corpus.noop_filtered_pairs(fixtures.raw_english(p), fixtures.raw_multilingual(p))


def split_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.hash_split(clean_corpus(spark, sf_dir))


def eval_sample(spark: SparkSession, sf_dir: str, sample: int | None = EVAL_SAMPLE) -> DataFrame:
    """Test rows, sampled per language; stored, as corrections and references read them."""
    test = split_corpus(spark, sf_dir).where(F.col("split") == "test")
    return cut_lineage(split.sample_per_group(test, sample), "eval-sample")


def identity_eval_rows(spark: SparkSession, sf_dir: str, sample: int | None = EVAL_SAMPLE,
                       sampled: DataFrame | None = None) -> DataFrame:
    """Test rows, sampled per language, corrected by the identity corrector (M1),
    joined back to the references (J1)."""
    sampled = eval_sample(spark, sf_dir, sample) if sampled is None else sampled
    preds = scoring.apply_corrector(
        sampled.select("pair_id", F.col("incorrect").alias("source")),
        scoring.identity_corrector, "source", "prediction")
    refs = sampled.select("pair_id", "lang", F.col("correct").alias("reference"))
    return metrics.pair_predictions(preds, refs)


# ---------------------------------------------------------------- queries

def q_gec_pairs(spark, sf_dir):
    return pairs(spark, sf_dir)


def q_corpus_clean(spark, sf_dir):
    return clean_corpus(spark, sf_dir)


def q_corpus_noop_filtered(spark, sf_dir):
    return noop_corpus(spark, sf_dir)


def q_lang_counts(spark, sf_dir):
    return corpus.lang_counts(noop_corpus(spark, sf_dir))


def q_split_lang_counts(spark, sf_dir):
    return corpus.group_counts(split_corpus(spark, sf_dir), "split", "lang")


def q_split_exact(spark, sf_dir):
    return split.exact_split(clean_corpus(spark, sf_dir)).select("pair_id", "lang", "split")


def q_split_75_25(spark, sf_dir):
    return split.ratio_split(noop_corpus(spark, sf_dir)).select("pair_id", "lang", "split")


def q_sample_per_lang(spark, sf_dir):
    test = split_corpus(spark, sf_dir).where(F.col("split") == "test")
    return split.sample_per_group(test, EVAL_SAMPLE).select("pair_id", "lang")


def q_tokens_norm(spark, sf_dir):
    p = pairs(spark, sf_dir).where(F.col("incorrect").isNotNull())
    return p.select("pair_id", F.size(tokens("incorrect")).alias("n_tokens"),
                    norm_text("incorrect").alias("norm"), py_strip("incorrect").alias("stripped"))


def q_lcs_pairs(spark, sf_dir):
    c = clean_corpus(spark, sf_dir)
    return c.select("pair_id", lcs_length(tokens("incorrect"), tokens("correct")).alias("lcs"))


def _identity_all(spark, sf_dir):
    c = clean_corpus(spark, sf_dir)
    return c.select("pair_id", "lang", F.col("incorrect").alias("prediction"),
                    F.col("correct").alias("reference"))


def q_f05_lcs_by_lang(spark, sf_dir):
    return metrics.f05_lcs(_identity_all(spark, sf_dir), total_row=True)


def q_f05_set_by_lang(spark, sf_dir):
    return metrics.f05_set(_identity_all(spark, sf_dir), total_row=True)


def q_exact_match_by_lang(spark, sf_dir):
    return metrics.exact_match(_identity_all(spark, sf_dir))


def q_eval_identity(spark, sf_dir):
    """M5 flagship: test split -> 200 per language -> identity corrector ->
    LCS-F0.5 + exact match by language, with a total row."""
    return metrics.f05_lcs(identity_eval_rows(spark, sf_dir), total_row=True)


def labelled_corpus(spark, sf_dir):
    return edits.with_labels(clean_corpus(spark, sf_dir))


def train_edits(spark, sf_dir, materialize: bool = False):
    """Edit table of the training split. With ``materialize`` the labelled set
    is written once to the shared folder, for queries that read it twice."""
    train = split_corpus(spark, sf_dir).where(F.col("split") == "train")
    labelled = edits.with_labels(train).select("pair_id", "lang", "src_tok", "labels")
    if materialize:
        labelled = cut_lineage(labelled, "labelled-train")
    return edits.edit_table(labelled)


def q_align_pairs(spark, sf_dir):
    """E2 on pairs dealt out by their cost (words x words)."""
    c = clean_corpus(spark, sf_dir).select("pair_id", tokens("incorrect").alias("src_tok"), tokens("correct").alias("tgt_tok"))
    # dealing out reads the rows twice: for their costs and for their places
    x = balanced(cut_lineage(c, "align-rows")).select("pair_id", alignment("src_tok", "tgt_tok").alias("alignment"))
    return x.select("pair_id", edits.alignment_text("alignment").alias("alignment"),
                    F.size("alignment").cast("bigint").alias("n_matches"))


def q_edit_table(spark, sf_dir):
    return edits.edit_table(labelled_corpus(spark, sf_dir)).select(
        "pair_id", "lang", F.col("pos").cast("bigint").alias("pos"), "token", "label")


def q_apply_gold_edits(spark, sf_dir):
    x = labelled_corpus(spark, sf_dir)
    return x.select("pair_id", edits.apply_labels("src_tok", "labels").alias("applied"))


def q_roundtrip_audit(spark, sf_dir):
    return edits.roundtrip(labelled_corpus(spark, sf_dir))


def q_label_counts(spark, sf_dir):
    return vocab.label_counts(train_edits(spark, sf_dir)).withColumn(
        "first_pos", F.col("first_pos").cast("bigint"))


def q_label_vocab(spark, sf_dir):
    return vocab.label_vocab(vocab.label_counts(train_edits(spark, sf_dir)))


def q_label_ids(spark, sf_dir):
    e = train_edits(spark, sf_dir, materialize=True)
    v = vocab.label_vocab(vocab.label_counts(e))
    return vocab.label_ids(e, v).select("pair_id", F.col("pos").cast("bigint").alias("pos"), "label_id")


def fitted_tagger(spark, sf_dir, labelled=None):
    """Fit on the training split. The labelled training set (alignment UDF
    output) is materialised once (a caller that has it stored gives it); vocabulary
    and tables are built from it."""
    if labelled is None:
        train = split_corpus(spark, sf_dir).where(F.col("split") == "train")
        labelled = cut_lineage(edits.with_labels(train).select(
            "pair_id", "lang", "src_tok", "labels"))
    # labelled is stored already; fit stores the vocabulary itself
    v = vocab.label_vocab(vocab.label_counts(edits.edit_table(labelled)), materialize=False)
    return tagger.fit(labelled, v)


def q_tagger_fit(spark, sf_dir):
    return _levels(fitted_tagger(spark, sf_dir))


def _levels(m):
    tri = m.tri.select(F.lit("tri").alias("level"), "lang", "prev", "word", "next",
                       F.col("tri_id").alias("label_id"), F.col("tri_n").alias("n_ctx"))
    bi = m.bi.select(F.lit("bi").alias("level"), "lang", "prev", "word", F.lit(None).cast("string").alias("next"),
                     F.col("bi_id").alias("label_id"), F.col("bi_n").alias("n_ctx"))
    uni = m.uni.select(F.lit("uni").alias("level"), "lang", F.lit(None).cast("string").alias("prev"), "word",
                       F.lit(None).cast("string").alias("next"), F.col("uni_id").alias("label_id"),
                       F.col("uni_n").alias("n_ctx"))
    return tri.unionByName(bi).unionByName(uni)


def _test_text(spark, sf_dir):
    test = split_corpus(spark, sf_dir).where(F.col("split") == "test")
    return test.select("pair_id", "lang", F.col("incorrect").alias("text"))


def q_tagger_tag(spark, sf_dir):
    m = fitted_tagger(spark, sf_dir)
    t = tagger.tag(_test_text(spark, sf_dir), m)
    return t.select("pair_id", F.array_join("labels", " ").alias("labels"))


def q_correct_iter(spark, sf_dir):
    m = fitted_tagger(spark, sf_dir)
    out = tagger.correct(_test_text(spark, sf_dir), m, max_passes=3)
    return out.select("pair_id", "corrected", "passes_used")


def tagger_eval_rows(spark, sf_dir, sampled=None):
    sampled = eval_sample(spark, sf_dir) if sampled is None else sampled
    m = fitted_tagger(spark, sf_dir)
    fixed = tagger.correct(sampled.select("pair_id", "lang", F.col("incorrect").alias("text")), m)
    refs = sampled.select("pair_id", F.col("correct").alias("reference"))
    return metrics.pair_predictions(fixed.select("pair_id", "lang", F.col("corrected").alias("prediction")), refs)


def q_eval_tagger(spark, sf_dir):
    return metrics.f05_lcs(tagger_eval_rows(spark, sf_dir), total_row=True)


def q_system_compare(spark, sf_dir):
    """Set-based F0.5 per (system, language): identity vs tagger."""
    sampled = eval_sample(spark, sf_dir)
    ident = identity_eval_rows(spark, sf_dir, sampled=sampled).select(
        F.lit("identity").alias("system"), "lang", "prediction", "reference")
    tag_rows = tagger_eval_rows(spark, sf_dir, sampled).select(
        F.lit("tagger").alias("system"), "lang", "prediction", "reference")
    return metrics.f05_set(ident.unionByName(tag_rows), group_cols=("system", "lang"))


def q_val_loss(spark, sf_dir):
    # both splits are labelled in one pass and stored by split
    both = split_corpus(spark, sf_dir).where(F.col("split").isin("train", "val"))
    both = cut_lineage(edits.with_labels(both).select("pair_id", "lang", "src_tok", "labels", "split"), "labelled", partition_by=("split",))
    train, val = (both.where(F.col("split") == name).drop("split") for name in ("train", "val"))
    m = fitted_tagger(spark, sf_dir, train)
    batches = split.minibatches(val.select("pair_id"), 32, shuffle=False).select("pair_id", "batch")
    return tagger.validation_nll(val, m, batches)


# ---------------------------------------------------------------- prompts and replies

def ranked_noop(spark, sf_dir):
    return split.ratio_split(noop_corpus(spark, sf_dir))


def q_few_shot_pick(spark, sf_dir):
    return split.few_shot_pick(ranked_noop(spark, sf_dir)).select("pair_id", "source", "target")


def _prompt_rows(spark, sf_dir, materialize: bool = False):
    r = ranked_noop(spark, sf_dir)
    if materialize:                             # the examples and the prompts each read it
        r = cut_lineage(r, "ranked")
    test = r.where((F.col("split") == "test") & F.col("lang").isin("en", "es"))
    return test, prompts.example_block(split.few_shot_pick(r))


def q_zero_shot_prompts(spark, sf_dir):
    test, _ = _prompt_rows(spark, sf_dir)
    return test.select("pair_id", "lang", prompts.chat_wrap(prompts.zero_shot("source"), "lang").alias("prompt"))


def q_few_shot_prompts(spark, sf_dir):
    test, block = _prompt_rows(spark, sf_dir, materialize=True)
    msg = prompts.few_shot("source", "lang", block)
    return test.select("pair_id", "lang", prompts.chat_wrap(msg, "lang").alias("prompt"))


def q_reply_clean(spark, sf_dir):
    """F9-F11 on replies synthesised from the targets: each prompt's generated
    text is the prompt plus a reply that carries one of the known prefixes, is
    blank, or is missing (a failed generation)."""
    test, _ = _prompt_rows(spark, sf_dir)
    prompt = prompts.chat_wrap(prompts.zero_shot("source"), "lang")
    h = seeded_hash(7, "pair_id") % 6
    t = F.col("target")
    reply = (F.when(h == 0, F.concat(F.lit("Corrected: "), t))
             .when(h == 1, F.concat(F.lit("Answer: Corrected: "), t))
             .when(h == 2, F.lit("  "))
             .when(h == 3, F.concat(F.lit("corregida:  "), t, F.lit(" ")))
             .when(h == 4, F.concat(F.lit("Corrected: Answer: "), t)))
    x = test.select("pair_id", "source", prompt.alias("prompt"), reply.alias("reply"))
    generated = F.concat(F.col("prompt"), F.lit(" "), F.col("reply"))
    return x.select("pair_id", prompts.clean_reply(prompts.cut_prompt(generated, F.col("prompt")),
                                                   F.col("source")).alias("prediction"),
                    F.col("reply").isNull().alias("had_error"))


# ---------------------------------------------------------------- encoding

def _train_tok(spark, sf_dir):
    train = split_corpus(spark, sf_dir).where(F.col("split") == "train")
    return train.select("pair_id", "lang", tokens("incorrect").alias("src_tok"),
                        tokens("correct").alias("tgt_tok"))


def _ints(c):
    return F.array_join(c.cast("array<string>"), " ")


def q_token_vocab(spark, sf_dir):
    t = _train_tok(spark, sf_dir)
    texts = t.select(F.concat("src_tok", "tgt_tok").alias("tok"))
    return encode.token_vocab(texts)


def q_encode_seq2seq(spark, sf_dir):
    # read by the vocabulary and by the rows: the words are stored, they cost more than the texts
    t = cut_lineage(_train_tok(spark, sf_dir).drop("lang"), "train-words")
    texts = t.select(F.concat("src_tok", "tgt_tok").alias("tok"))
    v = cut_lineage(encode.token_vocab(texts), "token-vocab")
    # words beyond the frame get no id: they are cut off before the lookup, not after it
    seen = t.select("pair_id", *[F.slice(c, 1, encode.MAX_LEN - 2).alias(c) for c in ("src_tok", "tgt_tok")])
    x = encode.token_ids(seen, v, {"src_tok": "src_ids", "tgt_tok": "tgt_ids"})
    size = encode.MAX_LEN
    x = x.select("pair_id", encode.frame(F.col("src_ids")).alias("src"), encode.frame(F.col("tgt_ids")).alias("tgt"),
                 *[F.least(F.size(c) + 2, F.lit(size)).alias(n) for c, n in (("src_ids", "n_src"), ("tgt_ids", "n_tgt"))])
    src, tgt, n_src, n_tgt = F.col("src"), F.col("tgt"), F.col("n_src"), F.col("n_tgt")
    tgt_in, tgt_out = encode.shift(tgt)
    return x.select("pair_id", encode.ints_text(src, n_src, encode.PAD_ID, size).alias("input_ids"),
                    encode.ints_text(encode.attention_mask(src), n_src, 0, size).alias("attention_mask"),
                    encode.ints_text(tgt_in, F.least(n_tgt, F.lit(size - 1)), encode.PAD_ID, size - 1).alias("tgt_input"),
                    encode.ints_text(tgt_out, n_tgt - 1, encode.IGNORE, size - 1).alias("tgt_output"))


def q_encode_tags(spark, sf_dir):
    """label ids per word (J2), then the fixed-length tag rows. Every clean
    pair has at least one word, so the word count is the length of its id list."""
    train = split_corpus(spark, sf_dir).where(F.col("split") == "train")
    labelled = cut_lineage(edits.with_labels(train).select("pair_id", "labels"), "labelled-train")
    v = vocab.label_vocab(vocab.label_counts(labelled.select("pair_id", F.posexplode("labels").alias("pos", "label"))))
    # labels beyond the frame get no id: they are cut off before the lookup, not after it
    seen = labelled.where(F.size("labels") > 0).select("pair_id", F.slice("labels", 1, encode.MAX_LEN - 2).alias("labels"))
    ids = seen.select("pair_id", vocab.label_id_arrays("labels", v).alias("_l")).groupBy("pair_id").agg(F.collect_list("_l").alias("_a"))
    # the words of a repeated pair_id are one list, by position
    at = F.flatten(F.transform("_a", lambda a: F.transform(a, lambda x, i: F.struct(i.alias("pos"), x.alias("label_id")))))
    lids = F.when(F.size("_a") == 1, F.col("_a")[0]).otherwise(F.transform(F.sort_array(at), lambda x: x.getField("label_id")))
    ids = ids.select("pair_id", lids.alias("lids"))
    wids = encode.word_ids(F.size("lids"))
    return ids.select("pair_id", _ints(encode.tag_labels(wids, F.col("lids"))).alias("labels"))


def q_argmax_labels(spark, sf_dir):
    emb = fixtures.read_table(spark, sf_dir, "embeddings")
    train = split_corpus(spark, sf_dir).where(F.col("split") == "train")
    v = vocab.label_vocab(vocab.label_counts(edits.edit_table(edits.with_labels(train))))
    ids = emb.select("vec_id", encode.argmax(F.col("embedding")).alias("label_id"))
    return vocab.id_labels(ids, v).select("vec_id", "label_id", "label")


def _candidates(spark, sf_dir):
    """Hypotheses per sentence derived from ``embeddings``: one per vector
    element (rank = position, score = value); token counts and finished flags
    follow from the ids; every fifth sentence has no finished hypothesis."""
    emb = fixtures.read_table(spark, sf_dir, "embeddings")
    x = emb.select(F.col("vec_id").alias("sent_id"), F.posexplode("embedding").alias("rank", "score"))
    return x.select("sent_id", F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"),
                    (2 + (F.col("sent_id") + F.col("rank")) % 7).cast("int").alias("n_tokens"),
                    (((F.col("sent_id") + F.col("rank")) % 3 != 0) & (F.col("sent_id") % 5 != 0)).alias("finished"),
                    F.concat(F.lit("cand-"), F.col("rank").cast("string")).alias("text"))


def q_nbest_select(spark, sf_dir):
    return scoring.nbest_select(_candidates(spark, sf_dir)).select("sent_id", "text", "rank", "any_finished")


def q_top_candidates(spark, sf_dir):
    return scoring.top_candidates(_candidates(spark, sf_dir), 4).select("sent_id", "rank", "pos")


def q_minibatches(spark, sf_dir):
    train = split_corpus(spark, sf_dir).where(F.col("split") == "train").select("pair_id")
    return split.minibatches(train, 32, seed=42, epoch=0).select("pair_id", "batch", "batch_pos")


# ---------------------------------------------------------------- runs

def run_table(spark, sf_dir):
    """Run records derived from ``events``: run = user, epoch = day of month,
    losses = exact integer sums of cents over the day's events."""
    ev = fixtures.read_table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("bigint")
    return ev.groupBy(F.col("user_id").alias("run_id"), F.dayofmonth("ts").alias("epoch")).agg(
        (F.sum(cents) / F.count(F.lit(1)) / 100.0).alias("val_loss"))


def q_best_run(spark, sf_dir):
    return runs.best_checkpoint(run_table(spark, sf_dir))


def q_run_config(spark, sf_dir):
    ev = fixtures.read_table(spark, sf_dir, "events")
    stored = F.from_json("props", "map<string,string>")
    return ev.select("event_id", F.explode(runs.merged_config(stored)).alias("key", "value"))


def q_csv_roundtrip(spark, sf_dir):
    """S4 then S3: write the clean corpus as CSV (split folders) into the shared
    checkpoint folder and read it back with pandas NA semantics."""
    path = scratch_path(spark, "csv-roundtrip")
    pair_io.write_splits(split_corpus(spark, sf_dir), path, fmt="csv")
    back = pair_io.read_pairs_csv(spark, path)
    return back.select("pair_id", "incorrect", "correct", "transformation", "lang")


def q_preview(spark, sf_dir):
    """The first five pairs in ``pair_id`` order (a top-n, no full sort)."""
    return corpus.preview(clean_corpus(spark, sf_dir))


def q_distinct_langs(spark, sf_dir):
    """Languages present in the multilingual set."""
    return corpus.distinct_langs(fixtures.raw_multilingual(pairs(spark, sf_dir)))


def q_report_rounded(spark, sf_dir):
    """F12 + A8: the LCS report with 4-place copies next to the exact values."""
    return metrics.round4(metrics.f05_lcs(_identity_all(spark, sf_dir), total_row=True))


# ---------------------------------------------------------------- stores and plug points

def q_raw_build(spark, sf_dir):
    """S1 + S2: the raw sets are written as one split folder (English) and as two
    (multilingual), read back in one read each, and built into the clean corpus."""
    p = pairs(spark, sf_dir)
    root = scratch_path(spark, "raw-sets")
    fixtures.raw_english(p).write.parquet(f"{root}/english/train")
    multi = fixtures.raw_multilingual(p).withColumn("part", F.when(F.col("pair_id") % 4 == 0, "test").otherwise("train"))
    multi.write.partitionBy("part").parquet(f"{root}/multilingual")
    en = pair_io.read_raw(spark, f"{root}/english/train")
    rest = pair_io.read_raw(spark, [f"{root}/multilingual/part=train", f"{root}/multilingual/part=test"])
    return corpus.build_corpus(en, rest, "es")


def q_csv_mixed_layouts(spark, sf_dir):
    """S3 over a folder whose files have their columns in three orders, one without ``pair_id``."""
    path = scratch_path(spark, "csv-mixed")
    c = cut_lineage(clean_corpus(spark, sf_dir), "csv-mixed-rows")
    layouts = (["pair_id", "incorrect", "correct", "transformation", "lang"], ["lang", "transformation", "correct", "incorrect", "pair_id"],
               ["incorrect", "correct", "transformation", "lang"])
    for i, names in enumerate(layouts):
        part = c.where(F.col("pair_id") % 3 == i).select(*names, F.lit(f"layout-{i}").alias("part"))
        pair_io.write_splits(part, path, fmt="csv", partition_by=("part",), mode="append")
    return pair_io.read_pairs_csv(spark, path).select("pair_id", "incorrect", "correct", "transformation", "lang")


def q_label_vocab_by_lang(spark, sf_dir):
    """S6 + A4: a vocabulary per language in one job."""
    return vocab.label_vocab_by(train_edits(spark, sf_dir), "lang", LANG_TOP_K)


LANG_TOP_K = 500


def q_tagger_fit_by_lang(spark, sf_dir):
    """A tagger per language, each with its own label ids, in one fit."""
    train = split_corpus(spark, sf_dir).where(F.col("split") == "train")
    labelled = cut_lineage(edits.with_labels(train).select("pair_id", "lang", "src_tok", "labels"))
    v = vocab.label_vocab_by(edits.edit_table(labelled), "lang", LANG_TOP_K, materialize=False)
    return _levels(tagger.fit(labelled, v))


def q_vocab_store(spark, sf_dir):
    """A vocabulary is saved, reused where its parameters match, and rebuilt and
    saved as the next version where they don't."""
    path = scratch_path(spark, "vocab-store")
    counts = cut_lineage(vocab.label_counts(train_edits(spark, sf_dir)), "store-counts")
    out = None
    for top_k in (vocab.TOP_K, vocab.TOP_K, SMALL_TOP_K):
        stored = pair_io.load_vocab(spark, path, None, top_k)
        used = "stored"
        if stored is None:
            used = "built"
            pair_io.save_vocab(vocab.label_vocab(counts, top_k, materialize=False), path, None, top_k)
            stored = pair_io.load_vocab(spark, path, None, top_k)
        part = stored.withColumn("used", F.lit(used)).withColumn("top_k", F.lit(top_k))
        out = part if out is None else out.unionByName(part)
    return out


SMALL_TOP_K = 50
PROMPT_BATCH = 4


def _exclaiming():
    """A corrector of whole batches that fails on any batch holding a text whose
    length divides by 7."""
    def fn(batch):
        if len(batch) > PROMPT_BATCH or any(len(s) % 7 == 0 for s in batch):
            raise ValueError("a text of this length")
        return [s + "!" for s in batch]
    return fn


def q_corrector_batched(spark, sf_dir):
    """M1 in fixed batches of 4: a failing batch is repeated row by row, and only
    the rows that fail are flagged."""
    test = split_corpus(spark, sf_dir).where(F.col("split") == "test").select("pair_id", F.col("incorrect").alias("source"))
    out = scoring.apply_corrector(test, _exclaiming, batched=True, batch_size=PROMPT_BATCH)
    return out.select("pair_id", "prediction", "had_error")


def _echo():
    def fn(batch):
        return [f"{p} Corrected: {p.split('Sentence: ')[-1].removesuffix('Corrected: [/INST]').removesuffix('Corrected:').strip()[::-1]}" for p in batch]
    return fn


def q_prompt_replies(spark, sf_dir):
    """M6: prompts, a deterministic generator (the sentence backwards) and cleaned
    replies, kept by pair; the second run finds every reply and sends no prompt."""
    out = scratch_path(spark, "replies")
    r = cut_lineage(ranked_noop(spark, sf_dir), "ranked")
    jobs.resumable_prompt_job(r, _echo, out, batch_size=PROMPT_BATCH, slices=4)
    return jobs.resumable_prompt_job(r, _echo, out, batch_size=PROMPT_BATCH, slices=4).select("pair_id", "lang", "prediction", "had_error")


TAG_WORDS = 8


def q_tagger_tag_visible(spark, sf_dir):
    """Only the first words are labelled, the others keep themselves."""
    t = tagger.tag(_test_text(spark, sf_dir), fitted_tagger(spark, sf_dir), max_words=TAG_WORDS)
    return t.select("pair_id", F.array_join("labels", " ").alias("labels"))


def _split_words(spark, sf_dir):
    """Training pairs with label ids, cut into tokens of up to four characters."""
    e = train_edits(spark, sf_dir, materialize=True)
    v = vocab.label_vocab(vocab.label_counts(e))
    ids = vocab.label_ids(e, v).groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("pos", "label_id", "token"))).alias("_p"))
    n = F.transform("_p", lambda x: F.ceil(F.length(x["token"]) / 4).cast("int"))
    return ids.select("pair_id", F.transform("_p", lambda x: x["label_id"]).alias("lids"), encode.split_word_ids(n).alias("wids"))


def q_encode_split_words(spark, sf_dir):
    """W7 + F15: several tokens a word; only a word's first carries its label."""
    x = _split_words(spark, sf_dir)
    return x.select("pair_id", _ints(encode.tag_labels(F.col("wids"), F.col("lids"))).alias("labels"),
                    _ints(F.transform("wids", lambda w: F.coalesce(w, F.lit(-1)))).alias("word_ids"))


def q_masked_loss(spark, sf_dir):
    """A10: loss over label arrays masked with -100, by batches of 16 in pair order;
    losses are derived from the label ids."""
    x = _split_words(spark, sf_dir).select("pair_id", encode.tag_labels(F.col("wids"), F.col("lids")).alias("labels"))
    x = x.withColumn("losses", F.transform("labels", lambda l, i: (F.pmod(l * 7 + i, F.lit(64)) / 8.0)))
    b = split.minibatches(x.select("pair_id"), 16, shuffle=False).select("pair_id", "batch")
    return runs.masked_array_loss(x.join(b, "pair_id"))


def q_run_config_overrides(spark, sf_dir):
    """Stored values that override defaults, derived from the events' columns."""
    ev = fixtures.read_table(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    stored = F.create_map(F.lit("max_len"), F.when(F.col("user_id") % 2 == 0, (64 + F.col("user_id") % 64).cast("string")).otherwise(none),
                          F.lit("freeze_encoder"), (F.col("value") > 50).cast("string"), F.lit("encoder"), F.col("event_type"))
    stored = F.when(F.col("user_id") % 5 != 0, stored)
    return ev.select("event_id", F.explode(runs.merged_config(stored)).alias("key", "value"))


QUERIES = {
    "raw_build": q_raw_build,
    "csv_mixed_layouts": q_csv_mixed_layouts,
    "label_vocab_by_lang": q_label_vocab_by_lang,
    "tagger_fit_by_lang": q_tagger_fit_by_lang,
    "vocab_store": q_vocab_store,
    "corrector_batched": q_corrector_batched,
    "prompt_replies": q_prompt_replies,
    "tagger_tag_visible": q_tagger_tag_visible,
    "encode_split_words": q_encode_split_words,
    "masked_loss": q_masked_loss,
    "run_config_overrides": q_run_config_overrides,
    "gec_pairs": q_gec_pairs,
    "corpus_clean": q_corpus_clean,
    "corpus_noop_filtered": q_corpus_noop_filtered,
    "lang_counts": q_lang_counts,
    "split_lang_counts": q_split_lang_counts,
    "split_exact": q_split_exact,
    "split_75_25": q_split_75_25,
    "sample_per_lang": q_sample_per_lang,
    "tokens_norm": q_tokens_norm,
    "lcs_pairs": q_lcs_pairs,
    "f05_lcs_by_lang": q_f05_lcs_by_lang,
    "f05_set_by_lang": q_f05_set_by_lang,
    "exact_match_by_lang": q_exact_match_by_lang,
    "eval_identity": q_eval_identity,
    "align_pairs": q_align_pairs,
    "edit_table": q_edit_table,
    "apply_gold_edits": q_apply_gold_edits,
    "roundtrip_audit": q_roundtrip_audit,
    "label_counts": q_label_counts,
    "label_vocab": q_label_vocab,
    "label_ids": q_label_ids,
    "tagger_fit": q_tagger_fit,
    "tagger_tag": q_tagger_tag,
    "correct_iter": q_correct_iter,
    "eval_tagger": q_eval_tagger,
    "system_compare": q_system_compare,
    "val_loss": q_val_loss,
    "few_shot_pick": q_few_shot_pick,
    "zero_shot_prompts": q_zero_shot_prompts,
    "few_shot_prompts": q_few_shot_prompts,
    "reply_clean": q_reply_clean,
    "token_vocab": q_token_vocab,
    "encode_seq2seq": q_encode_seq2seq,
    "encode_tags": q_encode_tags,
    "argmax_labels": q_argmax_labels,
    "nbest_select": q_nbest_select,
    "top_candidates": q_top_candidates,
    "minibatches": q_minibatches,
    "best_run": q_best_run,
    "run_config": q_run_config,
    "csv_roundtrip": q_csv_roundtrip,
    "preview": q_preview,
    "distinct_langs": q_distinct_langs,
    "report_rounded": q_report_rounded,
}
