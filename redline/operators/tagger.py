"""A count-based edit tagger fitted and applied with Spark (M2, M3, M4, M7).

Stands in for the neural tag classifier with the same interface (word ->
label): ``P(label | prev, word, next)`` with back-off to ``(prev, word)``,
``(word)`` and finally ``$KEEP``. Fitting counts the trigrams once, stores them,
sums the shorter contexts from them and takes the argmax (highest count, ties by
lowest ``label_id``); frequent words are counted map-side, so a hot
context ships one partial row per task. Every table carries ``lang``: one
model per language.

Tagging explodes the words with their neighbours (read from the token array by
position, no window), left-joins the three context tables (sort-merge at scale,
broadcast when Spark's size estimate is under the threshold), maps ids back to
labels through the bounded vocabulary (broadcast), and regroups per sentence in
position order. Contexts that hold a large share of the training words are
answered from a bounded table instead (``skew.split_join``), so a hot word
meets no single task. Tagging joins only the decisive contexts (those whose
prediction differs from their back-off; about 2-5% of the model here, since
``$KEEP`` dominates), which gives the same labels.

``correct`` keeps a worklist: each pass regroups only the words that get an edit,
writes its result to the shared checkpoint folder once, and hands only the
sentences that changed to the next pass.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.functions.text import tokens
from redline.operators.edits import KEEP, apply_labels, apply_one
from redline.operators.skew import heavy_keys, split_join
from redline.operators.vocab import id_labels, label_ids
from redline.plans.session import cut_lineage, scratch_path, setting, shuffles_freed

BOS, EOS = "<s>", "</s>"
LOSS_DIGITS = 9
BUCKET_BYTES = 16 << 20         # of the stored training set, per bucket of the trigram counts
MAX_BUCKETS = 1 << 15
HOT_SHARE = 1 / 64              # a word with so many of all words is counted before its rows are dealt out
LEVELS = {
    "tri": ("prev", "word", "next"),
    "bi": ("prev", "word"),
    "uni": ("word",),
}


@dataclass
class TaggerModel:
    tri: DataFrame
    bi: DataFrame
    uni: DataFrame
    vocab: DataFrame
    counts: dict  # level -> (lang, context..., label_id, n)
    materialize: bool = True
    _decisive: dict | None = field(default=None, repr=False, compare=False)
    _partitioned: "TaggerModel | None" = field(default=None, repr=False, compare=False)
    _heavy: dict | None = field(default=None, repr=False, compare=False)
    changes: dict | None = None     # level -> the rows that predict other than ``$KEEP``

    def tables(self) -> dict[str, DataFrame]:
        return {"tri": self.tri, "bi": self.bi, "uni": self.uni}

    def tag_tables(self) -> dict[str, DataFrame]:
        """The tables tagging joins: only the decisive contexts (see
        ``_decisive``), built on first use, stored when the model is, and
        memoised."""
        if self._decisive is None:
            d = _decisive(self.tables(), self.changes)
            if self.materialize:
                d = cut_lineage(d, "tagger-decisive", partition_by=("level",))
            self._decisive = {name: d.where(F.col("level") == name).select(
                "lang", *keys, F.col("label_id").alias(f"{name}_id")) for name, keys in LEVELS.items()}
        return self._decisive

    def heavy_tables(self) -> dict[str, DataFrame]:
        """Per level the contexts that hold ``skew.SHARE`` of the training words or
        more (bounded), with their decisive id or null; memoised."""
        if self._heavy is None:
            none, every = F.lit(None).cast("string"), None
            total = self.uni.select(F.sum("uni_n").cast("double")).scalar()     # every level counts the same words
            # a context is no more frequent than its word: only those of heavy words are summed
            common = F.broadcast(heavy_keys(self.uni, "uni_n", total=total).select("lang", "word"))
            for name, keys in LEVELS.items():
                some = self.tables()[name].join(common, ["lang", "word"], "left_semi")
                hot = heavy_keys(some, f"{name}_n", total=total).select(
                    F.lit(name).alias("level"), "lang", *[F.col(k) if k in keys else none.alias(k) for k in LEVELS["tri"]])
                every = hot if every is None else every.unionByName(hot)
            if self.materialize:
                every = cut_lineage(every, "tagger-hot")
            hot, every = every, None
            for name, keys in LEVELS.items():
                key = ["lang", *keys]
                mine = hot.where(F.col("level") == name)
                # the few heavy contexts are sent to the table, not the table to them
                found = self.tag_tables()[name].join(F.broadcast(mine.select(*key)), key, "left_semi")
                mine = mine.join(F.broadcast(found), key, "left").select(
                    F.lit(name).alias("level"), "lang", *[F.col(k) if k in keys else none.alias(k) for k in LEVELS["tri"]],
                    F.col(f"{name}_id").alias("label_id"))
                every = mine if every is None else every.unionByName(mine)
            if self.materialize:
                every = cut_lineage(every, "tagger-heavy")
            self._heavy = {name: every.where(F.col("level") == name).select("lang", *keys, F.col("label_id").alias(f"{name}_id"))
                           for name, keys in LEVELS.items()}
        return self._heavy

    def partitioned(self) -> "TaggerModel":
        """The same model with each table hash-partitioned on its join keys
        and persisted (memory and disk), for repeated tagging passes: the
        passes then shuffle only the words, never the model again. A lost
        block is rebuilt from the stored table. Memoised per model."""
        if self._partitioned is None:
            parts = int(self.tri.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            keep = {name: t.repartition(parts, "lang", *LEVELS[name]).persist(StorageLevel.MEMORY_AND_DISK)
                    for name, t in self.tag_tables().items()}
            self._partitioned = TaggerModel(keep["tri"], keep["bi"], keep["uni"], self.vocab, self.counts,
                                            False, _decisive={n: keep[n] for n in LEVELS}, _heavy=self.heavy_tables())
        return self._partitioned

    def release(self) -> None:
        """Drop the persisted partitioned copy (after the corrections are written)."""
        if self._partitioned is not None:
            for t in self._partitioned.tables().values():
                t.unpersist()
            self._partitioned = None


def contexts(df: DataFrame, tok_col: str = "src_tok", extra=("labels",),
             max_words: int | None = None) -> DataFrame:
    """One row per word: ``pair_id, lang, pos, prev, word, next`` (+ ``label``
    when a ``labels`` array is given). ``max_words`` marks the words a
    fixed-length model can see (``visible``); all words are kept."""
    t = F.col(tok_col)
    cols = [t.alias("word")]
    names = ["word"]
    if "labels" in extra and "labels" in df.columns:
        cols.append(F.col("labels").alias("label"))
        names.append("label")
    z = df.select("pair_id", "lang", t.alias("_t"),
                  F.posexplode(F.arrays_zip(*cols)).alias("pos", "z"))
    prev = F.coalesce(F.get(F.col("_t"), F.col("pos") - 1), F.lit(BOS))
    nxt = F.coalesce(F.get(F.col("_t"), F.col("pos") + 1), F.lit(EOS))
    visible = F.lit(True) if max_words is None else (F.col("pos") < max_words)
    return z.select("pair_id", "lang", "pos", prev.alias("prev"),
                    *[F.col(f"z.{n}").alias(n) for n in names], nxt.alias("next"),
                    visible.alias("visible"))


def fit(labelled_train: DataFrame, vocab: DataFrame, materialize: bool = True) -> TaggerModel:
    """M2: per-context argmax tables from the training edits.

    Like an ML ``fit`` this is eager when ``materialize``: the trigram counts are
    written once to the shared checkpoint folder, in buckets of ``(lang, prev, word)``,
    and so is the unigram table. The trigram and bigram tables are read off the
    buckets without a shuffle, so neither the tagging passes nor the validation loss
    re-run the training-set alignment or move the model again.
    """
    if materialize:
        vocab = cut_lineage(vocab, "label-vocab")
    ctx = label_ids(contexts(labelled_train), vocab)
    counts = _level_counts(ctx, labelled_train if materialize else None)
    tables, changes = {}, {}
    for name, keys in LEVELS.items():
        t = counts[name].groupBy("lang", *keys).agg(
            *_best("n", "label_id"), F.sum("n").alias(f"{name}_n"))
        t = t.select("lang", *keys, _best_id().alias(f"{name}_id"), f"{name}_n")
        if materialize and name == "uni":
            # a folder for the few words that change: their size is known when they are joined
            t = cut_lineage(t.withColumn("kept", F.col("uni_id") == 0), "tagger-uni", partition_by=("kept",))
            tables[name], changes[name] = t.drop("kept"), t.where(~F.col("kept")).drop("kept")
        else:
            tables[name], changes[name] = t, t.where(F.col(f"{name}_id") != 0)
    return TaggerModel(tables["tri"], tables["bi"], tables["uni"], vocab, counts, materialize, changes=changes)


_ID_SPAN = 1 << 31


def _packed(n: str, label_id: str):
    """Highest count first, ties by lowest id, as one number: any bigint count and
    any int id fit DECIMAL(38,0), and the argmax stays a HashAggregate."""
    wide = F.col(n).cast("decimal(20,0)") * F.lit(_ID_SPAN).cast("decimal(10,0)")
    return (wide + (F.lit(_ID_SPAN - 1) - F.col(label_id)).cast("decimal(10,0)")).cast("decimal(38,0)")


def _packed_id(best: str):
    return (F.lit(_ID_SPAN - 1) - (F.col(best) % F.lit(_ID_SPAN).cast("decimal(10,0)")).cast("bigint")).cast("int")


def _best(n: str, label_id: str) -> tuple[Column, Column]:
    """The argmax of ``_packed`` as two maxima: counts below 2**31 are packed into a
    bigint, which is far cheaper; the decimal is computed for larger ones only."""
    small = F.shiftleft(F.col(n), 31).bitwiseOR(F.lit(_ID_SPAN - 1) - F.col(label_id))
    fits = F.col(n) < _ID_SPAN
    return F.max(F.when(fits, small)).alias("_small"), F.max(F.when(~fits, _packed(n, label_id))).alias("_large")


def _best_id() -> Column:
    small = F.lit(_ID_SPAN - 1) - F.col("_small").bitwiseAND(F.lit(_ID_SPAN - 1).cast("bigint"))
    return F.coalesce(_packed_id("_large"), small.cast("int"))


def _decisive(tables: dict, changes: dict | None = None) -> DataFrame:
    """Only the contexts whose prediction differs from what the back-off below
    them gives: a unigram unless it predicts ``$KEEP``, a bigram unless it
    equals its unigram's prediction, a trigram unless it equals its bigram's.
    Tagging with these tables gives exactly the same labels (by induction on
    the back-off chain), and since ``$KEEP`` dominates they are a small part
    of the model. Every pass then joins the words against far smaller tables.

    A trigram's bigram and a bigram's unigram are in the model, as all count the same
    words, so a level meets only the one below it, and of that only ``changes``: the
    contexts that predict other than ``$KEEP``, which are few."""
    changes = changes or {name: t.where(F.col(f"{name}_id") != 0) for name, t in tables.items()}
    none = F.lit(None).cast("string")
    out, below = None, None
    for name in ("uni", "bi", "tri"):
        t, own, other = tables[name] if below else changes[name], F.col(f"{name}_id"), F.lit(0)
        if below:
            keys = ["lang", *LEVELS[below]]
            few = changes[below].select(*keys, f"{below}_id")
            # bigrams and trigrams lie in the same buckets: the changes are hashed there, the trigrams not sorted
            t = t.join(few.hint("shuffle_hash") if below == "bi" else few, keys, "left")
            other = F.coalesce(f"{below}_id", F.lit(0))
        t = t.where(own != other).select(
            F.lit(name).alias("level"), "lang", *[F.col(k) if k in LEVELS[name] else none.alias(k) for k in LEVELS["tri"]],
            own.alias("label_id"))
        out, below = t if out is None else out.unionByName(t), name
    return out


def _level_counts(ctx: DataFrame, stored: DataFrame | None = None, materialize: bool = True) -> dict:
    """level -> ``lang, context..., label_id, n``. The training words are counted once,
    by trigram; the shorter contexts are sums of it. With ``stored`` (the written
    training set that ``ctx`` comes from) the trigram counts are written in buckets."""
    if materialize and stored is not None:
        tri = _bucketed_counts(ctx, stored)
    else:
        tri = ctx.groupBy("lang", *LEVELS["tri"], "label_id").agg(F.count(F.lit(1)).alias("n"))
    bi = tri.groupBy("lang", *LEVELS["bi"], "label_id").agg(F.sum("n").alias("n"))
    uni = tri.groupBy("lang", *LEVELS["uni"], "label_id").agg(F.sum("n").alias("n"))
    return {"tri": tri, "bi": bi, "uni": uni}


def _bucketed_counts(ctx: DataFrame, stored: DataFrame) -> DataFrame:
    """The trigram counts, written in buckets by ``(lang, prev, word)``: one shuffle
    serves the trigrams, the bigrams and their join.

    Words go to their bucket as they are, since most trigrams are rare. Those of a
    word that holds ``HOT_SHARE`` of all (at most ``1 / HOT_SHARE`` words) are
    counted first, so a frequent word pair meets no task row by row."""
    spark = ctx.sparkSession
    key, gram = ["lang", *LEVELS["bi"]], ["lang", *LEVELS["tri"], "label_id"]
    words = stored.select("lang", F.explode("src_tok").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    hot = [tuple(r) for r in heavy_keys(cut_lineage(words, "tagger-words"), "n", HOT_SHARE).select("lang", "word").collect()]
    rows = ctx.select(*gram, F.lit(1).cast("long").alias("n"))
    if hot:
        is_hot = F.lit(False)
        for lang, word in hot:
            is_hot = is_hot | (F.col("lang").eqNullSafe(F.lit(lang)) & (F.col("word") == F.lit(word)))
        rows = rows.where(~is_hot).unionByName(rows.where(is_hot).groupBy(*gram).agg(F.sum("n").alias("n")))
    size = int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 1 << 50 else 0                      # Spark names a huge size where it knows none
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // BUCKET_BYTES, MAX_BUCKETS))
    tri = rows.repartition(buckets, *key).groupBy(*gram).agg(F.sum("n").alias("n"))
    path = scratch_path(spark, "tagger-counts")
    name = os.path.basename(path).replace("-", "_")
    with shuffles_freed(spark):
        tri.write.bucketBy(buckets, *key).option("path", path).saveAsTable(name)
    return spark.table(name)


def word_ids(words: DataFrame, model: TaggerModel) -> DataFrame:
    """M3 on exploded words: ``label_id`` per word, back-off tri -> bi -> uni -> KEEP;
    words a fixed-length model cannot see keep themselves (J5)."""
    x = words
    for name, keys in LEVELS.items():
        # the word itself comes last: it is the key that heavy rows are spread by
        key = ["lang", *[k for k in keys if k != "word"], "word"]
        t = model.tag_tables()[name].select(*key, f"{name}_id")
        x = split_join(x, t, key, f"{name}_id", model.heavy_tables()[name], ["pair_id", "pos"])
    lid = F.when(F.col("visible"), F.coalesce("tri_id", "bi_id", "uni_id", F.lit(0))).otherwise(F.lit(0))
    return x.withColumn("label_id", lid).drop("tri_id", "bi_id", "uni_id")


def tag_words(words: DataFrame, model: TaggerModel) -> DataFrame:
    """M3 on exploded words: ``label`` per word."""
    return id_labels(word_ids(words, model), model.vocab)


def tag(sentences: DataFrame, model: TaggerModel, text_col: str = "text",
        max_words: int | None = None) -> DataFrame:
    """M3: ``labels`` array per sentence, in word order."""
    s = sentences.withColumn("src_tok", tokens(text_col))
    if model.materialize:
        s = cut_lineage(s, "tag-sentences")     # read by the words and by the result
    words = contexts(s, extra=(), max_words=max_words)
    if max_words is not None:
        words = words.where("visible")
    # only words with an edit are regrouped; the others are ``$KEEP`` by their number
    found = id_labels(word_ids(words, model).where(F.col("label_id") != 0).select("pair_id", "lang", "pos", "label_id"), model.vocab)
    edit = F.struct("pos", "label")
    none = F.lit(None)
    rows = found.select("pair_id", edit.alias("_e"), none.cast("int").alias("_n")).unionByName(
        s.select("pair_id", none.cast(found.select(edit.alias("_e")).schema["_e"].dataType).alias("_e"), F.size("src_tok").alias("_n")))
    per = rows.groupBy("pair_id").agg(F.sort_array(F.collect_list("_e")).alias("_found"), F.collect_list("_n").alias("_sizes"))
    labels = F.when(F.size("_sizes") == 1, _filled(F.col("_found"), F.col("_sizes")[0])).otherwise(_merged(F.col("_found"), F.col("_sizes")))
    per = per.select("pair_id", labels.alias("labels"))
    return s.join(per, "pair_id", "left").withColumn(
        "labels", F.coalesce("labels", F.array().cast("array<string>")))


def _filled(found, n) -> Column:
    """``n`` labels: those of ``found`` (sorted ``pos, label``), ``$KEEP`` between them."""
    def piece(x, i):
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(found, i - 1).getField("pos") + 1)
        return F.concat(F.array_repeat(F.lit(KEEP), x.getField("pos") - start), F.array(x.getField("label")))
    after = F.coalesce(F.get(found, F.size(found) - 1).getField("pos") + 1, F.lit(0))
    return F.concat(F.flatten(F.transform(found, piece)), F.array_repeat(F.lit(KEEP), n - after))


def _merged(found, sizes) -> Column:
    """The labels of all sentences of a repeated ``pair_id``, by position and label."""
    def at(p):
        here = F.transform(F.filter(found, lambda x: x.getField("pos") == p), lambda x: x.getField("label"))
        kept = F.size(F.filter(sizes, lambda n: n > p)) - F.size(here)
        return F.sort_array(F.concat(here, F.array_repeat(F.lit(KEEP), kept)))
    longest = F.array_max(sizes)
    return F.when(longest > 0, F.flatten(F.transform(F.sequence(F.lit(0), longest - 1), at)))


def correct_once(sentences: DataFrame, model: TaggerModel, text_col: str = "text",
                 max_words: int | None = None) -> DataFrame:
    """One pass: tag, then apply (E5). Returns the input plus ``next_text``."""
    tagged = tag(sentences, model, text_col, max_words)
    return tagged.withColumn("next_text", apply_labels("src_tok", "labels")).drop("src_tok", "labels")


def correct(sentences: DataFrame, model: TaggerModel, text_col: str = "text",
            max_passes: int = 3, max_words: int | None = None,
            checkpoint_passes: bool = True, partition_model: bool = False) -> DataFrame:
    """Up to ``max_passes`` passes (at least 1). A sentence stops at the
    first pass that changes nothing, and ``passes_used`` records where.

    The passes work on a list of open sentences. A pass is written once, split
    into finished and open; finished sentences are only read again for the
    result, and the next pass sees the open ones alone. Eager, like the fit: the
    tables are in the shared checkpoint folder, so a lost executor costs part of one pass.
    (``checkpoint_passes`` is accepted for earlier callers; every pass is written.)

    Returns ``pair_id, lang, corrected, passes_used``; any other input columns
    (besides ``text_col``) are joined back once at the end, not once per pass.
    """
    n = max(1, int(max_passes))
    if n > 1 and partition_model:
        model = model.partitioned()
    open_ = cut_lineage(sentences.select(
        "pair_id", "lang", tokens(text_col).alias("_tok"),
        (F.col(text_col) == F.array_join(tokens(text_col), " ")).alias("_norm")), "correct-open")
    out = None
    for k in range(1, n + 1):
        done = cut_lineage(_pass(open_, model, k == n, max_words), f"correct-pass-{k}", partition_by=("_done",))
        finished = done.where(F.col("_done")).select(
            "pair_id", "lang", F.array_join("_tok", " ").alias("corrected"), F.lit(k).alias("passes_used"))
        out = finished if out is None else out.unionByName(finished)
        open_ = done.where(~F.col("_done")).drop("_done")
        if k < n and open_.isEmpty():
            break
    rest = [c for c in sentences.columns if c not in ("pair_id", "lang", text_col, "corrected", "passes_used")]
    if not rest:
        return out
    return sentences.join(out.drop("lang"), "pair_id", "left")


def _edited(tok, found) -> Column:
    """``tok`` with the edits ``found`` (sorted ``pos, label``) applied; the stretches
    between them are copied, so the cost is linear in the sentence."""
    def piece(x, i):
        pos = x.getField("pos")
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(found, i - 1).getField("pos") + 1)
        return F.concat(F.slice(tok, start + 1, pos - start), apply_one(F.get(tok, pos), x.getField("label")))
    after = F.element_at(found, -1).getField("pos") + 1
    return F.concat(F.flatten(F.transform(found, piece)), F.slice(tok, after + 1, F.size(tok)))


def _pass(state: DataFrame, model: TaggerModel, last: bool, max_words: int | None) -> DataFrame:
    """One pass over the open sentences: ``_tok`` after it, and whether it is done."""
    z = state.select("pair_id", "lang", F.col("_tok").alias("_t"), F.posexplode("_tok").alias("pos", "word"))
    prev = F.coalesce(F.get(F.col("_t"), F.col("pos") - 1), F.lit(BOS))
    nxt = F.coalesce(F.get(F.col("_t"), F.col("pos") + 1), F.lit(EOS))
    words = z.select("pair_id", "lang", "pos", prev.alias("prev"), "word", nxt.alias("next"), F.lit(True).alias("visible"))
    if max_words is not None:
        words = words.where(F.col("pos") < max_words)
    # only words with an edit are regrouped
    found = id_labels(word_ids(words, model).where(F.col("label_id") != 0).select("pair_id", "lang", "pos", "label_id"), model.vocab)
    found = found.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("pos", "label"))).alias("_found"))
    x = state.join(found, "pair_id", "left")
    new = F.when(F.col("_found").isNull(), F.col("_tok")).otherwise(_edited(F.col("_tok"), F.col("_found")))
    same = F.col("_norm") & (F.col("_found").isNull() | (F.array_join(new, " ") == F.array_join("_tok", " ")))
    return x.select("pair_id", "lang", new.alias("_tok"), F.lit(True).alias("_norm"), (same | F.lit(last)).alias("_done"))


def validation_nll(labelled_val: DataFrame, model: TaggerModel, batches: DataFrame) -> DataFrame:
    """M7 + A10: masked NLL of the gold label under the model, add-one smoothed
    over the vocabulary at the most specific context seen in training. Loss =
    mean over batches of the per-batch mean over visible words (not the token
    mean); ``batches`` maps ``pair_id -> batch``. Both are read twice: give written ones."""
    # sentences, not words, meet their batch; a word then carries the batch in place of its pair
    sentences = labelled_val.join(batches, "pair_id").drop("pair_id").withColumnRenamed("batch", "pair_id")
    if model.materialize:
        sentences = cut_lineage(sentences.select("pair_id", "lang", "src_tok", "labels"), "val-sentences")
    x = label_ids(contexts(sentences), model.vocab).where("visible")
    if "lang" in model.vocab.columns:       # a vocabulary per language
        x = x.join(model.vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("_v")), "lang", "left").fillna(0, ["_v"])
        v = F.col("_v")
    else:
        v = F.lit(model.vocab.select(F.count(F.lit(1))).scalar())
    key = ["lang", *LEVELS["tri"], "label_id"]
    x = x.join(_gold_counts(x.select(*key).distinct(), model), key, "left")
    nll = -F.log((F.coalesce("g", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + v))
    # Losses and batch means are summed as decimals, so the result does not depend on
    # how rows are spread over partitions; it is rounded once, at the end.
    exact = "decimal(38,12)"
    rows = x.select(F.col("pair_id").alias("batch"), nll.cast("decimal(24,12)").alias("nll"))
    per_batch = rows.groupBy("batch").agg(F.sum("nll").cast("double").alias("s"), F.count(F.lit(1)).alias("n"))
    return per_batch.agg(
        F.round(F.sum((F.col("s") / F.col("n")).cast("decimal(24,12)")).cast(exact).cast("double")
                / F.count(F.lit(1)), LOSS_DIGITS).alias("val_loss"),
        F.count(F.lit(1)).alias("n_batches"), F.sum("n").alias("n_tokens"))


CO_PARTITION_CONF = "spark.sql.requireAllClusterKeysForCoPartition"


def _gold_counts(asked: DataFrame, model: TaggerModel) -> DataFrame:
    """``asked`` (distinct ``lang, prev, word, next, label_id``) with ``n``, the training
    words of the most specific context seen in training, and ``g``, those of them
    with the label. Rows no level knows are left out.

    A level is asked only for what the levels above it do not know, and reads only the
    counts of contexts that are asked for: those are picked, by a hash table of the asked
    ones, in the buckets where the trigram counts lie. Only they are grouped into a
    map of labels (at most the vocabulary's size) a context."""
    spark, key, out = asked.sparkSession, ["lang", *LEVELS["tri"], "label_id"], None
    keep = (lambda df, name: cut_lineage(df, name)) if model.materialize else (lambda df, name: df)
    open_ = keep(asked, "val-asked")
    for name, keys in LEVELS.items():
        at = ["lang", *keys]
        wanted = open_.select(*at).hint("shuffle_hash")
        if name == "uni":           # words are not what the buckets are by: their counts are summed first
            counts = model.counts["uni"].join(wanted, at, "left_semi")
        else:
            counts = model.counts["tri"].join(wanted, at, "left_semi")
            if name == "bi":
                counts = counts.groupBy(*at, "label_id").agg(F.sum("n").alias("n"))
        t = counts.groupBy(*at).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("label_id", "n"))).alias("_by"))
        x = open_.join(t, at, "left").select(*key, "n", F.coalesce(F.try_element_at("_by", F.col("label_id")), F.lit(0)).alias("g"))
        with setting(spark, CO_PARTITION_CONF, "false"):    # the counts stay in their buckets, the asked rows come to them
            x = keep(x, f"val-{name}")
        found, open_ = x.where(F.col("n").isNotNull()), x.where(F.col("n").isNull()).select(*key)
        out = found if out is None else out.unionByName(found)
    return out
