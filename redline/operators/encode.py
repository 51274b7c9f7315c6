"""Fixed-length training examples.

The reference feeds a pretrained sub-word tokenizer; here any tokenizer's
``token_ids`` / ``word_ids`` columns can be used, and the built-in fallback is
a whitespace vocabulary built from the corpus (F16). Ids are dense ranks over
distinct tokens in a seeded hash order (``global_rank``: no single-partition
window), after the fixed special ids.

Token -> id lookup answers the most frequent tokens (``COMMON`` at most) from a table
that every task holds, and joins the vocabulary on ``token`` for the other words only.
So few words are rows of a shuffle, and a word that is a third of all words is none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redline.operators.split import global_rank
from redline.plans.session import cut_lineage

# Special token ids (same layout as the reference's encoder).
BOS_ID, PAD_ID, EOS_ID, UNK_ID = 0, 1, 2, 3
N_SPECIAL = 4
IGNORE = -100
MAX_LEN = 128
COMMON = 1 << 18                # tokens that every task holds (some 10 MB)


def token_vocab(texts: DataFrame, tok_col: str = "tok") -> DataFrame:
    """F16: ``token, token_id, freq`` over all tokens of ``tok_col``. Each Arrow batch is
    counted where it lies, so a frequent token is a row a batch, not a row a word."""
    part = texts.select(tok_col).mapInArrow(_batch_counts, "token string, freq long")
    counts = part.groupBy("token").agg(F.sum("freq").alias("freq"))
    r = global_rank(counts, key="token", tie="token")
    return r.select("token", (F.col("_idx") + N_SPECIAL).cast("int").alias("token_id"), "freq")


def _batch_counts(batches):
    for batch in batches:
        found = pc.value_counts(batch.column(0).flatten())
        yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts").cast(pa.int64())], ["token", "freq"])


def token_ids(df: DataFrame, vocab: DataFrame, columns: dict[str, str],
              key: str = "pair_id") -> DataFrame:
    """Map ``array<string>`` columns to ``array<int>`` ids (unknown ->
    ``UNK_ID``), keeping word order: ``columns`` maps input -> output name.

    The ``COMMON`` most frequent tokens (bounded, whatever the input) are looked up
    where the words lie, in Arrow; only the other words are rows of a join with the
    vocabulary. Their ids go back to their row's array by their number in it. Rows that
    repeat a ``key`` become one, their words by position. ``vocab`` (``token, token_id,
    freq``) is read three times: give a written one. Returns ``key`` plus the output columns."""
    names = list(columns)
    size = {c: f"_n{j}" for j, c in enumerate(names)}
    df = df.select(key, *[F.array_compact(c).alias(c) for c in names])          # a null word has no id
    rows = df.select(key, F.monotonically_increasing_id().alias("_row"), *[F.size(c).alias(n) for c, n in size.items()],
                     _common_ids(F.concat(*names), vocab).alias("_w")).select("*", "_w.*").drop("_w")
    rows = cut_lineage(rows, "common-ids")
    rare = rows.select("_row", F.posexplode("rare").alias("at", "token"))
    rare = rare.join(vocab.select("token", "token_id"), "token", "left").groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("at", F.coalesce("token_id", F.lit(UNK_ID)).alias("id")))).getField("id").alias("_found"))
    all_ids = F.when(F.col("_found").isNull(), F.col("ids")).otherwise(
        F.transform("ids", lambda x: F.when(x < 0, F.get(F.col("_found"), -1 - x)).otherwise(x)))
    x = rows.drop("rare").join(rare, "_row", "left").select(key, *size.values(), F.coalesce(all_ids, F.array().cast("array<int>")).alias("_ids"))
    at, parts = F.lit(1), []
    for c, n in size.items():
        parts.append(F.slice("_ids", at, F.greatest(F.col(n), F.lit(0))).alias(columns[c]))
        at = at + F.greatest(F.col(n), F.lit(0))
    return _one_row_a_key(x.select(key, *parts), rows.select(key), key)


def _common_ids(words: Column, vocab: DataFrame) -> Column:
    """``struct<ids, rare>`` of an ``array<string>``: the id of each word that is one of
    the ``COMMON`` most frequent tokens, ``-1 - i`` for the others, which are ``rare[i]``.
    Null words are left out. The frequent tokens are read when this is called."""
    # by a threshold: there are few frequencies (their sum is at most that of all words), and no task sorts all tokens
    least, n = None, 0
    for freq, c in sorted(map(tuple, vocab.groupBy("freq").agg(F.count(F.lit(1))).collect()), reverse=True):
        n += c
        if n > COMMON:
            break
        least = freq
    top = vocab.where(F.lit(False) if least is None else F.col("freq") >= least).select("token", "token_id").toArrow()
    known, ids = top["token"].combine_chunks().cast(pa.string()), top["token_id"].combine_chunks().cast(pa.int32())
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("rare", T.ArrayType(T.StringType()))])

    @F.arrow_udf(kind)
    def look_up(a: pa.Array) -> pa.Array:
        flat, size = a.flatten(), pc.fill_null(pc.list_value_length(a), 0).to_numpy()
        ends = np.concatenate([[0], np.cumsum(size)])
        at = pc.index_in(flat, value_set=known)
        lacks = pc.is_null(at)
        # how many of the words up to here are rare, in all and before each row
        n = np.concatenate([[0], np.cumsum(lacks.to_numpy(zero_copy_only=False))])
        rank = n[1:] - np.repeat(n[ends[:-1]], size)
        found = pc.coalesce(pc.take(ids, at), pa.array(-rank, pa.int32()))
        lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), v) for o, v in ((ends, found), (n[ends], flat.filter(lacks)))]
        return pa.StructArray.from_arrays(lists, names=["ids", "rare"])
    return look_up(words)


def _one_row_a_key(x: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``x`` (``key`` and id arrays) with the rows of a repeated key merged: the ids of
    each array by position. Only such rows are regrouped; ``keys`` (those of ``x``) are
    counted first."""
    twice = cut_lineage(keys.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_k"), "repeated-keys")
    if twice.isEmpty():
        return x
    same, names = F.col(key).eqNullSafe(F.col("_k")), [c for c in x.columns if c != key]

    def merged(c):
        at = F.flatten(F.transform(F.col(c), lambda a: F.transform(a, lambda v, i: F.struct(i.alias("pos"), v.alias("id")))))
        return F.transform(F.sort_array(at), lambda v: v.getField("id")).alias(c)
    many = x.join(twice, same, "left_semi").groupBy(key).agg(*[F.collect_list(c).alias(c) for c in names])
    return x.join(twice, same, "left_anti").unionByName(many.select(key, *[merged(c) for c in names]))


def frame(ids, max_len: int = MAX_LEN) -> Column:
    """``<s> ids </s>`` truncated to ``max_len`` (content cut, specials
    kept), padded with ``PAD_ID``."""
    body = F.slice(ids, 1, max_len - 2)
    seq = F.concat(F.array(F.lit(BOS_ID)), body, F.array(F.lit(EOS_ID)))
    return F.concat(seq, F.array_repeat(F.lit(PAD_ID), F.lit(max_len) - F.size(seq)))


def _content_len(framed, max_len: int) -> Column:
    """Length of ``<s> ids </s>`` in a framed row: the first ``PAD_ID`` (content
    ids start at ``N_SPECIAL``, so padding is the only ``PAD_ID``)."""
    p = F.array_position(framed, F.lit(PAD_ID))
    return F.when(p == 0, F.lit(max_len)).otherwise(p - 1).cast("int")


def ints_text(seq, n, tail: int, length: int) -> Column:
    """The ``length`` numbers of ``seq`` joined by blanks, where all after the first
    ``n`` (at least one) are ``tail``: these are written as one repeated text."""
    return F.concat(F.array_join(F.slice(seq, 1, n).cast("array<string>"), " "), F.repeat(F.lit(f" {tail}"), F.lit(length) - n))


def attention_mask(framed, max_len: int = MAX_LEN) -> Column:
    """1 for the framed sequence, 0 for padding (array functions, no lambda)."""
    n = _content_len(framed, max_len)
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n))


def shift(framed, max_len: int = MAX_LEN) -> tuple[Column, Column]:
    """decoder input = all but last; output = all but first, pad -> -100."""
    n = _content_len(framed, max_len)
    tgt_in = F.slice(framed, 1, max_len - 1)
    tgt_out = F.concat(F.slice(framed, 2, n - 1), F.array_repeat(F.lit(IGNORE), F.lit(max_len) - n))
    return tgt_in, tgt_out


def word_ids(n_words, max_len: int = MAX_LEN) -> Column:
    """Word index per position for the whitespace tokenizer (null for specials
    and padding): one token per word."""
    kept = F.least(n_words, F.lit(max_len - 2)).cast("int")
    body = F.when(kept > 0, F.sequence(F.lit(0), kept - 1)).otherwise(F.array().cast("array<int>"))
    seq = F.concat(F.array(F.lit(None).cast("int")), body, F.array(F.lit(None).cast("int")))
    return F.concat(seq, F.array_repeat(F.lit(None).cast("int"), F.lit(max_len) - F.size(seq)))


def split_word_ids(n_tokens, max_len: int = MAX_LEN) -> Column:
    """Word index per position for a tokenizer that cuts word i into
    ``n_tokens[i]`` tokens (0: the word has none): specials and padding are null,
    and what lies beyond the frame is cut off, also inside a word. Words past the
    frame are dropped before the repetition, so a row costs ``max_len``."""
    seen = F.slice(n_tokens, 1, max_len - 2) if max_len > 2 else F.array().cast("array<int>")
    # a word without tokens takes no place, so more words than places may be needed
    whole = F.when(F.exists(seen, lambda k: k < 1), n_tokens).otherwise(seen)
    body = F.slice(F.flatten(F.transform(whole, lambda k, i: F.array_repeat(i, F.least(k, F.lit(max_len)).cast("int")))), 1, max_len - 2)
    edge = F.array(F.lit(None).cast("int"))
    seq = F.concat(edge, body, edge)
    return F.concat(seq, F.array_repeat(F.lit(None).cast("int"), F.lit(max_len) - F.size(seq)))


def tag_labels(wids, label_ids) -> Column:
    """F15 + W7 + J5: the first token of each visible word gets its word's label
    id, every other position -100. Labels of words cut off by truncation are
    dropped. Works for any ``word_ids`` (sub-word tokenizers included)."""
    return F.transform(wids, lambda w, i: F.when(w.isNull(), F.lit(IGNORE))
                       .when((i > 0) & (F.get(wids, i - 1) == w), F.lit(IGNORE))
                       .otherwise(F.coalesce(F.get(label_ids, w), F.lit(IGNORE))))


def argmax(scores) -> Column:
    """Index of the largest score (first one on ties)."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
