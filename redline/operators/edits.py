"""Edit labels from an alignment, the edit table, and edit application.

Labels are a tiny grammar: ``$KEEP``, ``$DELETE``, ``$REPLACE_<tok>``,
``$INSERT_<tok>``. With matches ``(s_k, t_k)`` of the LCS alignment and
``(s_-1, t_-1) = (-1, -1)``:

* matched source word ``s_k``: ``$INSERT_ + tgt[t_{k-1}+1]`` when target words
  were skipped before ``t_k`` (only the first of them), else ``$KEEP``;
* unmatched source words between ``s_{k-1}`` and ``s_k``:
  ``$REPLACE_ + tgt[t_k - 1]`` when ``t_k > 0``, else ``$DELETE``;
* unmatched source words after the last match: ``$DELETE``;
* target words after the last match are never emitted.

So labels are lossy by design (the round trip is measured by ``roundtrip``).
``edit_labels`` builds them in one pass over the alignment with native array
functions (each match emits its gap and its own label; ``flatten`` joins them):
linear in the sentence length, no Python. ``with_labels`` labels where it aligns, in
the same Arrow call: two texts go in and one label per word comes out, so neither token
arrays nor alignments (a struct per word) cross to Python and back.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redline.functions.text import rest_from, tokens

# The label grammar.
KEEP = "$KEEP"
DELETE = "$DELETE"
REPLACE = "$REPLACE_"
INSERT = "$INSERT_"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def edit_labels(src, tgt, al) -> Column:
    """``array<string>``, one label per source token."""
    src, tgt, al = _c(src), _c(tgt), _c(al)

    def piece(x, k):
        prev = F.get(al, k - 1)
        prev_s = F.when(k == 0, F.lit(-1)).otherwise(prev.getField("s"))
        prev_t = F.when(k == 0, F.lit(-1)).otherwise(prev.getField("t"))
        t = x.getField("t")
        gap_label = F.when(t > 0, F.concat(F.lit(REPLACE), F.get(tgt, t - 1))).otherwise(F.lit(DELETE))
        own = F.when(t > prev_t + 1, F.concat(F.lit(INSERT), F.get(tgt, prev_t + 1))).otherwise(F.lit(KEEP))
        return F.concat(F.array_repeat(gap_label, x.getField("s") - prev_s - 1), F.array(own))

    last_s = F.when(F.size(al) == 0, F.lit(-1)).otherwise(F.element_at(al, -1).getField("s"))
    body = F.flatten(F.transform(al, piece))
    tail = F.array_repeat(F.lit(DELETE), F.size(src) - 1 - last_s)
    return F.concat(body, tail)


def word_labels(src, tgt, al) -> list[str]:
    """E3 of one pair as plain lists: the rules of ``edit_labels``."""
    out: list[str] = []
    last_s = last_t = -1
    for s, t in al:
        if s > last_s + 1:
            out += [REPLACE + tgt[t - 1] if t > 0 else DELETE] * (s - last_s - 1)
        out.append(INSERT + tgt[last_t + 1] if t > last_t + 1 else KEEP)
        last_s, last_t = s, t
    return out + [DELETE] * (len(src) - 1 - last_s)


def pair_labels(src, tgt) -> list[str]:
    """E2 + E3 of one pair: the words of the common suffix keep themselves (but the
    first, whose label looks back), so only what is before it is aligned."""
    from redline.operators.align import lcs_align

    m, n = len(src), len(tgt)
    while m and n and src[m - 1] == tgt[n - 1]:
        m -= 1
        n -= 1
    if m == n == 0:
        return [KEEP] * len(src)
    al = lcs_align(src[:m], tgt[:n]) if m and n else []
    if m == len(src):
        return word_labels(src, tgt, al)
    al.append((m, n))
    return word_labels(src[:m + 1], tgt, al) + [KEEP] * (len(src) - m - 1)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _text_labels(a: pa.Array, b: pa.Array) -> pa.Array:
    res = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        if x is None or y is None:
            res.append(None)
        else:
            src, tgt = x.split(), y.split()      # the same words as ``tokens``
            res.append([KEEP] * len(src) if src == tgt else pair_labels(src, tgt))
    return pa.array(res, type=pa.list_(pa.string()))


def text_labels(src, tgt) -> Column:
    """E2 + E3 on two texts: ``array<string>``, one label per word of ``src``."""
    return _text_labels(_c(src), _c(tgt))


def apply_one(w: Column, lab: Column) -> Column:
    """The output tokens of one word under one label.
    KEEP -> word; DELETE -> nothing; REPLACE -> payload; INSERT -> payload, word;
    anything else (or no label) -> word."""
    return (F.when(lab == KEEP, F.array(w))
            .when(lab == DELETE, F.array().cast("array<string>"))
            .when(F.startswith(lab, F.lit(REPLACE)), F.array(rest_from(lab, F.lit(len(REPLACE) + 1))))
            .when(F.startswith(lab, F.lit(INSERT)), F.array(rest_from(lab, F.lit(len(INSERT) + 1)), w))
            .otherwise(F.array(w)))


def apply_tokens(src, labels) -> Column:
    """E5 as tokens: one label per source word, the output token array."""
    return F.flatten(F.zip_with(_c(src), _c(labels), apply_one))


def apply_labels(src, labels) -> Column:
    """E5: apply one label per source word and join with one space."""
    return F.array_join(apply_tokens(src, labels), " ")


def with_labels(pairs: DataFrame, src: str = "incorrect", tgt: str = "correct") -> DataFrame:
    """Adds ``src_tok``, ``tgt_tok``, ``alignment`` (E2) and ``labels`` (E3). A caller
    that reads the labels alone pays for no ``alignment`` column."""
    from redline.operators.align import alignment

    x = pairs.withColumn("src_tok", tokens(src)).withColumn("tgt_tok", tokens(tgt))
    x = x.withColumn("alignment", alignment("src_tok", "tgt_tok"))
    return x.withColumn("labels", text_labels(src, tgt))


def edit_table(labelled: DataFrame, keep=("lang",)) -> DataFrame:
    """Long form ``(pair_id, pos, token, label)``, one row per source word."""
    extra = [c for c in keep if c in labelled.columns]
    z = labelled.select("pair_id", *extra, F.posexplode(F.arrays_zip(
        F.col("src_tok").alias("token"), F.col("labels").alias("label"))).alias("pos", "z"))
    return z.select("pair_id", *extra, "pos", F.col("z.token").alias("token"),
                    F.col("z.label").alias("label"))


def alignment_text(al) -> Column:
    """Flat text form ``s:t s:t ...`` of an alignment (for reports and oracles)."""
    return F.array_join(F.transform(_c(al), lambda x: F.concat_ws(
        ":", x.getField("s").cast("string"), x.getField("t").cast("string"))), " ")


def roundtrip(labelled: DataFrame, group_cols=("lang", "transformation")) -> DataFrame:
    """Share of pairs whose labels, applied to the source, give back the
    (blank-normalised) target."""
    hit = (apply_labels("src_tok", "labels") == F.array_join("tgt_tok", " ")).cast("bigint")
    return (labelled.select(*group_cols, hit.alias("hit")).groupBy(*group_cols)
            .agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("hit").alias("n_roundtrip"))
            .withColumn("share", F.col("n_roundtrip") / F.col("n_pairs")))
