"""Evaluation metrics.

Per-row counts are column expressions (plus the Arrow LCS for ``f05_lcs``);
the report is one hash aggregation with partial (map-side) aggregation, so
a language holding most rows costs no more than any other. Micro averages: sums
first, then the ratios, with the epsilon placed as in the reference:

* ``f05_lcs``: ``P = L/(np+1e-8)``, ``R = L/(nr+1e-8)``
* ``f05_set``: ``P = tp/(tp+fp+1e-8)``, ``R = tp/(tp+fn+1e-8)``
* both: ``F = 1.25*P*R/(0.25*P+R+1e-8)``

Empty input gives an all-zero report. Values stay unrounded; ``round4`` adds
rounded copies for display only (Spark rounds the decimal text half-up, Python
rounds the binary value, so they can differ in the last place).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.functions.text import norm_text, tokens
from redline.operators.align import lcs_length

EPS = 1e-8
BETA2 = 0.25


def pair_predictions(preds: DataFrame, refs: DataFrame, key: str = "pair_id") -> DataFrame:
    """Positional ``zip`` of predictions and references -> keyed inner join."""
    return preds.join(refs, key, "inner")


def _f(p: Column, r: Column) -> Column:
    return (1 + BETA2) * p * r / (BETA2 * p + r + EPS)


def lcs_counts(pred="prediction", ref="reference") -> list[Column]:
    """Per-row ``lcs, n_pred, n_ref`` over lower-cased whitespace tokens."""
    p, r = tokens(F.lower(F.col(pred))), tokens(F.lower(F.col(ref)))
    return [lcs_length(p, r).alias("lcs"), F.size(p).cast("bigint").alias("n_pred"),
            F.size(r).cast("bigint").alias("n_ref")]


def set_counts(pred="prediction", ref="reference") -> list[Column]:
    """Per-row ``tp, fp, fn`` over token *sets* (``array_intersect`` /
    ``array_except`` return distinct elements, as Python sets do)."""
    p, r = tokens(F.lower(F.col(pred))), tokens(F.lower(F.col(ref)))
    return [F.size(F.array_intersect(p, r)).cast("bigint").alias("tp"),
            F.size(F.array_except(p, r)).cast("bigint").alias("fp"),
            F.size(F.array_except(r, p)).cast("bigint").alias("fn")]


def exact_hit(pred="prediction", ref="reference") -> Column:
    return (norm_text(pred) == norm_text(ref)).cast("bigint").alias("hit")


def _sum0(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def f05_lcs(df: DataFrame, group_cols=("lang",), pred="prediction", ref="reference",
            with_exact: bool = True, total_row: bool = False) -> DataFrame:
    """A5 (+A7): LCS-based micro precision / recall / F0.5 per group."""
    rows = df.select(*group_cols, *lcs_counts(pred, ref),
                     *( [exact_hit(pred, ref)] if with_exact else []))
    aggs = [_sum0("lcs").alias("lcs"), _sum0("n_pred").alias("n_pred"),
            _sum0("n_ref").alias("n_ref"), F.count(F.lit(1)).alias("n_rows")]
    if with_exact:
        aggs.append(_sum0("hit").alias("hits"))
    g = _grouped(rows, group_cols, total_row).agg(*aggs, *_flags(group_cols, total_row))
    p = F.col("lcs") / (F.col("n_pred") + EPS)
    r = F.col("lcs") / (F.col("n_ref") + EPS)
    out = g.select(*_group_out(group_cols, total_row), "n_rows", "lcs", "n_pred", "n_ref",
                   p.alias("precision"), r.alias("recall"), _f(p, r).alias("f05"),
                   *([F.when(F.col("n_rows") == 0, 0.0)
                      .otherwise(F.col("hits") / F.col("n_rows")).alias("exact_match")]
                     if with_exact else []))
    return out


def f05_set(df: DataFrame, group_cols=("lang",), pred="prediction", ref="reference",
            total_row: bool = False) -> DataFrame:
    """Set-based micro precision / recall / F0.5 per group (no exact match)."""
    rows = df.select(*group_cols, *set_counts(pred, ref))
    g = _grouped(rows, group_cols, total_row).agg(
        _sum0("tp").alias("tp"), _sum0("fp").alias("fp"), _sum0("fn").alias("fn"),
        F.count(F.lit(1)).alias("n_rows"), *_flags(group_cols, total_row))
    p = F.col("tp") / (F.col("tp") + F.col("fp") + EPS)
    r = F.col("tp") / (F.col("tp") + F.col("fn") + EPS)
    return g.select(*_group_out(group_cols, total_row), "n_rows", "tp", "fp", "fn",
                    p.alias("precision"), r.alias("recall"), _f(p, r).alias("f05"))


def exact_match(df: DataFrame, group_cols=("lang",), pred="prediction",
                ref="reference") -> DataFrame:
    """Share of rows equal after lower-casing and blank normalising; 0.0 for
    no rows."""
    g = df.select(*group_cols, exact_hit(pred, ref)).groupBy(*group_cols).agg(
        _sum0("hit").alias("hits"), F.count(F.lit(1)).alias("n_rows"))
    return g.select(*group_cols, "n_rows", "hits", F.when(F.col("n_rows") == 0, 0.0)
                    .otherwise(F.col("hits") / F.col("n_rows")).alias("exact_match"))


def empty_report(df: DataFrame) -> DataFrame:
    """Global (ungrouped) report: one row even for an empty input (all 0.0)."""
    return f05_lcs(df, group_cols=())


def round4(report: DataFrame, cols=("precision", "recall", "f05", "exact_match")) -> DataFrame:
    """rounded copies for display, unrounded values kept beside them."""
    present = [c for c in cols if c in report.columns]
    return report.select("*", *[F.round(c, 4).alias(f"{c}_r4") for c in present])


def _grouped(rows: DataFrame, group_cols, total_row: bool):
    if total_row and group_cols:
        return rows.rollup(*group_cols)
    return rows.groupBy(*group_cols)


def _flags(group_cols, total_row: bool) -> list[Column]:
    if not (total_row and group_cols):
        return []
    return [F.grouping(c).alias(f"_g_{c}") for c in group_cols]


def _group_out(group_cols, total_row: bool) -> list[Column]:
    """With ``total_row`` the rollup's total row is labelled ``*``."""
    if not (total_row and group_cols):
        return [F.col(c) for c in group_cols]
    return [F.when(F.col(f"_g_{c}") == 1, F.lit("*")).otherwise(F.col(c)).alias(c)
            for c in group_cols]
