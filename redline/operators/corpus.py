"""Corpus build: project, tag, union, clean, count.

All row-wise: every operator here is a Project / Filter that Catalyst pushes
into the scan (language filters reach Parquet ``PushedFilters``) and that also
runs unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.functions.text import is_blank, py_strip, strip_prefix

PAIR_COLUMNS = ("incorrect", "correct", "transformation", "lang")
INSTRUCTION_PREFIX = "fix grammar:"


def require_column(df: DataFrame, name: str, why: str) -> None:
    if name not in df.columns:
        raise ValueError(f"table has no {name!r} column; cannot {why}")


def project_raw(raw: DataFrame, lang: str | None = None, keep=("pair_id",)) -> DataFrame:
    """T1 + T2/T8: ``modified -> incorrect``, ``sentence -> correct``; a constant
    language when asked for or when the set has no ``lang`` column."""
    if lang is not None:
        lang_col = F.lit(lang)
    elif "lang" in raw.columns:
        lang_col = F.col("lang")
    else:
        lang_col = F.lit("en")
    extra = [c for c in keep if c in raw.columns]
    return raw.select(*extra, F.col("modified").alias("incorrect"),
                      F.col("sentence").alias("correct"), "transformation",
                      lang_col.alias("lang"))


def filter_lang(df: DataFrame, lang: str | None) -> DataFrame:
    """Optional language filter; an explicit error if there is no ``lang``."""
    if lang is None:
        return df
    require_column(df, "lang", f"filter by lang={lang!r}")
    return df.where(F.col("lang") == lang)


def union_all(*frames: DataFrame) -> DataFrame:
    """Bag union by column name (no dedupe)."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def drop_null_any(df: DataFrame, cols=PAIR_COLUMNS) -> DataFrame:
    """T4: drop a row if any of the pair columns is null."""
    return df.na.drop("any", subset=list(cols))


def drop_null_subset(df: DataFrame, cols=("incorrect", "correct")) -> DataFrame:
    """T5: the readers' null check on two columns."""
    return df.na.drop("any", subset=list(cols))


def drop_blank(df: DataFrame, cols=("incorrect", "correct")) -> DataFrame:
    """Drop rows whose text is empty after Python ``strip()``."""
    cond = reduce(lambda a, b: a & b, [~is_blank(c) for c in cols])
    return df.where(cond)


def build_corpus(english_raw: DataFrame, multilingual_raw: DataFrame,
                 multilingual_lang: str | None = "es") -> DataFrame:
    """First corpus variant: English set tagged ``en`` + one language of the
    multilingual set, union, then T4 and T6. Output keeps ``pair_id``."""
    en = project_raw(english_raw, lang="en")
    multi = filter_lang(multilingual_raw, multilingual_lang)
    multi = project_raw(multi, lang=multilingual_lang)
    return drop_blank(drop_null_any(union_all(en, multi)))


def noop_filtered_pairs(*raw_sets: DataFrame) -> DataFrame:
    """Second corpus variant (F2, F5, T7, T8): ``source, target, lang``.

    Texts are stripped, the instruction prefix is removed once, and only real
    corrections are kept (both non-empty, ``source != target``, case-sensitive).
    All languages are kept. A null text is dropped (the reference would turn it
    into the text ``None``).
    """
    def one(raw: DataFrame) -> DataFrame:
        lang = py_strip("lang") if "lang" in raw.columns else F.lit("en")
        src = strip_prefix(py_strip("modified"), INSTRUCTION_PREFIX)
        # generated, so that the filters below read the texts and do not strip them again
        texts = F.inline(F.array(F.struct(src.alias("source"), py_strip("sentence").alias("target"))))
        return raw.select("pair_id", lang.alias("lang"), texts).select("pair_id", "source", "target", "lang")

    pairs = union_all(*[one(r) for r in raw_sets])
    s, t = F.col("source"), F.col("target")
    return pairs.where(s.isNotNull() & t.isNotNull() & F.col("lang").isNotNull()
                       & (s != "") & (t != "") & (s != t))


def lang_counts(df: DataFrame) -> DataFrame:
    """A1: rows per language, most frequent first (null language not counted)."""
    return (df.where(F.col("lang").isNotNull()).groupBy("lang")
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang"))


def group_counts(df: DataFrame, *cols: str) -> DataFrame:
    """A2: row counts per group in one pass (e.g. ``split, lang``)."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def distinct_langs(df: DataFrame) -> DataFrame:
    """U3."""
    return df.select("lang").where(F.col("lang").isNotNull()).distinct()


def preview(df: DataFrame, n: int = 5, cols=("incorrect", "correct")) -> DataFrame:
    """First ``n`` rows in ``pair_id`` order (a top-n, not a full sort)."""
    return df.orderBy("pair_id").select("pair_id", *cols).limit(n)
