"""Applying a corrector / model to a table (M1), and candidate choice.

M1: ``apply_corrector`` runs any Python corrector over a text column in Arrow
batches with ``mapInPandas``. ``factory()`` is called once per task (model
load happens on the executor, never at import or on the driver); the returned
callable is then fed whole batches (``batched=True``: ``list[str] ->
list[str]``) or single sentences. A failing row gets its source text back and
``had_error = true`` (F11); the row count never changes. ``batch_size`` fixes
how many sentences a batched corrector gets at once, across Arrow batches;
without it that follows ``spark.sql.execution.arrow.maxRecordsPerBatch``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def identity_corrector() -> Callable[[str], str]:
    """The do-nothing corrector: the baseline every corrector must beat."""
    return lambda s: s


def chunked(batches: Iterator[pd.DataFrame], size: int | None) -> Iterator[pd.DataFrame]:
    """The rows of ``batches`` in frames of a multiple of ``size`` rows (the last may
    have any number): what is left of a batch is carried over to the next. At most
    ``size`` rows and one batch are held. Without ``size``, the batches as they come."""
    if size is None:
        yield from batches
        return
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        whole = len(pdf) - len(pdf) % size
        if whole:
            yield pdf.iloc[:whole].reset_index(drop=True)
        held = pdf.iloc[whole:].reset_index(drop=True) if whole < len(pdf) else None
    if held is not None:
        yield held


def apply_corrector(df: DataFrame, factory: Callable[[], Callable], input_col: str = "source",
                    output_col: str = "prediction", batched: bool = False, batch_size: int | None = None) -> DataFrame:
    """M1. ``batch_size`` (with ``batched``) is the number of sentences a batched
    corrector gets at once; only a task's last call may get fewer. A call that fails or
    gives a wrong number of replies is repeated row by row, so that only the
    rows that fail by themselves are flagged."""
    if batch_size is not None and batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    schema = T.StructType(df.schema.fields + [
        T.StructField(output_col, T.StringType(), True),
        T.StructField("had_error", T.BooleanType(), False)])

    def one_call(fn, src):
        if batched:
            try:
                got = list(fn(src))
                if len(got) == len(src):
                    return [g if isinstance(g, str) else s for g, s in zip(got, src)], [not isinstance(g, str) for g in got]
            except Exception:  # noqa: BLE001 - fall back to one row at a time
                pass
        out, err = [], []
        for s in src:
            try:
                r = fn([s])[0] if batched else fn(s)
                ok = isinstance(r, str)
            except Exception:  # noqa: BLE001 - a bad row keeps its source
                r, ok = s, False
            out.append(r if ok else s)
            err.append(not ok)
        return out, err

    def run(batches):
        fn = factory()
        # a call gets ``batch_size`` sentences, a frame is cut and built once for many calls
        for pdf in chunked(batches, batch_size if batched else None):
            src, out, err = pdf[input_col].tolist(), [], []
            step = batch_size if batched and batch_size else max(len(src), 1)
            for at in range(0, len(src), step):
                o, e = one_call(fn, src[at:at + step])
                out += o
                err += e
            yield pdf.assign(**{output_col: pd.Series(out, dtype=object),
                                "had_error": pd.Series(err, dtype=bool)})

    return df.mapInPandas(run, schema)


def nbest_select(cands: DataFrame, group: str = "sent_id") -> DataFrame:
    """Choose one hypothesis per sentence. Finished hypotheses compete on
    ``score / n_tokens``; if none is finished, the raw score decides. The first
    maximum (lowest ``rank``) wins.

    One ordering expresses both cases: finished first, then the finished
    length-normalised score or the unfinished raw score, then rank. ``row_number
    = 1`` is planned as a partial WindowGroupLimit before the shuffle, so each
    task ships at most one candidate per sentence.

    Input columns: ``group, rank, score, n_tokens, finished, text``.
    """
    key = F.when(F.col("finished"), F.col("score") / F.col("n_tokens")).otherwise(F.col("score"))
    w = Window.partitionBy(group).orderBy(F.desc("finished"), key.desc(), F.asc("rank"))
    best = cands.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
    return best.select(group, "text", "rank", F.col("finished").alias("any_finished"))


def top_candidates(cands: DataFrame, b: int, group: str = "sent_id") -> DataFrame:
    """The ``b`` best candidates per sentence by score, ties by input rank
    (a partial WindowGroupLimit runs before the shuffle)."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), "rank")
    return cands.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= b)
