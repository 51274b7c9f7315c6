"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from redline.plans.session import cut_lineage

NULL_ID = -(2**63)  # stands for a null id inside an operator; sorts first


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    return cut_lineage(df, f"llm-{name}")


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of jobs whose results are written: its
    cleaner removes them once the driver has collected their handles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def id_key(col: str):
    """The id as a non-null long; a null id sorts before every other."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def id_back(col: str):
    return F.when(F.col(col) != F.lit(NULL_ID), F.col(col))


def binary_parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.type not in (pa.large_binary(),):
        array = array.cast(pa.binary() if pa.types.is_binary(array.type) or pa.types.is_string(array.type)
                           else pa.large_binary()).cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, np.int64)[array.offset:array.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def longs(array: pa.Array, null: int = NULL_ID) -> np.ndarray:
    return array.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def bounded(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices whose ``column`` holds at most ``max_bytes`` (one row at least),
    so that what a task holds does not depend on the length of the texts."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = binary_parts(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + length)``."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def ranked(df: DataFrame, order: list, name: str, split_by: list | None = None, columns: list | None = None) -> DataFrame:
    """``df`` (written, with ``rank``) numbered from 0 in ``order``, no row meeting all
    others: rows are sorted in ranges, and each range adds the sizes of those before it
    (one row per range). ``split_by`` names coarser keys to cut the ranges by, in the
    same order; ``columns`` are those to keep."""
    t = cut(df.repartitionByRange(*(split_by or order)).sortWithinPartitions(*order)
            .select(*(columns or df.columns), F.monotonically_increasing_id().alias("__at")), name)
    part = F.shiftright("__at", 33)
    sizes = t.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    return (t.join(F.broadcast(offsets), part == F.col("__part"))
            .withColumn("rank", F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__base"))
