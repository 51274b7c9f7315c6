"""Exact repeated-substring search by distributed prefix doubling over every position.

This is operator 2's dealt method in its plain form. ``substring_dedup`` gives the same
spans from sampled positions at a fraction of the shuffle (figures in the README), so the
registered query uses that one; this form shares nothing with it but the row keys and is
the second, independent way to the same rows.

Every position starts with the name of its first ``first`` bytes. A round pairs the name at
a position with the name at a growing offset behind it, sorts out pairs that occur once and
gives the others new names, until the names stand for ``length`` bytes. A position whose
partner has left is unique too, so an inner join drops it.

Defined cases: as in ``substring_dedup``. Texts shorter than ``length`` bytes have no
position; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.llm.common import binary_parts, bounded, cut, id_key, longs

BLOCK = 1 << 20                      # bytes of text per step of a task
AT = ["doc", "hash", "pos"]


def _first_names(length: int, first: int):
    """(doc, hash, pos, string of ``first`` bytes) of every position that a
    ``length``-byte string covers and that has ``first`` bytes behind it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", BLOCK):
            data, off = binary_parts(b.column("text"))
            doc, text_hash = longs(b.column("doc")), longs(b.column("hash"))
            for i in range(b.num_rows):
                text, n = data[off[i]:off[i + 1]], int(off[i + 1] - off[i])
                for at in range(0, n - first + 1 if n >= length else 0, BLOCK):
                    piece = text[at:at + BLOCK + first - 1]
                    name = np.lib.stride_tricks.sliding_window_view(piece, first)
                    k = len(name)
                    flat = pa.FixedSizeBinaryArray.from_buffers(
                        pa.binary(first), k, [None, pa.py_buffer(np.ascontiguousarray(name))])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, doc[i])), pa.array(np.full(k, text_hash[i])),
                         pa.array(np.arange(at, at + k, dtype=np.int64)), flat.cast(pa.binary())], [*AT, "name"])
    return run


def _renamed(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows whose keys occur at two positions or more, with a new name for the keys
    and ``first``, the earliest position among equals."""
    again = cut(rows.groupBy(*keys).agg(F.min(F.struct(*AT)).alias("first"), F.count(F.lit(1)).alias("n"))
                .filter("n > 1").select(*keys, "first", F.monotonically_increasing_id().alias("new")), f"{name}-names")
    return cut(rows.join(again, keys).select(*AT, F.col("new").alias("name"), "first"), name)


def repeated_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    length: int = 100, first: int = 25) -> DataFrame:
    """(doc, hash, pos): starts of ``length``-byte strings that also start earlier."""
    if not 1 <= first <= length:
        raise ValueError("1 <= first <= length")
    src = (docs.select(id_key(id_col).alias("doc"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
           .filter(F.octet_length("text") >= length).dropDuplicates(["doc", "hash"]))
    named = _renamed(src.mapInArrow(_first_names(length, first), "doc long, hash long, pos long, name binary"),
                     ["name"], f"doubling-{first}")
    size = first
    while size < length:
        step = min(size, length - size)
        behind = named.select("doc", "hash", (F.col("pos") - step).alias("pos"), F.col("name").alias("next"))
        pairs = named.select(*AT, "name").join(behind, AT)
        size += step
        named = _renamed(pairs, ["name", "next"], f"doubling-{size}")
    return named.filter(F.struct(*AT) != F.col("first")).select(*AT)
