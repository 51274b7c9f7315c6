"""Benchmark decontamination by pigeonhole edit matching (operator 7).

Texts are lower-cased and blanks collapse to one space. An item of n characters may
differ by k = n * ``error_rate`` edits, at every length. It is cut into k + 1 pieces: at k or
fewer edits one piece is intact. The first characters of each piece (the largest of
``SIZES`` that fits) are its gram; documents and items meet in a join on the grams' hashes,
and Myers' bit-parallel distance verifies the neighbourhood of every hit.

Nothing of the items goes through the driver but a bitmap of the grams' hashes (at most
2^``BITMAP_BITS`` bits), which spares the join the windows that no item holds. Documents with a
hit are written once with the hits' positions; their hits join the pieces, the
stretches around the guessed starts join the items and are verified.

An item too short for one edit (under 20 characters at 5 %) must occur exactly and
stand at word edges: no letter or digit right before or after it.

Defined cases: null or empty texts and items match nothing; repeated documents and
items are each reported; a null id of either is reported as null; positions count
characters of the normalised text; extra columns are ignored by ``matches`` and kept
by ``clean``, whose rows with a null or empty text stay.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.llm.common import bounded, cut, fresh

ERROR_RATE = 0.05
SIZES = (16, 13, 10, 6, 3, 2, 1)
BITMAP_BITS, BITS_PER_GRAM = 27, 512
#: positions of one document that are verified in one row
STRETCH = 1 << 16
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(n: int, error_rate: float = ERROR_RATE) -> int:
    return max(0, min(int(n * error_rate), n - 1))


def cut_pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 nearly equal pieces."""
    edge = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end) of the best occurrence of ``pattern`` in ``text``; the first on ties."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(pattern):
        where[ch] |= 1 << i
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, ch in enumerate(text, 1):
        eq = where.get(ch, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(xh | plus) & full)
        down = plus & xh
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (~(xv | up) & full)
        minus = up & xv
        if score < best:
            best, end = score, j
    return best, end


def _merged(starts: list[int], n: int, k: int) -> list[tuple[int, int]]:
    """Windows around guessed starts, overlapping ones joined."""
    out: list[list[int]] = []
    for s in starts:
        a, z = s - k, s + n + k
        if out and a <= out[-1][1]:
            out[-1][1] = z
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def grams(codes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every window of ``size`` characters, by doubling; as signed longs."""
    width, power, h = 1, BASE, codes.astype(np.uint64)
    out, done = None, 0
    while True:
        if size & width:
            out = h.copy() if out is None else out[:max(0, len(h) - done)] * np.uint64(power) + h[done:]
            done += width
        if 2 * width > size:
            break
        h = h[:max(0, len(h) - width)] * np.uint64(power) + h[width:]
        width, power = 2 * width, power * power % 2**64
    out ^= out >> np.uint64(32)
    out = (out + np.uint64(size)) * MIX
    out ^= out >> np.uint64(29)
    return (out * np.uint64(BASE)).view(np.int64)


def _maybe(gram: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
    """Positions of the hashes whose two slots (first and last bits) are both used."""
    def used(slot):
        return table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1
    some = np.flatnonzero(used((gram.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)))
    return some[used(gram[some] & ((1 << bits) - 1)).astype(bool)]


def item_rows(items: DataFrame) -> DataFrame:
    """(item_id, item, text): the normalised items that are not empty; ``item`` names the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", 8 << 20):
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([normalise(t) for t in b.column("text").to_pylist()], pa.string())],
                                             ["item_id", "text"])
    src = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return (src.mapInArrow(run, "item_id long, text string").filter("text <> ''")
            .select("item_id", F.md5("text").alias("item"), "text"))


def pieces(texts: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """(gram, size, item, n, k, at): the pieces of each (item, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", 1 << 20):
            rows = []
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                k = budget(len(text), error_rate)
                parts = cut_pieces(text, k)
                by_size = defaultdict(list)
                for at, piece in parts:
                    by_size[next(x for x in SIZES if x <= len(piece))].append(at)
                codes = _codes(text)
                for size, at in by_size.items():
                    rows += [(g, size, item, len(text), k, x) for g, x in zip(grams(codes, size)[at].tolist(), at, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    names = ["gram", "size", "item", "n", "k", "at"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    return texts.mapInArrow(run, "gram long, size int, item string, n int, k int, at int")


def bitmap(found: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bytes): which hash slots the grams use, two each; sized by their number, at most 2^BITMAP_BITS."""
    count = max(1, found.count())
    bits = min(BITMAP_BITS, max(15, (count * BITS_PER_GRAM - 1).bit_length()))
    slot = F.explode(F.array(F.shiftrightunsigned("gram", 64 - bits) + 1, F.col("gram").bitwiseAND(F.lit((1 << bits) - 1)) + 1))
    held = np.zeros((1 << bits) // 8, np.uint8)
    parts = found.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("set"))
    for r in parts.collect():                                   # at most 2^bits / 32768 rows of 4 KB
        held[(r["part"] - 1) * 4096:r["part"] * 4096] = np.frombuffer(r["set"], np.uint8)
    return bits, held


def _hits(bits: int, held, sizes: list[int]):
    """Rows with a gram that an item may hold: the normalised text, the grams and their positions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for b in bounded(batches, "text", 2 << 20):
            texts = [normalise(t) for t in b.column("text").to_pylist()]
            codes = _codes("\n".join(texts))                    # no normalised text holds a line end
            starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
            at, gram = [], []
            for size in sizes:
                for lo in range(0, len(codes), 1 << 20):
                    own = grams(codes[lo:lo + (1 << 20) + size - 1], size)
                    some = _maybe(own, bits, table)
                    at.append(some + lo)
                    gram.append(own[some])
            at, gram = np.concatenate(at or [np.zeros(0, np.int64)]), np.concatenate(gram or [np.zeros(0, np.int64)])
            doc = np.searchsorted(starts, at, side="right") - 1
            order = np.argsort(doc, kind="stable")
            at, gram, doc = (at - starts[doc])[order], gram[order], doc[order]
            hit = np.unique(doc)
            if len(hit):
                edge = pa.array(np.r_[np.searchsorted(doc, hit), len(doc)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(hit)), pa.array([texts[i] for i in hit], pa.string()), b.column("hash").take(pa.array(hit)),
                     pa.ListArray.from_arrays(edge, pa.array(at.astype(np.int64))), pa.ListArray.from_arrays(edge, pa.array(gram))],
                    ["doc_id", "text", "hash", "at", "gram"])
    return run


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row and item the stretches around the guessed starts, with one character more on each side."""
    for b in batches:
        rows, size = [], 0
        for row, text, own in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), b.column("guess").to_pylist(), strict=True):
            by = defaultdict(set)
            for g in own:
                by[g["item"], g["n"], g["k"]].add(g["start"])
            for (item, n, k), starts in by.items():
                for a, z in _merged(sorted(starts), n, k):
                    a, z = max(a - 1, 0), min(z + 1, len(text))
                    rows.append((row, item, k, a, z == len(text), text[a:z]))
                    size += z - a
                    if size > 8 << 20:
                        yield _stretch_batch(rows)
                        rows, size = [], 0
        if rows:
            yield _stretch_batch(rows)


STRETCH_SCHEMA = "row long, item string, k int, base long, last boolean, part string"


def _stretch_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      ["row", "item", "k", "base", "last", "part"])


def best(item: str, part: str, k: int, first: bool = True, last: bool = True) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best occurrence of ``item`` in ``part`` within k edits. The
    part reaches one character beyond what may match unless it is the text's ``first`` or ``last``."""
    lo, hi = 0 if first else 1, len(part) if last else len(part) - 1
    if k == 0:
        at = part.find(item, lo, hi)
        while at >= 0:
            end = at + len(item)
            if not part[max(at - 1, 0):at].isalnum() and not part[end:end + 1].isalnum():
                return 0, at, end
            at = part.find(item, at + 1, hi)
        return None
    distance, end = myers(item, part[lo:hi])
    if distance > k:
        return None
    _, back = myers(item[::-1], part[lo:lo + end][::-1])
    return distance, lo + end - back, lo + end


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for row, item, k, base, last, part, text in zip(*(b.column(c).to_pylist() for c in ("row", "item", "k", "base", "last", "part", "text")),
                                                        strict=True):
            if found := best(text, part, k, base == 0, last):
                rows.append((row, item, found[0], base + found[1], base + found[2]))
        if rows:
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             ["row", "item", "distance", "start", "end"])


def _found(docs: DataFrame, items: DataFrame, error_rate: float) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(rows with hits, best occurrence per row and item, items); None without items. ``docs``
    has doc_id, text and hash."""
    known = cut(item_rows(items), "decon-items")
    texts = known.select("item", "text").dropDuplicates(["item"])
    parts = cut(pieces(texts, error_rate), "decon-pieces")
    sizes = sorted(r["size"] for r in parts.select("size").distinct().collect())     # at most len(SIZES)
    if not sizes:
        return None
    bits, held = bitmap(parts)
    shared = docs.sparkSession.sparkContext.broadcast(held)                          # at most 2^BITMAP_BITS bits
    schema = "doc_id long, text string, hash string, at array<long>, gram array<long>"
    hits = cut(docs.mapInArrow(_hits(bits, shared, sizes), schema).withColumn("row", F.monotonically_increasing_id()), "decon-hits")
    pairs = hits.select("row", F.inline(F.arrays_zip("at", "gram"))).withColumnRenamed("at", "pos").join(parts, "gram")
    start = F.col("pos") - F.col("at")
    guess = (pairs.groupBy("row", F.shiftright("pos", STRETCH.bit_length() - 1).alias("stretch"))
             .agg(F.collect_set(F.struct("item", "n", "k", start.alias("start"))).alias("guess")))
    near = hits.select("row", "text").join(guess, "row").select("row", "text", "guess").mapInArrow(_stretches, STRETCH_SCHEMA)
    seen = near.join(texts, "item").mapInArrow(_verify, "row long, item string, distance int, start long, end long")
    one = seen.groupBy("row", "item").agg(F.min(F.struct("distance", "start", "end")).alias("m")).select("row", "item", "m.*")
    return hits, one, known


def matches(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, distance, start, end) per document row and item within budget: the best
    occurrence, the first on ties."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit("").alias("hash"))
    found = _found(src.filter("text <> ''"), items, error_rate)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int, start long, end long")
    hits, one, known = found
    return (hits.select("row", "doc_id").join(one, "row").join(known.select("item", "item_id"), "item")
            .select("doc_id", "item_id", "distance", "start", "end"))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns stay."""
    text = F.col(text_col).cast("string")
    name = F.md5(text)
    src = docs.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"), name.alias("hash"))
    found = _found(src.filter("text <> ''"), items, error_rate)
    if found is None:
        return docs
    hits, one, _ = found
    (held,) = fresh(docs, "held")
    bad = cut(hits.select("row", F.col("hash").alias(held)).join(one.select("row").distinct(), "row").select(held).distinct(), "decon-bad")
    return docs.join(bad, name == F.col(held), "left_anti")
