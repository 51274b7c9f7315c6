"""Exact repeated-substring removal (operator 2), by winnowing and exact-window names in
place of prefix doubling (see README).

A byte goes when a ``length``-byte string that covers it also starts earlier: in a
document with a smaller id, or earlier in the same document. Strings are judged on
the input and never cross documents.

Positions carry names (fingerprints) of strings that start at them. Spark sorts pairs of
names; positions whose pair is unique leave. Equal fingerprints count as equal strings: a
pair is 128 bits, so two different ones of n agree with odds of about n^2 / 2^129.

* Round 1 names ``gram``-byte strings, at sampled positions only: the smallest
  gram (by hash) of each ``length``-byte window, leftmost on ties. Equal windows
  choose the same gram at the same place, so no repeat is lost, while about one
  position in 40 is sorted. Each position also carries the name of the bytes of all
  windows that chose it. Equal pairs are runs of repeated windows: all but the first
  are settled at once. Positions with a gram of their own leave.
* Round 2 takes positions whose gram occurs with different surroundings (the edges
  of repeats). Their windows fall into cells of 20 neighbouring starts, and the 80 or
  so bytes that all windows of a cell share are named (16 bits, next to the gram's
  name). Cells with a name of their own leave.
* Round 3 takes the windows of the cells that are left. Spark sorts the pairs (name of
  the first half, name of the second half); all but the first of equal pairs are repeats.

Names are 64-bit fingerprints of the bytes rather than dense ranks, so a pair is a
128-bit name. Each task first settles what repeats inside its own block of text and
sends at most two positions per gram, so a passage shared by a third of the
documents sends a few rows per block, not one per occurrence.

Defined cases: null text is empty; a null id sorts before all others; rows that
share an id are ordered by a 64-bit hash of their text, and fully equal rows are one
document (equal results, neither is the other's repeat); extra columns are ignored
by ``removed_spans`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.llm.common import binary_parts, bounded, cut, fresh, id_back, id_key, longs, ranges, release

LENGTH, GRAM = 100, 24
BLOCK = 2 << 20                      # bytes of text per step of a task
FIRST_BLOCK = 1 << 20                # in round 1, which holds about 110 bytes for each of them
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _RNG.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CELL = 20                            # neighbouring window starts pruned together
#: a REPEAT row holds its first and last window start in k2 and k3
_SCHEMA = "kind byte, k1 long, k2 long, k3 long, doc long, hash long, pack long"
REPEAT, CANDIDATE, WITNESS, OPEN = 0, 1, 2, 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Names:
    """Names of all strings of 1, 2, 4, ... bytes of a block, each from two names
    of half the length; any other length is read off the binary digits."""

    def __init__(self, data: np.ndarray, longest: int):
        self.level = {1: _BYTE[data]}
        size, i = 1, 0
        while 2 * size <= longest:
            half = self.level[size]
            self.level[2 * size] = half[:-size] * _MUL[i] + half[size:] if len(half) > size else half[:0]
            size, i = 2 * size, i + 1

    def at(self, where: np.ndarray | slice, length: int) -> np.ndarray:
        """Names of ``length`` bytes from each position (which must exist)."""
        out, done = None, 0
        for bit in reversed(range(length.bit_length())):
            size = 1 << bit
            if length & size:
                part = self.level[size][where + done]
                out = part if out is None else out * _MUL[15 - bit] + part
                done += size
        return _mix(out)

    def all(self, length: int) -> np.ndarray:
        n = len(self.level[1]) - length + 1
        out, done = None, 0
        for bit in reversed(range(length.bit_length())):
            size = 1 << bit
            if length & size:
                part = self.level[size][done:done + n]
                out = part if out is None else out * _MUL[15 - bit] + part
                done += size
        return _mix(out)


def _pack(pos: np.ndarray, left: np.ndarray, width: np.ndarray) -> np.ndarray:
    """position | position - first window (7 bits) | windows - 1 (7)."""
    return pos << 14 | left << 7 | width


def _unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """position, first window, last window."""
    pos = p >> 14
    lo = pos - (p >> 7 & 127)
    return pos, lo, lo + (p & 127)


def _blocks(batches: Iterator[pa.RecordBatch], length: int):
    """(bytes, piece starts, piece ends, doc, hash, offset in the document); long
    texts come as pieces that overlap by length - 1 bytes."""
    for b in bounded(batches, "text", FIRST_BLOCK):
        pa.default_memory_pool().release_unused()             # a reused worker may hold an earlier stage's
        data, off = binary_parts(b.column("text"))
        doc, text_hash = longs(b.column("doc")), longs(b.column("hash"))
        if b.num_rows > 1 or len(data) <= FIRST_BLOCK:
            yield data, off[:-1], off[1:], doc, text_hash, np.zeros(b.num_rows, np.int64)
            continue
        for at in range(0, max(1, len(data) - length + 1), FIRST_BLOCK):
            piece = data[at:at + FIRST_BLOCK + length - 1]
            yield piece, np.array([0]), np.array([len(piece)]), doc, text_hash, np.array([at])


def _anchors(data, start, end, names: Names, length: int, gram: int):
    """Runs of windows that choose the same gram: (piece, position, first, last)."""
    width = length - gram + 1
    g = names.all(gram)
    local = (g >> np.uint64(24) << np.uint64(24)) | np.arange(len(g), dtype=np.uint64)
    size = 1
    while 2 * size <= width:                                  # sliding minimum by doubling
        local = np.minimum(local[:-size], local[size:])
        size *= 2
    if size < width:
        local = np.minimum(local[:len(local) - (width - size)], local[width - size:])
    chosen = (local & np.uint64((1 << 24) - 1)).view(np.int64)
    del local
    counts = np.maximum(end - start - length + 1, 0)
    windows = ranges(start, counts)
    if not len(windows):
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, np.uint64)
    piece = np.repeat(np.arange(len(start)), counts)
    pick = chosen[windows]
    del chosen
    head = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1]) | (piece[1:] != piece[:-1])])
    tail = np.r_[head[1:], len(windows)] - 1
    return piece[head], pick[head], windows[head], windows[tail], g[pick[head]]


def _cells(names: Names, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, gram: int) -> np.ndarray:
    """16-bit names of the bytes that the windows of each cell share, in one long."""
    out = np.zeros(len(pos), np.uint64)
    for c, (near, far) in enumerate(_cell_bounds(length, gram)):
        some = (pos - hi <= far) & (pos - lo >= near)
        name = names.at(pos[some] - near, length - (far - near))
        out[some] |= (name & np.uint64(0xFFFF)) << np.uint64(16 * c)
    return out.view(np.int64)


def _cell_bounds(length: int, gram: int) -> list[tuple[int, int]]:
    """Smallest and largest distance from a cell's window starts to the position."""
    last = length - gram
    size = max(CELL, -(-(last + 1) // 4))
    return [(o, min(o + size - 1, last)) for o in range(0, last + 1, size)]


def _rows(kind, k1, k2, k3, doc, text_hash, pack) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(kind, np.int8)), pa.array(k1), pa.array(k2), pa.array(k3), pa.array(doc), pa.array(text_hash),
         pa.array(pack)], ["kind", "k1", "k2", "k3", "doc", "hash", "pack"])


def _runs(doc, text_hash, lo, hi) -> pa.RecordBatch | None:
    """Repeat rows with touching window ranges of a document joined; k1 spreads them."""
    if not len(doc):
        return None
    s = np.lexsort((lo, text_hash, doc))
    doc, text_hash, lo, hi = doc[s], text_hash[s], lo[s], hi[s]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1]) | (lo[1:] > hi[:-1] + 1)]
    head = np.flatnonzero(new)
    last = np.maximum.reduceat(hi, head)
    doc, text_hash, lo = doc[head], text_hash[head], lo[head]
    k1 = (_mix(lo.view(np.uint64) + _mix(doc.view(np.uint64) ^ text_hash.view(np.uint64))) >> np.uint64(40)).view(np.int64)
    return _rows(np.full(len(head), REPEAT), k1, lo, last, doc, text_hash, np.zeros(len(head), np.int64))


def _starts(*cols) -> np.ndarray:
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def _first_round(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, start, end, docs, hashes, base in _blocks(batches, length):
            if len(data) < length:
                continue
            names = Names(data, length)
            piece, pos, lo, hi, g = _anchors(data, start, end, names, length, gram)
            if not len(piece):
                continue
            left, width = pos - lo, hi - lo
            around = (left << 7 | width).astype(np.uint64)
            c = _mix(names.at(lo, length) * _MUL[14] + names.at(hi, length) + around * _MUL[13])
            k3 = _cells(names, pos, lo, hi, length, gram)
            del names
            doc, text_hash, shift = docs[piece], hashes[piece], base[piece] - start[piece]
            pack = _pack(pos + shift, left, width)
            lo, hi = lo + shift, hi + shift
            k1, k2 = g.view(np.int64), c.view(np.int64)
            s = np.lexsort((pack, text_hash, doc, k2, k1))
            k1, k2, k3, doc, text_hash, pack, lo, hi = (x[s] for x in (k1, k2, k3, doc, text_hash, pack, lo, hi))
            cls = np.flatnonzero(_starts(k1, k2))
            size = np.diff(np.r_[cls, len(k1)])
            # a fully equal row's position is the same position, not a repeat
            first = np.repeat(cls, size)
            repeat = (doc != doc[first]) | (text_hash != text_hash[first]) | (pack != pack[first])
            out = _runs(doc[repeat], text_hash[repeat], lo[repeat], hi[repeat])
            if out is not None:
                yield out
            k1, k2, k3, doc, text_hash, pack = (x[cls] for x in (k1, k2, k3, doc, text_hash, pack))
            head = np.flatnonzero(_starts(k1))
            size = np.diff(np.r_[head, len(k1)])
            many = np.repeat(size > 1, size)
            number = np.arange(len(k1)) - np.repeat(head, size)
            send = ~many | (number < 2)
            yield _rows(np.where(many, WITNESS, CANDIDATE)[send], k1[send], k2[send], k3[send], doc[send], text_hash[send],
                        pack[send])
            if many.any():
                yield _rows(np.full(int(many.sum()), OPEN), k2[many], k1[many], k3[many], doc[many], text_hash[many],
                            pack[many])
    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (k1, k2, doc, hash, pack): of each class (k1, k2) all candidates but
    the first are repeats; the first stays open if its k1 has several classes. The
    only state between batches is the first row of the last class."""
    columns = ("k1", "k2", "k3", "doc", "hash", "pack")
    state = None                       # (columns, kind, its group is known to have several classes)
    for b in itertools.chain(batches, [None]):
        if b is None:
            if state is None or not state[7] or state[6] != CANDIDATE:
                return
            k1, k2, k3, doc, text_hash, pack = (np.array([v], np.int64) for v in state[:6])
            yield _rows([OPEN], k2, k1, k3, doc, text_hash, pack)
            return
        kind = b.column("kind").to_numpy()
        ready = (kind == REPEAT) | (kind == OPEN)
        if ready.any():
            yield b.filter(pa.array(ready))
        use = ~ready
        if not use.any():
            continue
        kind = kind[use]
        k1, k2, k3, doc, text_hash, pack = (b.column(n).to_numpy()[use] for n in columns)
        known = False
        if state is not None:
            known = state[7]
            k1, k2, k3, doc, text_hash, pack = (np.r_[np.array([v], np.int64), x] for v, x in zip(
                state[:6], (k1, k2, k3, doc, text_hash, pack), strict=True))
            kind = np.r_[np.array([state[6]], kind.dtype), kind]
        cls = np.flatnonzero(_starts(k1, k2))
        first = np.repeat(cls, np.diff(np.r_[cls, len(k1)]))
        repeat = (kind == CANDIDATE) & ((doc != doc[first]) | (text_hash != text_hash[first]) | (pack != pack[first]))
        if repeat.any():
            _, lo, hi = _unpack(pack[repeat])
            out = _runs(doc[repeat], text_hash[repeat], lo, hi)
            if out is not None:
                yield out
        group = _starts(k1[cls])
        head = np.flatnonzero(group)
        several = np.diff(np.r_[head, len(cls)]) > 1
        several[0] |= known and state is not None
        open_group = np.repeat(several, np.diff(np.r_[head, len(cls)]))
        closed = np.ones(len(cls), bool)
        closed[-1] = False             # the last class may still go on; it is the state
        emit = cls[open_group & closed & (kind[cls] == CANDIDATE)]
        if len(emit):
            yield _rows(np.full(len(emit), OPEN), k2[emit], k1[emit], k3[emit], doc[emit], text_hash[emit], pack[emit])
        last = cls[-1]
        state = (*(int(x[last]) for x in (k1, k2, k3, doc, text_hash, pack)), int(kind[last]), bool(several[-1]))


def _last_round(length: int, gram: int):
    half = length // 2
    near, far = np.array(_cell_bounds(length, gram)).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, start, end, docs, hashes, base, packs in _open_blocks(batches, length):
            names = Names(data, length)
            for i, (pack, cell) in enumerate(packs):
                pos, lo, hi = _unpack(pack)
                lo = np.maximum(np.maximum(lo, pos - far[cell]), base[i])
                hi = np.minimum(np.minimum(hi, pos - near[cell]), base[i] + end[i] - start[i] - length)
                packs[i] = (lo[lo <= hi], (hi - lo + 1)[lo <= hi])
            count = np.array([int(n.sum()) for _, n in packs])
            if not count.sum():
                continue
            pos = np.concatenate([ranges(lo, n) for lo, n in packs])
            row = np.repeat(np.arange(len(packs)), count)
            at = pos - base[row] + start[row]
            k1 = names.at(at, half).view(np.int64)
            k2 = names.at(at + half, length - half).view(np.int64)
            del names
            doc, text_hash = docs[row], hashes[row]
            z = np.zeros(len(pos), np.int64)
            pack = _pack(pos, z, z)
            s = np.lexsort((pack, text_hash, doc, k2, k1))
            k1, k2, doc, text_hash, pack, pos = (x[s] for x in (k1, k2, doc, text_hash, pack, pos))
            cls = np.flatnonzero(_starts(k1, k2))
            first = np.repeat(cls, np.diff(np.r_[cls, len(k1)]))
            repeat = (doc != doc[first]) | (text_hash != text_hash[first]) | (pack != pack[first])
            out = _runs(doc[repeat], text_hash[repeat], pos[repeat], pos[repeat])
            if out is not None:
                yield out
            yield _rows(np.full(len(cls), CANDIDATE), k1[cls], k2[cls], z[:len(cls)], doc[cls], text_hash[cls], pack[cls])
    return run


def _open_blocks(batches, length):
    """As ``_blocks``, with the (positions, cells) of each piece's document."""
    for b in bounded(batches, "text", BLOCK):
        data, off = binary_parts(b.column("text"))
        doc, text_hash = longs(b.column("doc")), longs(b.column("hash"))
        cells = b.column("cells").combine_chunks() if isinstance(b.column("cells"), pa.ChunkedArray) else b.column("cells")
        at, flat = cells.offsets.to_numpy(), cells.values
        pack, cell = flat.field("pack").to_numpy(), flat.field("cell").to_numpy()
        packs = [(pack[x:y], cell[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
        if b.num_rows > 1 or len(data) <= BLOCK:
            yield data, off[:-1], off[1:], doc, text_hash, np.zeros(b.num_rows, np.int64), packs
            continue
        for at in range(0, max(1, len(data) - length + 1), BLOCK):
            piece = data[at:at + BLOCK + length - 1]
            yield piece, np.array([0]), np.array([len(piece)]), doc, text_hash, np.array([at]), [packs[0]]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_key(id_col).alias("doc"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))


def _sorted_pairs(rows: DataFrame) -> DataFrame:
    return rows.repartition("k1").sortWithinPartitions("k1", "k2", "doc", "hash", "pack").mapInArrow(_resolve, _SCHEMA)


def _shared_cells(still: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, hash, cells): per document the cells of open positions whose shared
    bytes occur at two positions or more."""
    left = F.shiftright("pack", 7).bitwiseAND(F.lit(127))
    right = left - F.col("pack").bitwiseAND(F.lit(127))
    cells = F.array(*[F.when((right <= far) & (left >= near),
                             F.struct(F.lit(c).cast("long").alias("cell"),
                                      F.shiftright("k3", 16 * c).bitwiseAND(F.lit(0xFFFF)).alias("name")))
                      for c, (near, far) in enumerate(_cell_bounds(length, gram))])
    rows = still.select("doc", "hash", "pack", F.col("k2").alias("gram"), F.inline(F.filter(cells, lambda x: x.isNotNull())))
    shared = rows.groupBy("gram", "cell", "name").count().filter("count > 1").drop("count")
    return (rows.join(shared, ["gram", "cell", "name"], "left_semi")
            .groupBy("doc", "hash").agg(F.collect_list(F.struct("pack", "cell")).alias("cells")))


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, hash, spans): per document with repeats, ranges [lo, hi] of starts of
    repeated ``length``-byte strings. ``doc`` is the id (``NULL_ID`` for null)."""
    if not 1 <= gram < length <= 128:
        raise ValueError("1 <= gram < length <= 128")
    src = _keyed(docs, id_col, text_col)
    spark = docs.sparkSession
    one = cut(_sorted_pairs(src.filter(F.octet_length("text") >= length).mapInArrow(_first_round(length, gram), _SCHEMA)),
              "repeats-1")
    release(spark)
    still = _shared_cells(one.filter(F.col("kind") == OPEN), length, gram)
    two = cut(_sorted_pairs(src.join(still, ["doc", "hash"]).select("doc", "hash", "text", "cells")
                            .mapInArrow(_last_round(length, gram), _SCHEMA)), "repeats-2")
    release(spark)
    found = one.unionByName(two).filter(F.col("kind") == REPEAT)
    return found.groupBy("doc", "hash").agg(
        F.collect_list(F.struct(F.col("k2").alias("lo"), F.col("k3").alias("hi"))).alias("spans"))


def merged(spans, n: int, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs [a, b) covered by the strings that start in ``spans``."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        a, b = lo, min(hi + length, n)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             length: int = LENGTH, gram: int = GRAM, finish=None, schema: str | None = None) -> DataFrame:
    """One row per document: id, text, ``removed`` (sorted maximal byte runs). ``finish``
    turns batches of (doc, text, removed) into batches of ``schema`` in the same worker."""
    spans = removed_spans(docs, id_col, text_col, length, gram)
    joined = _keyed(docs, id_col, text_col).join(spans, ["doc", "hash"], "left")

    def run(batches):
        for b in bounded(batches, "text", BLOCK):
            _, off = binary_parts(b.column("text"))
            n = np.diff(off)
            out = [[{"lo": a, "hi": z} for a, z in merged([(s["lo"], s["hi"]) for s in sp or []], int(n[i]), length)]
                   for i, sp in enumerate(b.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), b.column("text"), pa.array(out, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))],
                ["doc", "text", "removed"])
    rows = joined.select("doc", "text", "spans").mapInArrow(
        (lambda b: finish(run(b))) if finish else run, schema or "doc long, text string, removed array<struct<lo: long, hi: long>>")
    return rows.select(id_back("doc").alias("doc_id"), *[c for c in rows.columns if c != "doc"])


def kept_text(raw: bytes, runs: list[tuple[int, int]]) -> str:
    """The characters all of whose bytes stay."""
    out, at = [], 0
    for a, b in [*runs, (len(raw), len(raw))]:
        while at < len(raw) and raw[at] & 0xC0 == 0x80:       # tail of a character cut at its front
            at += 1
        end = a
        while end > at and end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        if end > at:
            out.append(raw[at:end])
        at = b
    return b"".join(out).decode()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated byte runs cut from the text (a character goes when any of
    its bytes does); rows and other columns stay. Null texts stay null."""
    spans = removed_spans(docs, id_col, text_col, length, gram)
    doc, text_hash, cuts = fresh(docs, "doc_key", "text_hash", "cuts")
    keyed = docs.select(*docs.columns, id_key(id_col).alias(doc), F.xxhash64(text_col).alias(text_hash))
    joined = keyed.join(spans.select(F.col("doc").alias(doc), F.col("hash").alias(text_hash), F.col("spans").alias(cuts)),
                        [doc, text_hash], "left").select(*docs.columns, cuts)
    names = docs.columns
    where = names.index(text_col)

    def run(batches):
        for b in bounded(batches, text_col, BLOCK):
            texts = b.column(where).cast(pa.binary()).to_pylist()
            new = []
            for raw, sp in zip(texts, b.column(cuts).to_pylist(), strict=True):
                if raw is None:
                    new.append(None)
                elif not sp:
                    new.append(raw.decode())
                else:
                    new.append(kept_text(raw, merged([(s["lo"], s["hi"]) for s in sp], len(raw), length)))
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            cols[where] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)
    return joined.mapInArrow(run, docs.schema)
