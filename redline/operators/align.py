"""LCS length (E1) and LCS alignment (E2) of token arrays.

Both run as Arrow UDFs: one Python call per Arrow batch, with a bit-parallel LCS
inside (Allison & Dix 1986; Crochemore et al. 2001; Hyyro 2004). The row of the
DP table is a bit vector ``V`` over the target positions, with dp[i][j] =
number of zero bits of ``V_i`` below bit j. Python integers are arbitrary
precision, so whole sentences of any length are handled in O(m * n / 64) word
operations; nothing is cut.

Alignment semantics: case-sensitive token equality; the backtrace starts at
(m, n), matches equal tokens, otherwise moves up (drops a source token) when
dp[i-1][j] >= dp[i][j-1], else left. A common suffix is therefore matched
first and may be trimmed; a common prefix may not.

``lcs_length_native`` computes E1 with Spark's own ``aggregate`` lambdas: slow,
used only as a cross-check in tests.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redline.operators.skew import pack

ALIGN_TYPE = pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32())]))
ALIGN_SPARK_TYPE = T.ArrayType(T.StructType([
    T.StructField("s", T.IntegerType()), T.StructField("t", T.IntegerType())]))


def _masks(b) -> dict:
    masks: dict = {}
    bit = 1
    for tok in b:
        masks[tok] = masks.get(tok, 0) | bit
        bit <<= 1
    return masks


def lcs_len(a, b) -> int:
    """Length of the longest common subsequence of two token lists."""
    if not a or not b:
        return 0
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < hi_a and lo < hi_b and a[lo] == b[lo]:
        lo += 1
    common = lo
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a -= 1
        hi_b -= 1
    common += len(a) - hi_a
    a, b = a[lo:hi_a], b[lo:hi_b]
    if not a or not b:
        return common
    if len(b) > len(a):
        a, b = b, a
    masks = _masks(b)
    full = (1 << len(b)) - 1
    v = full
    for tok in a:
        u = v & masks.get(tok, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return common + len(b) - v.bit_count()


class _Rows:
    """DP rows ``V_0..V_m`` as bit vectors. Small tables keep every row; above
    ``full_table_bits`` only every ``k``-th row (k = ceil(sqrt(m))) is kept and
    one segment at a time is recomputed from it during the backtrace, which
    walks rows downwards: memory O(sqrt(m) * n) bits, about twice the forward
    work, same result."""

    def __init__(self, src, tgt, full_table_bits: int):
        self.src, self.masks = src, _masks(tgt)
        self.full = (1 << len(tgt)) - 1
        m = len(src)
        self.k = 1 if m * len(tgt) <= full_table_bits else max(1, math.isqrt(m - 1) + 1)
        self.ck: list[int] = []
        self.seg, self.cache = -1, []
        v = self.full
        for i in range(m + 1):
            if i % self.k == 0:
                self.ck.append(v)
            if i < m:
                v = self._step(v, src[i])

    def _step(self, v: int, tok) -> int:
        u = v & self.masks.get(tok, 0)
        return ((v + u) | (v - u)) & self.full if u else v

    def get(self, i: int) -> int:
        s, r = divmod(i, self.k)
        if r == 0:
            return self.ck[s]
        if s != self.seg:
            v, cache = self.ck[s], []
            for t in range(s * self.k, min(s * self.k + self.k, len(self.src) + 1) - 1):
                v = self._step(v, self.src[t])
                cache.append(v)
            self.seg, self.cache = s, cache
        return self.cache[r - 1]


def _small_rows(src, tgt):
    """All DP rows ``V_0..V_m`` of a small table, by number."""
    find, full = _masks(tgt).get, (1 << len(tgt)) - 1
    v, rows = full, [full]
    for tok in src:
        u = v & find(tok, 0)
        if u:
            v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows.__getitem__


def _along_prefix(src, tgt, m: int, n: int, out: list) -> tuple[int, int]:
    """The backtrace from (m, n) without the DP table where one side is a prefix of
    the other, or both are equal but for their last words; else (m, n) as given.

    With ``src[:k] == tgt[:k]`` and k the shorter length, dp is k while the longer side
    has k words or more, so the walk leaves the longer side's last word unless the two
    last words are equal. Two last words that differ are left upwards first."""
    if m > 1 and m == n and src[m - 1] != tgt[n - 1] and src[:m - 1] == tgt[:n - 1]:
        m -= 1
    elif src[:min(m, n)] != tgt[:min(m, n)]:
        return m, n
    while m != n and m and n:
        if src[m - 1] == tgt[n - 1]:
            m -= 1
            n -= 1
            out.append((m, n))
        elif n > m:
            n -= 1
        else:
            m -= 1
    if m == n:
        out.extend((k, k) for k in reversed(range(m)))
        return 0, 0
    return m, n


FULL_TABLE_BITS = 1 << 26  # 8 MB of DP bits per pair before rows are recomputed


def lcs_align(src, tgt, full_table_bits: int = FULL_TABLE_BITS) -> list[tuple[int, int]]:
    """Matched ``(src_idx, tgt_idx)`` pairs, 0-based, increasing in both."""
    m, n = len(src), len(tgt)
    out: list[tuple[int, int]] = []
    while m > 0 and n > 0 and src[m - 1] == tgt[n - 1]:
        m -= 1
        n -= 1
        out.append((m, n))
    m, n = _along_prefix(src, tgt, m, n, out)
    if m > 0 and n > 0:
        row = _small_rows(src[:m], tgt[:n]) if m * n <= full_table_bits else _Rows(src[:m], tgt[:n], full_table_bits).get

        left, without = n, row(m)                 # target words not yet passed
        for at in reversed(range(m)):
            word, with_it, without = src[at], without, row(at)
            # what this word adds to the length over the remaining target words (0 or 1)
            gain = 0
            if with_it != without:
                below = (1 << left) - 1
                gain = (without & below).bit_count() - (with_it & below).bit_count()
                while gain and tgt[left - 1] != word:
                    left -= 1
                    gain -= (without >> left & 1) - (with_it >> left & 1)
            if tgt[left - 1] == word:
                left -= 1
                out.append((at, left))
            if not left:
                break
    out.reverse()
    return out


@F.arrow_udf(T.LongType())
def _lcs_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    res = [None if x is None or y is None else lcs_len(x, y)
           for x, y in zip(a.to_pylist(), b.to_pylist())]
    return pa.array(res, type=pa.int64())


@F.arrow_udf(ALIGN_SPARK_TYPE)
def _align_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    res = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        if x is None or y is None:
            res.append(None)
        else:
            res.append([{"s": s, "t": t} for s, t in lcs_align(x, y)])
    return pa.array(res, type=ALIGN_TYPE)


def lcs_length(a, b) -> Column:
    """LCS length of two ``array<string>`` columns (null if either is null)."""
    return _lcs_udf(a, b)


def alignment(src, tgt) -> Column:
    """``array<struct<s:int,t:int>>`` alignment of two token arrays."""
    return _align_udf(src, tgt)


def balanced(pairs: DataFrame, src: str = "src_tok", tgt: str = "tgt_tok", key: str = "pair_id",
             parts: int | None = None) -> DataFrame:
    """``pairs`` dealt into tasks by what the alignment costs (words x words in
    machine words, plus a constant a row), not by number of rows: one task can't
    hold several very long pairs while others wait."""
    n, m = F.size(src).cast("double"), F.size(tgt).cast("double")
    return pack(pairs, n * (m / 64 + 1) + m + 20, key, parts)


def lcs_length_native(a, b) -> Column:
    """E1 with native lambdas: nested ``aggregate`` over the DP rows (tests only)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    zero_row = F.array_repeat(F.lit(0), F.size(b) + 1)

    def next_row(prev, x):
        # cur[0] = 0; cur[j] = prev[j-1] + 1 if x == b[j-1] else max(prev[j], cur[j-1])
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))),
            F.array(F.lit(0)),
            lambda cur, j: F.when(F.size(b) == 0, cur).otherwise(F.concat(cur, F.array(
                F.when(F.element_at(b, j) == x, F.element_at(prev, j) + 1)
                .otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(cur, j)))))))

    last = F.aggregate(a, zero_row, next_row)
    return F.element_at(last, -1).cast("bigint")
