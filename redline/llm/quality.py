"""Quality classifier (operator 4): ordinal cumulative-link regression.

Documents are graded 0 (toxic), 1 (poor), 2 (good). One weight vector over hashed
text features gives a score z, and ordered thresholds t0 < t1 give
``P(grade <= j) = sigmoid(t_j - z)``; the expected grade is the sum of ``P(grade > j)``
and ``p_tail`` = P(grade 2) decides the selection.

Features, hashed into ``DIM`` slots: the distinct words (case-folded, outer marks
stripped); the shares of word shapes (capitals, digits, marks of the whole word); the shares of repeated
words and repeated word pairs. Training is proximal AdaGrad with an L1 penalty, on at
most ``MAX_TRAIN`` labelled documents chosen by a hash of the id; scoring reads all documents.

Defined cases: null or empty text has no features and gets the prior's verdict by the
thresholds; a document with several label rows has the lowest grade; label rows with nulls
are skipped; without labelled documents of two grades all are kept with p_tail 1;
repeated rows are scored alike; extra columns are ignored by ``score``, kept by ``select``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.llm.common import bounded

DIM, MAX_TRAIN, GRADES = 1 << 18, 8_000, 3
CACHE, LONGEST = 250_000, 64           # words remembered by a task, and their length at most
_MARKS = re.compile(r"^\W+|\W+$")
_LETTER, _DIGIT, _RUN = re.compile(r"[^\W\d_]"), re.compile(r"\d"), re.compile(r"([^_])\1+")
_KIND = {k: zlib.crc32(f"{k}:".encode()) for k in "wsr"}


def _slot(kind: str, key: str) -> int:
    return zlib.crc32(key.encode(), _KIND[kind]) & (DIM - 1)


class _Classes(dict):
    """Code point -> A (capital), a (other letter), 0 (digit) or itself, for str.translate."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = out = ("A" if c.isupper() else "a") if _LETTER.match(c) else "0" if _DIGIT.match(c) else c
        return out


class Hasher:
    """Word -> slot of the word and slot of its shape, remembered up to a bound."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.shapes: dict[str, int] = {}              # slot by the classes of a word
        self.classes = _Classes()

    def _add(self, word: str) -> int:
        for table in (self.known, self.shapes):
            if len(table) >= CACHE:
                table.clear()
        keep = len(word) <= LONGEST                   # longer words are hashed anew each time
        kinds = word.translate(self.classes)
        shape = self.shapes.get(kinds)
        if shape is None:
            shape = _slot("s", _RUN.sub(r"\1", kinds))
            if keep:
                self.shapes[kinds] = shape
        low = word.lower()
        if not (low[0].isalnum() and low[-1].isalnum()):
            low = _MARKS.sub("", low)
        got = _slot("w", low) * DIM + shape
        if keep:
            self.known[word] = got
        return got

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(slots, values), slots distinct and ascending."""
        words = (text or "").split()
        n = len(words)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0)
        count, known = Counter(words), self.known
        both = np.fromiter((known.get(w) or self._add(w) for w in count), np.int64, len(count))
        often = np.fromiter(count.values(), np.float64, len(count))
        shapes, at = np.unique(both % DIM, return_inverse=True)
        share = np.bincount(at, often) / n
        slots = np.r_[np.unique(both // DIM), shapes, _REPEATS]
        values = np.r_[np.ones(len(slots) - len(shapes) - 2), 4 * share, 4 * max(often.max() / n - 0.1, 0),
                       4 * (1 - len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1)) if n > 1 else 0.0]
        order = np.argsort(slots, kind="stable")
        slots, values = slots[order], values[order]
        head = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
        return slots[head], np.add.reduceat(values, head)


_REPEATS = [_slot("r", "word"), _slot("r", "pair")]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Model:
    """Shared weights and ordered thresholds; ``weights`` is None if all are kept."""

    def __init__(self, weights: np.ndarray | None, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    def judge(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, P(best grade)) of scores."""
        if self.weights is None:
            return np.full(len(z), float(GRADES - 1)), np.ones(len(z))
        above = 1 - _sigmoid(self.cuts[None, :] - z[:, None])
        return above.sum(axis=1), above[:, -1]


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], l1: float = 2e-3, epochs: int = 12, step: float = 0.15,
          batch: int = 256, min_steps: int = 200, min_docs: int = 3, seed: int = 11) -> Model:
    """Fit on (grade, slots, values); features of fewer than ``min_docs`` documents are left
    out. It takes ``epochs`` passes, more if those are under ``min_steps`` batches."""
    grade = np.array([g for g, _, _ in rows], np.int64)
    if len(np.unique(grade)) < 2:
        return Model(None, np.zeros(GRADES - 1))
    seen = np.zeros(DIM, np.int64)
    for _, s, _ in rows:
        seen[s] += 1
    used = np.flatnonzero(seen >= min_docs)
    to = np.full(DIM, -1, np.int32)
    to[used] = np.arange(len(used), dtype=np.int32)
    data = [(to[s][to[s] >= 0], np.asarray(v, np.float32)[to[s] >= 0]) for _, s, v in rows]
    w, gw = np.zeros(len(used)), np.full(len(used), 1e-6)
    below = np.array([np.clip((grade <= j).mean(), 1e-3, 1 - 1e-3) for j in range(GRADES - 1)])
    first = np.log(below / (1 - below))
    # t0 = a, t_j = t_(j-1) + exp(b_j): the thresholds stay ordered
    theta = np.r_[first[0], np.log(np.maximum(np.diff(first), 1e-2))]
    gt = np.full(len(theta), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(max(epochs, -(-min_steps * batch // len(data)))):
        order = rng.permutation(len(data))
        for a in range(0, len(order), batch):
            pick = order[a:a + batch]
            at = np.concatenate([data[i][0] for i in pick])
            val = np.concatenate([data[i][1] for i in pick])
            row = np.repeat(np.arange(len(pick)), [len(data[i][0]) for i in pick])
            z = np.bincount(row, w[at] * val, len(pick))
            cuts = theta[0] + np.r_[0, np.cumsum(np.exp(theta[1:]))]
            edge = np.r_[-np.inf, cuts, np.inf]
            y = grade[pick]
            hi, lo = _sigmoid(edge[y + 1] - z), _sigmoid(edge[y] - z)
            p = np.maximum(hi - lo, 1e-9)
            dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p    # d log p / d upper, lower threshold
            dz = dhi - dlo                                      # of the loss
            g = np.bincount(at, dz[row] * val, len(w)) / len(pick)
            gw += g * g
            rate = step / np.sqrt(gw)
            w -= rate * g
            w = np.sign(w) * np.maximum(np.abs(w) - l1 * rate, 0)
            dcut = np.array([(-dhi[y == j]).sum() + dlo[y == j + 1].sum() for j in range(GRADES - 1)]) / len(pick)
            gtheta = np.r_[dcut.sum(), [dcut[j:].sum() * np.exp(theta[j]) for j in range(1, len(theta))]]
            gt += gtheta * gtheta
            theta -= step * gtheta / np.sqrt(gt)
    full = np.zeros(DIM)
    full[used] = w
    return Model(full, theta[0] + np.r_[0, np.cumsum(np.exp(theta[1:]))])


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 poor, 2 good; the lowest of a document's rows."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return (labels.filter("doc_id is not null and toxic is not null and quality is not null")
            .groupBy("doc_id").agg(F.min(grade).alias("grade")))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, **params) -> Model:
    """Fit on at most ``max_train`` labelled rows of ``docs``; only their hashed features
    reach the driver."""
    chosen = grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in bounded(batches, "text", 2 << 20):
            got = [hasher.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("grade"), pa.array([s.astype("<i4").tobytes() for s, _ in got], pa.binary()),
                 pa.array([v.astype("<f4").tobytes() for _, v in got], pa.binary())], ["doc_id", "grade", "s", "v"])
    found = rows.mapInArrow(run, "doc_id long, grade int, s binary, v binary").orderBy(
        F.xxhash64("doc_id"), "doc_id", "s", "v").limit(max_train)
    table = found.toArrow()                                     # bounded by max_train
    data = [(g, np.frombuffer(s, "<i4"), np.frombuffer(v, "<f4"))
            for g, s, v in zip(table["grade"].to_pylist(), table["s"].to_pylist(), table["v"].to_pylist(), strict=True)]
    return train(data, **params)


def _judged(model: Model, texts: list[str | None], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    z = np.zeros(len(texts))
    if model.weights is not None:
        for i, t in enumerate(texts):
            s, v = hasher.features(t)
            z[i] = model.weights[s] @ v
    return model.judge(z)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, p_tail, keep) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in bounded(batches, "text", 2 << 20):
            grade, tail = _judged(model, b.column("text").to_pylist(), hasher)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(grade), pa.array(tail), pa.array(tail >= threshold)],
                                             ["doc_id", "expected_grade", "p_tail", "keep"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, expected_grade double, p_tail double, keep boolean")


def select(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with P(best grade) of at least ``threshold``; all columns stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in bounded(batches, text_col, 2 << 20):
            _, tail = _judged(model, b.column(text_col).to_pylist(), hasher)
            if (tail >= threshold).any():
                yield b.filter(pa.array(tail >= threshold))
    return docs.mapInArrow(run, docs.schema)
