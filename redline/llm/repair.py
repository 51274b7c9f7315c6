"""Token-id output in Re-Pair grammar files (operator 5).

``write`` range-partitions documents by id and writes blocks of encoded documents in ascending
order. In each block frequent id pairs are replaced by nonterminals, round after
round until no pair occurs ``MIN_COUNT`` times; a block stores its rules, the expansion length of each nonterminal, and per
document its id, its symbols and its tokens. Pairs never cross documents, so
any document, or any stretch of one, is decoded without the others.

File format: Parquet rows (shard, block, first_id, n_docs, n_tokens, payload); shards and
the blocks in them ascend by document id. The payload holds little-endian arrays:
document ids, symbols per document, tokens per document, left and right side of each rule,
expansion length of each rule, symbols (compressed byte planes, but the ids).

Defined cases: null text is empty and has the end id alone; a null id sorts first;
rows that share an id follow each other, ordered by text; extra columns are ignored; an
empty table gives no files' rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from redline.llm.bpe import _join, _planes, _split, _values, tokenizer
from redline.llm.common import binary_parts, bounded, id_back, id_key, longs, ranges

BLOCK, END_ID = 4 << 20, 2
RULES_PER_ROUND, MIN_COUNT = 4096, 16
WORDS = 1_500_000                       # words remembered by a worker, checked once a block
FILE_SCHEMA = "shard int, block int, first_id long, n_docs int, n_tokens long, payload binary"


#: Texts of other characters than these, or with contractions or special tokens, are
#: cut at blanks only; in the rest lower-casing and normal form are plain.
_NOT_PLAIN = r"'|<\||[^\t\n\r -~\x{A1}-\x{AC}\x{AE}-\x{FF}]"
#: Marks in a row and single digits are units of the vocabulary's own splitting.
_MARKS = r"([^\s\p{L}\p{N}]+|\p{N})"
WORD_END = "</w>"


#: A value for each byte, and an odd base with its inverse modulo 2^64.
_BYTE = np.random.default_rng(5).integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWER: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first powers, and their inverses; at least n of each."""
    size = 1 << max(16, int(n).bit_length())
    if not _POWER or size > max(_POWER):
        made = []
        for x in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWER.clear()
        _POWER[size] = made[0], made[1]
    return _POWER[max(_POWER)]


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit polynomial hash of each string, all at once."""
    raw, off = binary_parts(strings)
    power, inverse = _powers(len(raw) + 1)
    upto = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[:len(raw)], out=upto[1:])
    return (upto[off[1:]] - upto[off[:-1]]) * inverse[off[:-1]] + np.diff(off).astype(np.uint64)


class _Table:
    """Ids of strings, numbered as they come. Strings are looked up by hash, in a sorted
    array, and compared."""

    def __init__(self):
        self.keys = pa.array([], pa.string())
        self.hash, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def numbers(self, strings: pa.Array, learn: Callable[[pa.Array], None]) -> np.ndarray:
        """Numbers of distinct strings; ``learn`` adds the unknown ones, in their order."""
        h = string_hashes(strings)
        order = np.argsort(h)
        place = np.searchsorted(self.hash, h[order])
        hit = place < len(self.hash)
        hit[hit] = self.hash[place[hit]] == h[order][hit]
        number = np.full(len(h), -1, np.int64)
        number[order[hit]] = self.at[place[hit]]
        known = np.flatnonzero(number >= 0)
        same = pc.equal(strings.take(pa.array(known)), self.keys.take(pa.array(number[known])))
        number[known[~same.to_numpy(zero_copy_only=False).astype(bool)]] = -1
        new = order[number[order] < 0]
        if len(new):
            in_order = np.sort(new)
            number[in_order] = len(self.keys) + np.arange(len(in_order))
            where = np.searchsorted(self.hash, h[new])
            self.hash, self.at = np.insert(self.hash, where, h[new]), np.insert(self.at, where, number[new])
            learn(strings.take(pa.array(in_order)))
        return number

    def add(self, strings: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        self.keys = pa.concat_arrays([self.keys, strings])
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per string) of strings by number."""
        size = self.size[numbers]
        return self.ids[ranges((np.cumsum(self.size) - self.size)[numbers], size)], size


class WordIds:
    """Ids of texts by their words, each encoded once while it is remembered. Plain texts are
    cut at blanks, and only words not yet known are cut further, into the vocabulary's own
    units (words, runs of marks, digits); new units are encoded many at a time,
    space-joined: each ends with its one word-end id. Other texts are cut at spaces, which
    never join words in this vocabulary, and their words are encoded whole."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.ends = np.zeros(first_symbol(path), bool)
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith(WORD_END)
        self.words, self.units = _Table(), _Table()

    def _whole(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tok.encode_batch_fast(strings, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.int32), np.array([len(x) for x in got], np.int64)

    def _learn_units(self, new: pa.Array) -> None:
        units, ids, size = new.to_pylist(), [], []
        for i in range(0, len(units), 64):
            some = units[i:i + 64]
            got = np.array(self.tok.encode(" ".join(some), add_special_tokens=False).ids, np.int32)
            ends = np.flatnonzero(self.ends[got]) + 1
            if "" in some or len(ends) != len(some) or ends[-1] != len(got):
                got, length = self._whole(some)
            else:
                length = np.diff(np.r_[0, ends])
            ids.append(got)
            size.append(length)
        self.units.add(new, np.concatenate(ids), np.concatenate(size))

    def _learn_words(self, new: pa.Array, plain: bool) -> None:
        if not plain:
            self.words.add(new, *self._whole(new.to_pylist()))
            return
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(new, pattern=_MARKS, replacement=r" \1 "))
        units = cut.flatten().dictionary_encode()
        number = self.units.numbers(units.dictionary, self._learn_units)
        ids, size = self.units.of(number[units.indices.to_numpy().astype(np.int64)])
        upto = np.r_[0, np.cumsum(size)][cut.offsets.to_numpy().astype(np.int64)]
        self.words.add(new, ids, np.diff(upto))

    def _numbers(self, texts: pa.Array, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, words per text)."""
        cut = pc.ascii_split_whitespace(pc.utf8_lower(texts)) if plain else pc.split_pattern(texts, " ")
        words = cut.flatten().dictionary_encode()
        number = self.words.numbers(words.dictionary, lambda new: self._learn_words(new, plain))
        codes = words.indices.to_numpy().astype(np.int64)
        return (number[codes] if len(number) else codes), np.diff(cut.offsets.to_numpy()).astype(np.int64)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, end id after each text; tokens per text)."""
        if len(self.words.keys) > WORDS:
            self.words, self.units = _Table(), _Table()
        other = pc.match_substring_regex(texts, pattern=_NOT_PLAIN)
        plain, odd = self._numbers(texts.filter(pc.invert(other)), True), self._numbers(texts.filter(other), False)
        mask = other.to_numpy(zero_copy_only=False)
        flat = np.concatenate([plain[0], odd[0]])
        per = np.empty(len(texts), np.int64)
        per[~mask], per[mask] = plain[1], odd[1]
        start = np.empty(len(texts), np.int64)
        start[~mask] = np.cumsum(plain[1]) - plain[1]
        start[mask] = len(plain[0]) + np.cumsum(odd[1]) - odd[1]
        words, size = self.words.of(flat[ranges(start, per)])
        # the end id goes after each text's ids
        count = np.diff(np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(per)]]) + 1
        ids = np.full(int(count.sum()), end_id, np.int32)
        inner = np.ones(len(ids), bool)
        inner[np.cumsum(count) - 1] = False
        ids[inner] = words
        return ids, count


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One table a Python worker: it serves all of the worker's tasks."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint32) * np.uint32(2654435761)) ^ (b.astype(np.uint32) * np.uint32(2246822519))) >> np.uint32(12)


def _frequent(s: np.ndarray, h: np.ndarray, inside: np.ndarray, rules: int, least: int) -> np.ndarray:
    """The most frequent pairs (left << 32 | right), by count, then pair. Counts by
    hash first, so that only pairs in well-filled buckets are counted one by one."""
    filled = np.bincount(h[inside], minlength=1 << 20)
    bar = max(least, int(np.partition(filled, -2 * rules)[-2 * rules]))
    some = np.flatnonzero(inside & (filled >= bar)[h])
    pairs, count = np.unique(s[some].astype(np.int64) << 32 | s[some + 1], return_counts=True)
    good = count >= least
    pairs, count = pairs[good], count[good]
    return pairs[np.lexsort((pairs, -count))[:rules]]


def compress(ids: np.ndarray, count: np.ndarray, first_symbol: int, rounds: int | None = None, rules: int = RULES_PER_ROUND,
             least: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols per document, rules left, rules right); without ``rounds`` until no
    pair occurs ``least`` times."""
    s, count = ids.astype(np.int32), count.copy()
    left, right = [], []
    for _ in itertools.count() if rounds is None else range(rounds):   # each round shortens s
        if len(s) < 2:
            break
        inside = np.ones(len(s) - 1, bool)
        ends = np.cumsum(count) - 1
        inside[ends[ends < len(s) - 1]] = False
        h = _hash(s[:-1], s[1:])
        pairs = _frequent(s, h, inside, rules, least)
        if not len(pairs):
            break
        a, b = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
        chosen = np.zeros(1 << 20, bool)
        chosen[_hash(a, b)] = True
        at = np.flatnonzero(inside & chosen[h])
        key = s[at].astype(np.int64) << 32 | s[at + 1]
        order = np.argsort(pairs)
        found = np.minimum(np.searchsorted(pairs[order], key), len(pairs) - 1)
        hit = pairs[order][found] == key
        at, which = at[hit], order[found[hit]]
        run = np.flatnonzero(np.r_[True, np.diff(at) > 1])          # in a run of hits every second counts
        take = (at - np.repeat(at[run], np.diff(np.r_[run, len(at)]))) % 2 == 0
        at, which = at[take], which[take]
        base = first_symbol + sum(map(len, left))
        s[at] = base + which
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        gone = np.searchsorted(at, np.r_[0, np.cumsum(count)])
        count = count - np.diff(gone)
        s = s[keep]
        left.append(a)
        right.append(b)
    none = np.zeros(0, np.int32)
    return s, count, np.concatenate(left) if left else none, np.concatenate(right) if right else none


def lengths(left: np.ndarray, right: np.ndarray, first_symbol: int) -> np.ndarray:
    """Ids each rule expands to."""
    out = np.ones(len(left), np.int64)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        out[i] = sum(1 if x < first_symbol else out[x - first_symbol] for x in (a, b))
    return out


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, first_symbol: int) -> np.ndarray:
    """The ids that a stretch of symbols stands for."""
    s = symbols.astype(np.int64)
    while True:
        rule = s >= first_symbol
        if not rule.any():
            return s
        at = np.cumsum(1 + rule) - 1 - rule
        out = np.empty(len(s) + int(rule.sum()), np.int64)
        out[at] = s
        where, r = at[rule], s[rule] - first_symbol
        out[where], out[where + 1] = left[r], right[r]
        s = out


def expand_all(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, length: np.ndarray, first_symbol: int) -> np.ndarray:
    """``expand`` of many symbols: each rule is expanded once, then copied."""
    rules = expand(first_symbol + np.arange(len(left)), left, right, first_symbol).astype(np.int32)
    table = np.concatenate([np.arange(first_symbol, dtype=np.int32), rules])
    size = np.concatenate([np.ones(first_symbol, np.int64), length.astype(np.int64)])
    return table[ranges((np.cumsum(size) - size)[symbols], size[symbols])]


class Block:
    """One stored block, open for random access."""

    def __init__(self, payload: bytes, first_symbol: int):
        ids, symbols, tokens, left, right, length, s = _split(payload)
        self.doc_ids = np.frombuffer(ids, "<i8")
        self.symbols_of, self.tokens_of = _values(symbols), _values(tokens)
        self.left, self.right, self.length, self.s = _values(left), _values(right), _values(length), _values(s)
        self.first_symbol = first_symbol
        self.start = np.r_[0, np.cumsum(self.symbols_of)]

    def whole(self) -> np.ndarray:
        """Ids of all documents, one after the other."""
        return expand_all(self.s, self.left, self.right, self.length, self.first_symbol)

    def document(self, i: int) -> np.ndarray:
        return expand(self.s[self.start[i]:self.start[i + 1]], self.left, self.right, self.first_symbol)

    def tokens(self, i: int, a: int, z: int) -> np.ndarray:
        """Ids a to z of document i; only the symbols that cover them are expanded."""
        s = self.s[self.start[i]:self.start[i + 1]]
        size = np.ones(len(s), np.int64)
        rule = s >= self.first_symbol
        size[rule] = self.length[s[rule] - self.first_symbol]
        ends = np.cumsum(size)
        p, q = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(ends, z, side="left")) + 1
        before = int(ends[p - 1]) if p else 0
        return expand(s[p:q], self.left, self.right, self.first_symbol)[a - before:z - before]


def first_symbol(path: str) -> int:
    return tokenizer(path).get_vocab_size(with_added_tokens=True)


def write(docs: DataFrame, out: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode every document and write the files to ``out``."""
    src = docs.select(id_key(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = src.repartitionByRange("doc").sortWithinPartitions("doc", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base, shard = word_ids(path), first_symbol(path), TaskContext.get().partitionId()
        for block, b in enumerate(bounded(batches, "text", BLOCK)):
            doc = longs(b.column("doc"))
            ids, count = words.encode(b.column("text"), end_id)
            s, symbols, left, right = compress(ids, count, base)
            payload = _join(doc.astype("<i8").tobytes(), _planes(symbols), _planes(count), _planes(left), _planes(right),
                            _planes(lengths(left, right, base)), _planes(s))
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([int(doc[0])]),
                 pa.array([len(doc)], pa.int32()), pa.array([int(count.sum())]), pa.array([payload], pa.binary())],
                ["shard", "block", "first_id", "n_docs", "n_tokens", "payload"])
    ordered.mapInArrow(run, FILE_SCHEMA).write.parquet(out)


def read_documents(spark: SparkSession, out: str, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    files = spark.read.schema(FILE_SCHEMA).parquet(out)
    base = first_symbol(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, number, payload in zip(*(b.column(c).to_pylist() for c in ("shard", "block", "payload")), strict=True):
                block = Block(payload, base)
                n = len(block.doc_ids)
                raw, size = block.whole().astype("<u4").tobytes(), block.tokens_of.astype(np.int64)
                edge = (4 * np.r_[0, np.cumsum(size)]).tolist()
                if edge[-1] != len(raw):
                    raise ValueError(f"shard {shard}, block {number}: {edge[-1]} bytes of ids recorded, {len(raw)} decoded")
                crc = np.array([zlib.crc32(raw[a:z]) for a, z in zip(edge[:-1], edge[1:], strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, number, np.int32)), pa.array(block.doc_ids),
                     pa.array(np.cumsum(size) - size), pa.array(size), pa.array(crc)],
                    ["shard", "block", "doc", "inside", "n_tokens", "ids_crc32"])
    docs = files.select("shard", "block", "payload").mapInArrow(
        run, "shard int, block int, doc long, inside long, n_tokens long, ids_crc32 long")
    sizes = files.select("shard", "block", "n_tokens")
    past = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn(
        "shard_base", past(Window.orderBy("shard"))).drop("n")      # one row per shard
    bases = sizes.withColumnRenamed("n_tokens", "n").withColumn(
        "block_base", past(Window.partitionBy("shard").orderBy("block"))).join(shards, "shard")
    return docs.join(bases.select("shard", "block", (F.col("shard_base") + F.col("block_base")).alias("base")), ["shard", "block"]).select(
        id_back("doc").alias("doc_id"), (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
