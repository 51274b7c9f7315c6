"""BPE encoding and decoding by a distinct-word table (operator 10).

1. Split: each task cuts its texts into words at blanks where the tokenizer's own
   splitting always cuts (a space after a non-blank), keeps the text as word numbers, and
   sends each distinct word of a chunk once, packed by a hash bucket of the word.
2. Table: per bucket every distinct word is encoded once; the ids go back by chunk.
3. Join: word numbers and ids meet by chunk, and ids are laid out by position.
4. Decode: ids join the id-to-piece table, which has one row per vocabulary entry
   whatever the input, and the pieces' bytes are laid out the same way.

A word occurs once per chunk at most, so frequent words are no hot keys. A chunk holds
``CHUNK`` bytes of text (or one longer text); the number of buckets follows the
input's size.

Defined cases: null text is empty and has no ids; special tokens' strings in a text
become their ids, as the library does; repeated rows are encoded alike; a null id is
kept; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.llm.common import binary_parts, bounded, cut, id_back, id_key, longs, ranges, release
from redline.plans.session import checkpoint_dir

CHUNK = 16 << 20
BUCKET_BYTES = 8 << 20
_UNSAFE = re.compile(r"\s ")                  # a space after a blank is not a cut
_CUT = re.compile(r"(?<!\s)(?= )")
_PARTS = "chunk long, part int, data binary"


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"          # Spark's tasks are the parallelism
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _byte_of_char() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte: the
    printable Latin-1 characters stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The id-to-piece table: (bytes, start by id, length by id)."""
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    byte = _byte_of_char()
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        known = all(c in byte for c in token)
        table[i] = bytes(byte[c] for c in token) if known else token.encode()
    size = np.array([len(p) for p in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.r_[0, np.cumsum(size)[:-1]], size


def decode_bytes(ids: np.ndarray, path: str) -> bytes:
    data, start, size = pieces(path)
    return data[ranges(start[ids], size[ids])].tobytes()


def words_of(text: str) -> list[str]:
    """Words whose ids, one after the other, are the ids of the text."""
    if not text:
        return []
    if _UNSAFE.search(text):
        return [w for w in _CUT.split(text) if w]
    first, *rest = text.split(" ")
    return [first, *[" " + w for w in rest]] if first else [" " + w for w in rest]


def _planes(values: np.ndarray) -> bytes:
    """Byte planes of 32-bit values, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _values(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _join(*parts: bytes) -> bytes:
    head = np.array([len(parts), *map(len, parts)], "<i8").tobytes()
    return head + b"".join(parts)


def _split(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    size = np.frombuffer(data, "<i8", n, 8)
    out, at = [], 8 + 8 * n
    for s in size:
        out.append(data[at:at + s])
        at += int(s)
    return out


def _pack_words(words: list[bytes]) -> bytes:
    size = np.array([len(w) for w in words], np.int64)
    return _join(_planes(size), zstandard.ZstdCompressor(level=3).compress(b"".join(words)))


def _unpack_words(data: bytes) -> list[bytes]:
    size, raw = _split(data)
    ends = np.cumsum(_values(size)).tolist()
    raw = zstandard.ZstdDecompressor().decompress(raw)
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _split_words(buckets: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, chunk = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[np.ndarray, list[str | None]]] = []
        size = 0

        def flush():
            docs = np.concatenate([d for d, _ in held])
            code: dict[str, int] = {}
            codes, count = [], []
            for _, texts in held:
                for t in texts:
                    words = words_of(t) if t else []
                    count.append(len(words))
                    codes.append(np.array([code.setdefault(w, len(code)) for w in words], np.uint32))
            codes = np.concatenate(codes)
            words = [w.encode() for w in code]
            # frequent words get small numbers, which compress well
            often = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
            number = np.empty(len(words), np.uint32)
            number[often] = np.arange(len(words), dtype=np.uint32)
            words = [words[i] for i in often]
            bucket = np.array([xxhash.xxh32_intdigest(w) % buckets for w in words], np.int64)
            rows = [(base | chunk, -1, _join(docs.astype("<i8").tobytes(), _planes(np.array(count, np.int64)),
                                            _planes(number[codes]), _planes(bucket)))]
            order = np.argsort(bucket, kind="stable")
            edges = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    rows.append((base | chunk, int(bucket[order[a]]), _pack_words([words[i] for i in order[a:b]])))
            c, p, d = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(p, pa.int32()), pa.array(d, pa.binary())],
                                              ["chunk", "part", "data"])

        for b in bounded(batches, "text", chunk_bytes // 8):
            _, off = binary_parts(b.column("text"))
            if held and size + int(off[-1]) > chunk_bytes:
                yield flush()
                held, size, chunk = [], 0, chunk + 1
            held.append((longs(b.column("doc")), b.column("text").to_pylist()))
            size += int(off[-1])
        if held:
            yield flush()
    return run


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        part, known = None, {}                               # the table of the current bucket
        for b in batches:
            out = []
            for p, data in zip(b.column("part").to_pylist(), b.column("data").to_pylist(), strict=True):
                if p != part:
                    part, known = p, {}
                words = _unpack_words(data)
                new = [w for w in words if w not in known]
                for i in range(0, len(new), 4096):
                    some = new[i:i + 4096]
                    for w, e in zip(some, tok.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                        known[w] = np.array(e.ids, np.uint32)
                ids = [known[w] for w in words]
                out.append(_join(_planes(np.array([len(i) for i in ids], np.int64)), _planes(np.concatenate(ids))))
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("part"), pa.array(out, pa.binary())],
                                             ["chunk", "part", "data"])
    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (data, ids) of a chunk: its word numbers, and the buckets' ids."""
    for b in batches:
        for i in range(b.num_rows):
            docs, count, codes, bucket = _split(b.column("data")[i].as_py())
            got = sorted((p["part"], p["data"]) for p in b.column("ids")[i].as_py() or [])
            yield from _documents((docs, count, codes, _values(bucket)), [d for _, d in got])


def _documents(head, got: list[bytes]) -> Iterator[pa.RecordBatch]:
    docs, count, codes, bucket = head
    docs, count, codes = np.frombuffer(docs, "<i8"), _values(count), _values(codes)
    order = np.argsort(bucket, kind="stable")                # words as the buckets hold them
    both = [_split(d) for d in got]
    size = np.concatenate([_values(s) for s, _ in both]) if got else np.zeros(0, np.int64)
    ids = np.concatenate([_values(i) for _, i in both]) if got else np.zeros(0, np.int64)
    if len(size) != len(bucket):
        raise ValueError("a bucket's ids are missing")
    start, length = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
    start[order], length[order] = np.r_[0, np.cumsum(size)[:-1]] if len(size) else size, size
    ends = np.cumsum(count)
    for a in range(0, len(docs), 256):
        z = min(a + 256, len(docs))
        first = int(ends[a] - count[a])
        mine = codes[first:int(ends[z - 1])]
        flat = ids[ranges(start[mine], length[mine])].astype(np.int32)
        per = np.r_[0, np.cumsum(length[mine])][np.r_[first, ends[a:z]] - first]
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs[a:z]), pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.array(flat))], ["doc", "ids"])


def _joined(docs: DataFrame, path: str, id_col: str, text_col: str, chunk_bytes: int, buckets: int | None) -> DataFrame:
    """(data, ids): the word numbers of each chunk with the ids of its words."""
    if buckets is None:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        buckets = max(64, min(size // BUCKET_BYTES, 1 << 18))
    spark = docs.sparkSession
    parts = docs.select(id_key(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(
        _split_words(buckets, chunk_bytes), _PARTS).withColumn("kind", (F.col("part") >= 0).cast("int"))
    # stored in buckets by chunk: the word numbers, the bulk, are not shuffled again
    name = f"bpe_words_{uuid.uuid4().hex}"
    (parts.write.partitionBy("kind").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk")
     .option("path", f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}").saveAsTable(name))
    stored = spark.table(name)
    table = cut(stored.filter("kind = 1").select("chunk", "part", "data").repartition("part")
                .sortWithinPartitions("part", "chunk").mapInArrow(_encode_words(path), _PARTS), "bpe-ids")
    release(spark)
    ids = table.groupBy("chunk").agg(F.collect_list(F.struct("part", "data")).alias("ids"))
    return stored.filter("kind = 0").select("chunk", "data").join(ids, "chunk", "left").select("data", "ids")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           chunk_bytes: int = CHUNK, buckets: int | None = None) -> DataFrame:
    """(doc_id, ids) of every row, equal to the library's encode."""
    rows = _joined(docs, path, id_col, text_col, chunk_bytes, buckets)
    return rows.mapInArrow(_assemble, "doc long, ids array<int>").select(id_back("doc").alias("doc_id"), "ids")


def round_trip(docs: DataFrame, path: str, finish, schema: str, id_col: str = "doc_id", text_col: str = "text",
               chunk_bytes: int = CHUNK, buckets: int | None = None) -> DataFrame:
    """Encode, decode, and apply ``finish`` (batches of doc, ids, text to batches of
    ``schema``, whose column doc becomes doc_id) in one Python worker a task."""
    back = _decoded(path)
    rows = _joined(docs, path, id_col, text_col, chunk_bytes, buckets).mapInArrow(lambda b: finish(back(_assemble(b))), schema)
    return rows.select(id_back("doc").alias("doc_id"), *[c for c in rows.columns if c != "doc"])


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, off = b.column("ids").flatten().to_numpy(), b.column("ids").offsets.to_numpy()
            off = off - off[0]
            text = [decode_bytes(flat[off[i]:off[i + 1]], path).decode("utf-8", "replace") for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("ids"), pa.array(text, pa.string())],
                                             [b.schema.names[0], "ids", "text"])
    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) of rows (doc_id, ids): the library's decode, specials kept."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(path), "doc_id long, ids array<int>, text string")
