"""Chat formatting (operator 1): columnar byte assembly.

``format_conversations`` sorts the turns of each conversation and writes them as
``<|turn|>role\\ntext<|end|>\\n``. Per Arrow batch the segment lengths, the cumulative
offsets and the scatter indices are numpy arrays, and all headers and contents are
copied into one preallocated buffer, which becomes the output column as it is.

Control strings inside roles and texts get a backslash after their first character
(one more if backslashes are there already), so they never read as marks and
``unescape`` restores them exactly. In roles, backslash and line feed are escaped too.

A conversation leaves as pieces (one per batch it spans), numbered from 0, so one of
any length is never held whole. ``read_back`` streams over the pieces in order.

Defined cases: null role or text is empty; a null conv_id is a conversation of its
own; turns sort by turn, role, text (null turn first), and repeated rows all stay;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.llm.common import binary_parts, bounded, ranges

TURN, END = "<|turn|>", "<|end|>"
_TAILS = r"\|turn\|>|\|end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>"
_ESCAPE = rf"([<\[])(\\*)({_TAILS})"
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_TAILS})")
BLOCK = 4 << 20
PIECES = "conv_id long, piece int, n_turns int, formatted binary, loss_start array<long>, loss_length array<long>"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=_ESCAPE, replacement=r"\1\\\2\3")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def escape_role(roles: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(escape(roles), "\\", "\\\\"), "\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def _put(out: np.ndarray, at: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> None:
    """Copy the segments of ``data`` (back to back) to the offsets ``at``."""
    out[ranges(at, lengths)] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, turn offsets, text starts, text lengths) of formatted turns."""
    head, mid, tail = (np.frombuffer(s.encode(), np.uint8) for s in (TURN, "\n", END + "\n"))
    role, role_off = binary_parts(escape_role(roles))
    text, text_off = binary_parts(escape(texts))
    n, role_len, text_len = len(roles), np.diff(role_off), np.diff(text_off)
    offsets = np.r_[0, np.cumsum(len(head) + role_len + len(mid) + text_len + len(tail))]
    out = np.empty(int(offsets[-1]), np.uint8)
    at = offsets[:-1]
    _put(out, at, np.full(n, len(head)), np.tile(head, n))
    _put(out, at + len(head), role_len, role)
    _put(out, at + len(head) + role_len, np.full(n, len(mid)), np.tile(mid, n))
    start = at + len(head) + role_len + len(mid)
    _put(out, start, text_len, text)
    _put(out, start + text_len, np.full(n, len(tail)), np.tile(tail, n))
    return out, offsets, start, text_len


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Pieces of formatted conversations with the byte spans under the loss mask."""
    src = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, piece = None, -1                                # (conversation,) of the last piece
        for b in bounded(batches, "text", BLOCK):
            ids = b.column("conv_id")
            key, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            new = np.r_[True, (key[1:] != key[:-1]) | (null[1:] != null[:-1])]
            head = np.r_[np.flatnonzero(new), b.num_rows]
            out, off, start, length = assemble(b.column("role"), b.column("text"))
            masked = pc.equal(b.column("role"), loss_role).to_numpy(zero_copy_only=False)
            convs = ids.take(pa.array(head[:-1]))
            number = np.zeros(len(head) - 1, np.int32)
            first = (convs[0].as_py(),)
            number[0] = piece + 1 if first == last else 0
            last, piece = (convs[-1].as_py(),), int(number[-1])
            cum = np.r_[0, np.cumsum(masked)]
            lists = pa.array(cum[head].astype(np.int32))
            home = np.repeat(off[head[:-1]], np.diff(head))
            formatted = pa.Array.from_buffers(
                pa.large_binary(), len(head) - 1, [None, pa.py_buffer(off[head].astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [convs, pa.array(number), pa.array(np.diff(head).astype(np.int32)), formatted,
                 pa.ListArray.from_arrays(lists, pa.array((start - home)[masked].astype(np.int64))),
                 pa.ListArray.from_arrays(lists, pa.array(length[masked].astype(np.int64)))],
                ["conv_id", "piece", "n_turns", "formatted", "loss_start", "loss_length"])
    return ordered.mapInArrow(run, PIECES)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted piece."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape_role(role), unescape(rest[:rest.rindex(END)])))
    return turns


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its formatted pieces (as
    ``format_conversations`` yields them: a conversation's pieces in order in one
    partition). Between batches only the running hashes are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in itertools.chain(batches, [None]):
            done = []
            rows = b.to_pylist() if b is not None else [None]
            for r in rows:
                if r is None or (r["conv_id"],) != key:
                    if state is not None:
                        done.append((key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    if r is None:
                        break
                    key, state = (r["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = r["formatted"].decode()
                for role, body in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for s, n in zip(r["loss_start"], r["loss_length"], strict=True):
                    plain = unescape(r["formatted"][s:s + n].decode())
                    state[2] += len(plain)
                    state[3].update(plain.encode())
                state[4] += len(text)
            if done:
                cols = list(zip(*done, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                                 ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return pieces.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                  "loss_sha256 string, formatted_chars long")
