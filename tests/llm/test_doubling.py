"""Prefix doubling over every position gives the spans of the sampled search."""

from __future__ import annotations

import random

import pytest

from redline.llm import doubling, substring_dedup
from redline.llm.common import read

SCHEMA = "doc_id long, text string"


def _both(docs, length=100, first=25, gram=24):
    one = {(r.doc, r.hash, r.pos) for r in doubling.repeated_starts(docs, length=length, first=first).collect()}
    two = {(r.doc, r.hash, p) for r in substring_dedup.removed_spans(docs, length=length, gram=gram).collect()
           for s in r.spans for p in range(s.lo, s.hi + 1)}
    return one, two


def _brute(rows, length):
    """(key, start) of each repeat; the key is the id (None first)."""
    seen, out = set(), set()
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        for p in range(len(raw) - length + 1):
            s = raw[p:p + length]
            if s in seen:
                out.add((i, p))
            seen.add(s)
    return out


def test_doubling_equals_the_sampled_search_on_a_whole_table(spark):
    one, two = _both(read(spark, "/root/testdata/sf0.001", "documents"))
    assert one == two and one


@pytest.mark.parametrize("length,first", [(100, 25), (40, 7), (33, 33)])
def test_doubling_equals_brute_force(spark, length, first):
    rng = random.Random(length)
    passage = "".join(rng.choice("abcdé ") for _ in range(160))
    rows = [(i, "".join(rng.choice("abcdé ") for _ in range(rng.randrange(150))) + passage[rng.randrange(60):])
            for i in range(12)]
    rows += [(20, "x" * 300), (21, None), (22, ""), (23, "short"), (None, passage)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(None if r.doc < 0 else r.doc, r.pos) for r in doubling.repeated_starts(docs, length=length, first=first).collect()}
    assert got == _brute(rows, length)


def test_doubling_of_an_empty_table_and_of_equal_rows(spark):
    assert doubling.repeated_starts(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "".join(chr(97 + i % 26) + str(i) for i in range(80))
    assert doubling.repeated_starts(spark.createDataFrame([(1, text), (1, text)], SCHEMA)).count() == 0
