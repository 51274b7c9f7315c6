"""Operators 11 to 13 against brute force, with their defined edge cases."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from redline.llm import embed_dedup, merkle, trie
from redline.llm.queries import ORACLES, QUERIES


# ---------------------------------------------------------------- embedding near-duplicates

def _components(rows, threshold=0.98):
    """(id, links, smallest id, kept) by comparing all pairs; rows: (id, label, vector)."""
    n = len(rows)
    ok = [i for i, (_, l, v) in enumerate(rows)
          if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * n, list(range(n))
    for a in ok:
        for b in ok:
            (_, la, va), (_, lb, vb) = rows[a], rows[b]
            if a != b and la == lb and len(va) == len(vb):
                x, y = np.array(va) / np.abs(va).max(), np.array(vb) / np.abs(vb).max()
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[a] += 1
                    low, high = sorted((root[a], root[b]))
                    root = [low if r == high else r for r in root]
    low = {r: min((rows[i][0] for i in range(n) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    return [(rows[i][0], links[i], low[root[i]], rows[i][0] == low[root[i]]) for i in range(n)]


def _key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    rows = []
    for c in range(6):                                       # groups of copies, from pairs to a dense one
        centre = rng.normal(size=16)
        centre /= np.linalg.norm(centre)
        for _ in range((2, 3, 5, 20, 40, 70)[c]):
            noise = rng.normal(size=16)
            rows.append((len(rows), c % 2, (centre + rng.uniform(0.02, 0.16) * noise / np.linalg.norm(noise)).tolist()))
    for _ in range(150):
        rows.append((len(rows), int(rng.integers(0, 3)), rng.normal(size=16).tolist()))
    rows += [(7, 0, rows[0][2]), (900, 0, rows[0][2]), (None, 0, rows[0][2]), (901, 1, rows[0][2]), (902, None, rows[0][2]),
             (903, 0, None), (904, 0, []), (905, 0, [0.0] * 16), (906, 0, [None] + [1.0] * 15), (907, 0, [float("nan")] * 16),
             (908, 0, [float("inf")] + [1.0] * 15), (909, 0, [1.0]), (910, 0, [2.0]), (911, 0, [-2.0]),
             (912, 2, [1e200] * 16), (913, 2, [1e-200] * 16), (None, 2, [1.0, -1.0] * 8), (None, 2, None)]
    return rows


@pytest.mark.parametrize("settings", [{"window": 16, "block": 64, "small": 8, "tile": 8},
                                      {"window": 3, "block": 8, "small": 300, "batch": 1, "most": 1}])
def test_embed_dedup_matches_all_pairs(spark, vectors, settings):
    df = spark.createDataFrame([(*r, 1, 2) for r in vectors], "vec_id long, label int, embedding array<double>, node int, root int").repartition(3)
    got = sorted(map(tuple, embed_dedup.near_duplicates(df, **settings).collect()), key=_key)
    assert got == sorted(_components(vectors), key=_key)


def test_embed_dedup_single_precision(spark, vectors):
    df = spark.createDataFrame([r for r in vectors if r[0] is not None][:120], "vec_id long, label int, embedding array<float>")
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in df.collect()]
    assert sorted(map(tuple, embed_dedup.near_duplicates(df).collect())) == sorted(_components(rows))


def test_shared_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(-2**63, 2**63, 300)
    b = np.where(rng.random(300) < 0.2, a, a ^ (1 << rng.integers(0, 63, 300)))
    want = [next((i for i in range(64) if (int(x) ^ int(y)) >> (63 - i) & 1), 64) for x, y in zip(a, b, strict=True)]
    assert embed_dedup._shared_bits(a, b).tolist() == want


def test_embed_dedup_query_matches_sql(spark, vectors, tmp_path):
    rows = [r for r in vectors if r[2] is None or all(x is not None for x in r[2])]
    _same_as_sql(spark, tmp_path, "op11_embed_dedup", "embeddings", rows, "vec_id long, embedding array<double>, label int",
                 lambda r: (r[0], r[2], r[1]))


# ---------------------------------------------------------------- prefix trie

def _trie(rows):
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    seq = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    nodes, kids = {}, {}
    for c, s in seq.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    for s in nodes:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    leaves, saved, out = {}, {}, []
    for s in sorted(nodes, key=len, reverse=True):
        below = kids.get(s, [])
        leaves[s] = sum(leaves[k] for k in below) or 1
        saved[s] = sum(saved[k] for k in below) + ((len(nodes[s]) - 1) * len(s[-1][1].encode()) if s else 0)
        ends = ",".join(map(str, sorted(c for c in nodes[s] if len(seq[c]) == len(s))))
        out.append((min(nodes[s]), len(s), min(nodes[s[:-1]]) if s else None, len(nodes[s]), len(below), leaves[s], saved[s],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _talks():
    rng = np.random.default_rng(3)
    words = ["héllo", "", None, "yes", "no " * 9, "z"]
    rows = []
    for c in range(60):
        for t in range(int(rng.integers(1, 14))):
            text = "common opening" if t == 0 and c % 3 else words[int(rng.integers(0, 6))]
            rows.append((c, t, ("user", "assistant", None)[t % 2 if c % 7 else 2], text))
    rows += [(100 + i, t, "user", f"copy {t}") for i in range(12) for t in range(12)]         # copies
    rows += [(300, None, "user", "b"), (300, None, "user", "a"), (300, 1, "user", "a"), (300, 1, "user", "a"), (None, 0, "user", "lost"),
             (404, 0, "user", "x"), (2**40, 0, "user", "x")]
    return rows + [(500, t, "user", f"deep {t}") for t in range(40)] + [(505, t, "user", f"deep {t}") for t in range(39)] + [(505, 39, "user", "other")]


TURN = "conv_id long, turn long, role string, text string"


def _built(df):
    return sorted(map(tuple, trie.build(*trie.graft(*trie.numbered(df))).collect()), key=_key)


def test_trie_matches_brute_force(spark, monkeypatch):
    rows = _talks()
    df = spark.createDataFrame([(*r, 1) for r in rows], TURN + ", n int").repartition(4)
    want = sorted(_trie(rows), key=_key)
    assert _built(df) == want
    monkeypatch.setattr(trie, "STRETCH", 4)                  # sums over many stretches
    assert _built(df) == want


def test_trie_edges(spark):
    df = spark.createDataFrame([(2, 0, "user", "a")], TURN)
    assert _built(df.limit(0)) == []
    turnless = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    rows = [(turnless, 0, "user", "only")]
    assert _built(spark.createDataFrame(rows, TURN)) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]


def test_trie_query_matches_sql(spark, tmp_path):
    _same_as_sql(spark, tmp_path, "op12_prefix_trie", "conversations", _talks(), TURN, lambda r: r)


# ---------------------------------------------------------------- Merkle manifest

def _digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([_digest(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def _manifest(rows):
    def leaf(r):
        return _digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(by, key=lambda l: (l is not None, (l or "").encode()))
    trees = {l: (sorted(by[l], key=lambda x: x[:3]), _levels([x[2] for x in sorted(by[l], key=lambda x: x[:3])])) for l in names}
    top, out = _levels([trees[l][1][-1][0] for l in names]), []
    for a, l in enumerate(names):
        own, levels = trees[l]
        for i, (_, _, h, r) in enumerate(own):
            forged = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            got, found = leaf((*r[:3], r[3] + 1, r[4])) if forged else h, []
            for tree, at in ((levels, i), (top, a)):
                for level in tree[:-1]:
                    other = at ^ 1
                    if other < len(level):
                        found.append(level[other])
                        got = _digest(got, level[other]) if at % 2 == 0 else _digest(level[other], got)
                    else:
                        got = _digest(got)
                    at //= 2
            out.append((r[0], h, levels[-1][0], top[-1][0], _digest(*found), got, got == top[-1][0]))
    return out


DOC = "doc_id long, source string, lang string, n_chars long, text string"


def _documents():
    rng = np.random.default_rng(7)
    rows = [(int(i), f"s{i % 3}", ("en", "de", "fré", None, "")[int(rng.integers(0, 5)) if i % 2 else 0], int(i), "é" * int(i % 7)) for i in rng.permutation(300)]
    rows += [(5, "s", "en", 1, "same id"), (5, "s", "en", 1, "same row"), (5, "s", "en", 1, "same row"), (None, None, None, None, None),
             (None, "s", "en", None, ""), (7, "s", "lone", 2**63 - 1, "x"), (70, None, "en", None, None), (-14, "s", "en", -1, "y" * 30000)]
    return rows


@pytest.mark.parametrize("levels", [2, 10])
def test_merkle_query_matches_plain_python(spark, tmp_path, levels):
    spark.createDataFrame([(*r, "x") for r in _documents()], DOC + ", leaf string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["op13_merkle_manifest"](spark, str(tmp_path), levels).collect()), key=_key)
    assert got == sorted(_manifest(_documents()), key=_key)


def test_merkle_positions():
    for n in range(1, 70):
        log, seen = merkle.append_log([f"{i}" for i in range(n)], merkle.height(n)), set()
        for level, nodes in enumerate(_levels([f"{i}" for i in range(n)])):
            for j, h in enumerate(nodes):
                at = int(merkle.position(level, j, n))
                assert log[at] == h
                seen.add(at)
        assert seen == set(range(len(log)))


def test_merkle_edges(spark, tmp_path):
    df = spark.createDataFrame(_documents(), DOC)
    from pyspark.sql import functions as F
    none = merkle.build(df.limit(0), F.col("lang"), F.col("doc_id"), merkle.hash_leaf([F.col("text")]))
    assert none.root is None and none.leaves.count() == 0 and none.log.count() == 0
    one = merkle.build(df.filter("lang = 'lone'"), F.col("lang"), F.col("doc_id"), merkle.hash_leaf([F.col("text")]))
    assert one.root == _digest("1:x")
    merkle.save(one, str(tmp_path / "log"))
    assert merkle.load_log(spark, str(tmp_path / "log")).count() == one.log.count() == 2
    astray = one.leaves.select("tree", (F.col("idx") + 5000).alias("idx"), F.col("leaf").alias("claim"))
    with pytest.raises(Exception, match="no leaves"):
        merkle.prove(one, astray).collect()


def test_merkle_query_matches_sql(spark, tmp_path):
    rows = [r for r in _documents() if r[3] is None or r[3] < 2**62]
    _same_as_sql(spark, tmp_path, "op13_merkle_manifest", "documents", rows, DOC, lambda r: r)


def _same_as_sql(spark, tmp_path, query, table, rows, schema, shape):
    for name, part in (("some", rows), ("none", [])):
        spark.createDataFrame([shape(r) for r in part], schema).write.parquet(str(tmp_path / name / f"{table}.parquet"))
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{name}/{table}.parquet/*.parquet')")
        want = duck.execute(ORACLES[query])
        columns = [c[0] for c in want.description]
        got = QUERIES[query](spark, str(tmp_path / name)).select(*columns).collect()
        assert sorted(map(tuple, got), key=_key) == sorted(want.fetchall(), key=_key)
