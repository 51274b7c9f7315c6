"""The registered queries' own columns, and the pipeline's rows, against plain Python."""

from __future__ import annotations

import hashlib
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_llm import _brute_removed, _fp

import corpus_pipeline
from redline.llm import bpe, decontaminate, quality, urls
from redline.llm.common import read
from redline.llm.queries import QUERIES, URL_RULES, byte_bpe_path

RNG = np.random.default_rng(21)
WORDS = ["".join(RNG.choice(list("abcdefghilmnorstuvé"), RNG.integers(3, 9))) for _ in range(1500)]
PASSAGE = " ".join(WORDS[i] for i in range(70))
ITEMS = [" ".join(RNG.choice(WORDS, n)) for n in (16, 9, 5)]


def _prose(n=60):
    return " ".join(RNG.choice(WORDS, n))


def _rows():
    good = [_prose() for _ in range(220)]
    toxic = [" ".join([*_prose(30).split(), *RNG.choice(["vilewretch", "nastyscum"], 4), *_prose(25).split()]) for _ in range(60)]
    poor = [" ".join(w.upper() + "!!" for w in _prose(40).split()) for _ in range(60)]
    texts = [(t, 2) for t in good] + [(t, 0) for t in toxic] + [(t, 1) for t in poor]
    texts = [texts[i] for i in RNG.permutation(len(texts))]
    plain = [t for t, g in texts if g == 2]
    planted = [plain[0], plain[0], plain[1], plain[1].upper().lower() + " ",                      # copies
               _prose(30) + " " + PASSAGE, PASSAGE + " " + _prose(30), _prose(5) + "é " + PASSAGE + "ñ " + _prose(25),
               _prose(40) + " " + ITEMS[0], _prose(20) + " " + ITEMS[1].replace("a", "o", 1) + ". " + _prose(20),
               _prose(25) + "\n" + ITEMS[2].upper().lower() + " " + _prose(25), None, "", "x" * 300, "x" * 120]
    docs = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate([t for t, _ in texts] + planted)]
    return docs, [(i, int(g == 2), int(g == 0)) for i, (_, g) in enumerate(texts)]


DOCS, LABELS = _rows()
HOLDS_ITEM = {len(LABELS) + 7, len(LABELS) + 8, len(LABELS) + 9}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    tables = {
        "documents": (DOCS, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": (LABELS, "doc_id long, quality int, toxic int"),
        "benchmark": (list(enumerate(ITEMS)), "item_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(path / f"{name}.parquet"))
    return str(path)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_op2_columns(spark, folder):
    rows = [(i, (t or "").encode()) for i, t, *_ in DOCS]
    kept = {i: k for i, _, k in _brute_removed(rows, 100)}
    got = {r["doc_id"]: r for r in QUERIES["op2_suffix_dedup"](spark, folder).withColumnRenamed("doc", "doc_id").collect()}
    assert set(got) == set(kept)
    for i, raw in rows:
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(raw), len(raw) - len(kept[i]), _sha(kept[i]))
        assert (r["n_spans"] == 0) == (r["n_removed"] == 0)
    spans = {i: got[i]["n_spans"] for i in range(len(LABELS), len(DOCS))}
    assert spans[len(LABELS) + 5] == 1 and spans[len(LABELS) + 12] == 1 and spans[len(LABELS) + 4] == 0


def test_op3_columns(spark, folder):
    got = {r["doc_id"]: r for r in QUERIES["op3_sharding"](spark, folder).collect()}
    load, slots = Counter(), defaultdict(list)
    for i, t, *_ in DOCS:
        raw, r = (t or "").encode(), got[i]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(load) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_op4_columns(spark, folder):
    got = {r["doc_id"]: r for r in QUERIES["op4_quality"](spark, folder).collect()}
    assert set(got) == {d[0] for d in DOCS}
    model = quality.fit(read(spark, folder, "documents"), read(spark, folder, "labels"))
    grade, tail = quality._judged(model, [d[1] for d in DOCS], quality.Hasher())
    for (i, *_), g, p in zip(DOCS, grade, tail, strict=True):
        assert (got[i]["expected_grade"], got[i]["p_tail"], got[i]["keep"]) == (pytest.approx(g), pytest.approx(p), p >= 0.5)
    assert all(got[i]["keep"] == bool(q) for i, q, _ in LABELS)


def test_op7_columns(spark, folder):
    got = Counter((r["doc_id"], r["item_id"], r["distance"]) for r in QUERIES["op7_decontaminate"](spark, folder).collect())
    want = Counter()
    for i, t, *_ in DOCS:
        for j, item in enumerate(map(decontaminate.normalise, ITEMS)):
            d = decontaminate.myers(item, decontaminate.normalise(t))[0]
            if d <= len(item) // 20:
                want[i, j, d] += 1
    assert got == want and {i for i, _, _ in want} == HOLDS_ITEM


def _digests(tok, text):
    ids = tok.encode(text, add_special_tokens=False).ids
    return len(ids), _sha(np.array(ids, "<u4").tobytes()), _sha(tok.decode(ids, skip_special_tokens=False).encode())


def test_op10_columns(spark, folder):
    tok = bpe.tokenizer(byte_bpe_path())
    got = QUERIES["op10_bpe"](spark, folder).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *_digests(tok, t or "")) for i, t, *_ in DOCS)


def test_op9_columns(spark, tmp_path):
    rng = np.random.default_rng(3)
    hosts = ["example.net", "A.Example.net", "b.net", "example.com", "x.example.com", "notexample.com", "org", "a.b.org", "free-bets.example.io",
             "plain.example.io", "c.spam.dev", "", ".".join(f"l{i}" for i in range(20_000)) + ".net"]
    paths = ["", "/", "/en/x", "/de/1", "/fr/?a=1", "/de", "?q=/en/", "#/fr/", "/en/://x"]
    rows = [(i, f"http{'s' * (i % 2)}://{rng.choice(hosts[:-1])}{rng.choice(paths)}", "h") for i in range(300)]
    rows += [(300, None, None), (301, "no scheme", ""), (302, "://", ""), (303, f"http://{hosts[-1]}/a", ""), (303, f"http://{hosts[-1]}/a", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    began = time.time()
    got = QUERIES["op9_url_filter"](spark, str(tmp_path)).collect()
    assert time.time() - began < 60                                    # the host of 20,000 labels took 93 s alone
    want = []
    for i, u, _ in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, a) for h, p, a in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((i, host, path, *(max(fits)[1:] if fits else (None, None))))
    assert sorted(Counter((r["page_id"], r["host"], r["path"], r["rule"] or "") for r in got).items()) == sorted(
        Counter((i, h, p, r or "") for i, h, p, r, _ in want).items())
    action = {(i, r): a for i, _, _, r, a in want}
    for r in got:
        rule = action[r["page_id"], r["rule"]]
        assert r["verdict"] == (rule or ("block" if r["p_block"] >= 0.5 else "allow"))


def test_equally_long_rules(spark):
    rules = [("net", "/en/", "allow"), ("x.net", "/e", "allow"), ("y.net", "/e", "block"), (None, "/", "block")]
    df = spark.createDataFrame([(1, "http://x.net/en/"), (2, "http://y.net/en/"), (3, "http://z.net/en/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(
        df, spark.createDataFrame(rules, "host string, path string, action string"), urls.UrlModel(None, None, 1.0)).collect()}
    assert len("net/en/") == len("x.net/e")
    assert got == {1: ("x.net/e", "allow"), 2: ("y.net/e", "block"), 3: ("net/en/", "allow")}


def _groups(texts):
    """The first text of each group linked by at most two differing bits."""
    prints, label = [_fp(t) for t in texts], list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(a):
                if label[a] != label[b] and (prints[a] ^ prints[b]).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return [i for i in range(len(texts)) if label[i] == i]


def test_pipeline_rows(spark, folder):
    """``run`` against its five stages in plain Python; only the fitted weights are taken over."""
    model = quality.fit(read(spark, folder, "documents"), read(spark, folder, "labels"))
    _, tail = quality._judged(model, [d[1] for d in DOCS], quality.Hasher())
    docs = [(i, t) for (i, t, *_), p in zip(DOCS, tail, strict=True) if p >= 0.5]
    docs = [docs[i] for i in _groups([t or "" for _, t in docs])]
    docs = [(i, k.decode(errors="ignore")) for i, _, k in _brute_removed([(i, (t or "").encode()) for i, t in docs], 100)]
    items = [decontaminate.normalise(t) for t in ITEMS]
    free = [(i, t) for i, t in docs if all(decontaminate.myers(x, decontaminate.normalise(t))[0] > len(x) // 20 for x in items)]
    tok = bpe.tokenizer(byte_bpe_path())
    got = corpus_pipeline.run(spark, folder)
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, *_digests(tok, t)) for i, t in free)
    left = {i for i, _ in free}
    assert not left & HOLDS_ITEM and not left & {i for i, q, _ in LABELS if not q}
    assert {i for i, q, _ in LABELS if q} <= left                       # clean documents stay
    assert not left & {len(LABELS), len(LABELS) + 1, len(LABELS) + 2}   # copies of earlier ones
