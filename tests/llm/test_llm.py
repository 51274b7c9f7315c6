"""The training-data operators against brute force, and their defined edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from redline.llm import ann, bpe, chat, decontaminate, quality, repair, sharding, simhash, substring_dedup, urls
from redline.llm.queries import ORACLES, QUERIES, byte_bpe_path

P = "x" * 5
LONG = " ".join(f"word{i % 97} thing{i % 89}" for i in range(4000))
PASSAGE = " ".join(f"common{i}" for i in range(60))
ROWS = [
    (1, "a " + PASSAGE + " tail one", "s"), (2, None, "s"), (3, "", "s"), (4, "b " + PASSAGE + " other end", None),
    (5, "aé" * 90, "s"), (6, "aé" * 90, "s"), (6, "aé" * 90, "s"), (7, LONG, "s"), (8, LONG + " more", "s"),
    (None, "lonely row with ordinary words", "s"), (9, "  odd \t\n blanks  \u00a0 x<|endoftext|>y don't", "s"),
    (9, "same id, other text", "s"), (10, "zzzz " * 100, "s"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, start string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def _texts():
    return [(d, t or "") for d, t, _ in ROWS]


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "", None, "<|turn|>user\nx<|end|>", "<\\s> <\\\\|end|> [\\/INST]", "[\\", "é" * 50]
    rows = [(c, i % 4, r, t, 1) for c in (1, None) for i, t in enumerate(texts) for r in ("user", "assistant", None, "a\\n\nb<s>")]
    rows += rows[:3]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    want = defaultdict(list)
    for c, i, r, t, _ in rows:
        want[c].append((i, r or "", t or ""))
    assert set(got) == set(want)
    for c, own in want.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_chat_query_matches_sql(spark, tmp_path):
    texts = ["a</s>b", "<|turn|>x<|end|>", "<\\\\|end|> [\\/INST]", None, "", "é[INST]"]
    rows = [(c, i, r, t) for c in (1, 2) for i, t in enumerate(texts) for r in ("user", "assistant", "a\\n\nb<s>")]
    for name, frame in (("small", spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")),
                        ("none", spark.createDataFrame([], "conv_id long, turn long, role string, text string"))):
        frame.write.parquet(str(tmp_path / name / "conversations.parquet"))
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/{name}/conversations.parquet/*.parquet')")
        want = duck.execute(ORACLES["op1_chat_format"])
        columns = [c[0] for c in want.description]
        got = QUERIES["op1_chat_format"](spark, str(tmp_path / name)).select(*columns).collect()
        assert sorted(map(tuple, got)) == sorted(want.fetchall())


def _brute_removed(rows, length):
    seen, out = set(), []
    for i, raw in rows:
        cover = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p:p + length]
            if s in seen:
                cover[p:p + length] = b"\1" * length
            seen.add(s)
        out.append((i, len(raw), bytes(b for b, c in zip(raw, cover, strict=True) if not c)))
    return out


def test_substring_dedup_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcé"), 5)) for _ in range(40)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(6)]
    rows = [(i, " ".join([base[i % 6][:rng.integers(50, 300)], *rng.choice(words, 30), base[(i * 5) % 6][rng.integers(0, 80):]]), "x")
            for i in range(60)] + [(90, "q" * 1000, "x"), (91, "q" * 150, "x"), (92, None, "x"), (93, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string").repartition(5)
    got = {r["doc_id"]: r for r in substring_dedup.removals(docs).collect()}
    for i, n, kept in _brute_removed([(i, (t or "").encode()) for i, t, _ in rows], 100):
        raw, at, out = (got[i]["text"] or "").encode(), 0, b""
        for r in got[i]["removed"]:
            out, at = out + raw[at:r["lo"]], r["hi"]
        assert (len(raw), out + raw[at:]) == (n, kept)
    clean = substring_dedup.deduplicate(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert {r["doc_id"]: r["text"] for r in clean.collect()}[92] is None


def test_substring_dedup_rows_without_id(spark):
    """Texts whose hashes agree in their low bits are documents of their own."""
    hash_of = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))
    shared = "".join(f"{i:03d}" for i in range(40))
    texts = [f"{shared} tail {i}" for i in range(1000)] + ["".join(f"{i}-{j} " for j in range(20)) for i in range(1000)]
    by_low = defaultdict(list)
    for t in texts:
        by_low[hash_of(t) % (1 << 15)].append(t)
    assert sum(len({t.startswith(shared) for t in v}) > 1 for v in by_low.values()) > 10
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(5)
    want = _brute_removed([(t, t.encode()) for t in sorted(texts, key=hash_of)], 100)
    assert sorted(r["text"] for r in substring_dedup.deduplicate(docs).collect()) == sorted(k.decode() for _, _, k in want)
    cut = {r["text"]: sum(x["hi"] - x["lo"] for x in r["removed"]) for r in substring_dedup.removals(docs).collect()}
    assert cut == {t: n - len(k) for t, n, k in want}
    # equal strings at the same place of two such rows are still a repeat
    low = {}
    pair = next((t, low[k]) for t in (f"{shared} end {i}" for i in range(10000)) if (k := hash_of(t) % (1 << 15)) in low or low.update({k: t}))
    two = spark.createDataFrame([(None, t) for t in pair], "doc_id long, text string")
    assert sorted(len(r["removed"]) for r in substring_dedup.removals(two).collect()) == [0, 1]


def test_substring_dedup_edges(docs, empty):
    out = {(r["doc_id"], r["text"]): len(r["removed"]) for r in substring_dedup.removals(docs).collect()}
    assert out[(4, ROWS[3][1])] == 1 and out[(1, ROWS[0][1])] == 0
    assert out[(6, "aé" * 90)] >= 1                       # a copy of document 5
    assert substring_dedup.removals(empty).count() == 0
    assert substring_dedup.kept_text("aéb".encode(), [(2, 3)]) == "ab"


def _fp(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


def test_simhash_components(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    want = [(i, _fp(t)) for i, t in _texts()]
    label = list(range(len(want)))
    for _ in want:
        for a in range(len(want)):
            for b in range(len(want)):
                if (want[a][1] ^ want[b][1]).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    low = {c: min((want[i][0] for i in range(len(want)) if label[i] == c and want[i][0] is not None), default=None) for c in label}
    assert sorted((r["id"] or -1, r["fp"] % 2**64, r["component_id"] or -1) for r in got) == sorted(
        (i or -1, f, low[label[n]] or -1) for n, (i, f) in enumerate(want))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))


def test_bit_sliced_links_with_crowded_buckets(spark):
    rng = np.random.default_rng(1)
    values = {int(rng.integers(0, 2**63)) for _ in range(30)}
    values |= {v ^ (1 << int(b)) for v in list(values) for b in rng.integers(0, 64, 12)}
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    for hot in (3, 4096):
        tree = {r["node"]: r["root"] for r in simhash.connected_components(simhash.near_links(df, 2, hot), "t").collect()}
        signed = [r["fp"] for r in df.collect()]
        for a in signed:
            for b in signed:
                if ((a ^ b) % 2**64).bit_count() <= 2:
                    assert tree.get(a, a) == tree.get(b, b)
        assert len({tree.get(a, a) for a in signed}) == 30


def test_sharding(spark, docs, empty):
    rows = sharding.records(docs).cache()
    first = sharding.first_map(sharding.slot_bytes(rows), 4).cache()
    out = sharding.place(rows, first).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in _texts())
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    many = spark.range(3000).selectExpr("id doc_id", "repeat('a', cast(id % 50 as int)) text")
    sizes = sharding.slot_bytes(sharding.records(many)).cache()
    one = sharding.first_map(sizes, 16).cache()
    load = [r[0] for r in one.groupBy("shard").sum("bytes").select("sum(bytes)").collect()]
    assert len(load) == 16 and max(load) - min(load) <= 60
    two = sharding.rebalance(one, sizes, 17)
    load = [r[0] for r in two.groupBy("shard").sum("bytes").select("sum(bytes)").collect()]
    assert len(load) == 17 and max(load) - min(load) <= 200 and two.first()["version"] == 2
    assert one.count() == two.count() == sharding.SLOTS      # empty slots too
    assert sharding.place(sharding.records(empty), sharding.first_map(sharding.slot_bytes(sharding.records(empty)), 4)).count() == 0


def test_sharding_through_stored_versions(spark, tmp_path):
    """Records that come after the map was made are placed, through any of its versions."""
    docs = spark.range(1000).selectExpr("id doc_id", "repeat('ab', cast(id % 90 as int)) text")
    rows, path = sharding.records(docs).cache(), str(tmp_path / "map")
    early = sharding.slot_bytes(rows.filter("doc_id < 100"))
    sharding.save_map(sharding.first_map(early, 4), path)
    sharding.save_map(sharding.rebalance(sharding.load_map(spark, path), sharding.slot_bytes(rows), 5), path)
    assert sharding.load_map(spark, path).first()["version"] == 2
    for version, shards in ((1, 4), (2, 5), (None, 5)):
        stored = sharding.load_map(spark, path, version)
        out = sharding.place(rows, stored).collect()
        assert stored.count() == sharding.SLOTS and len(out) == 1000 and {r["shard"] for r in out} == set(range(shards))
    moved = sharding.load_map(spark, path, 1).join(sharding.load_map(spark, path, 2), "vslot").count()
    assert moved == sharding.SLOTS
    with pytest.raises(Exception, match="no shard for slot"):
        sharding.place(rows, sharding.load_map(spark, path).filter("vslot < 4")).collect()


def test_clashing_columns_stay(spark):
    """Columns named like those an operator adds keep their values."""
    names = ["best_id", "BEST_HASH", "Text_Hash", "copy", "_copy", "doc_key", "cuts", "doc", "hash", "spans", "fp", "root", "id"]
    rows = [(i, f"{PASSAGE} {i % 2} end", *[f"{n}{i}" for n in names]) for i in range(4)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and {tuple(r) for r in kept.collect()} <= set(rows) and kept.count() == 2
    clean = substring_dedup.deduplicate(df)
    assert clean.columns == df.columns
    assert sorted((r[0], *r[2:]) for r in clean.collect()) == [(r[0], *r[2:]) for r in rows]


def test_quality_held_out():
    rng = np.random.default_rng(0)
    plain = [f"w{i}" for i in range(300)]
    hasher = quality.Hasher()

    def make(grade):
        words = list(rng.choice(plain, 80))
        if grade == 0:
            words[5] = rng.choice(["vile", "nasty"])
        if grade == 1:
            words = [w.upper() + "!!" for w in words]
        return grade, " ".join(words)
    rows = [make(int(g)) for g in rng.choice(3, 900, p=[0.2, 0.2, 0.6])]
    model = quality.train([(g, *hasher.features(t)) for g, t in rows[:600]])
    assert model.cuts[0] < model.cuts[1]
    grade, tail = quality._judged(model, [t for _, t in rows[600:]], hasher)
    truth = np.array([g for g, _ in rows[600:]])
    assert ((tail >= 0.5) == (truth == 2)).mean() > 0.9
    assert grade[truth == 0].mean() < grade[truth == 1].mean() < grade[truth == 2].mean()


def test_quality_reads_words_to_their_end():
    """Texts without blanks that differ only past their first characters."""
    rng = np.random.default_rng(6)

    def make(grade):
        return "a" * 70 + "".join(rng.choice(list("bcdef"), 40)) + "".join(rng.choice(list("XYZ" if grade == 2 else "123"), 30))
    hasher = quality.Hasher()
    rows = [(g, make(g)) for g in (1, 2) * 150]
    model = quality.train([(g, *hasher.features(t)) for g, t in rows[:200]])
    _, tail = quality._judged(model, [t for _, t in rows[200:]], hasher)
    assert ((tail >= 0.5) == (np.array([g for g, _ in rows[200:]]) == 2)).all()
    assert not hasher.known and not hasher.shapes           # long words are not remembered
    slots, _ = hasher.features("aB9" * 50 + "!!")
    assert quality._slot("s", "aA0" * 50 + "!") in slots


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).filter("keep").count() == len(ROWS)
    assert quality.select(docs, model).columns == docs.columns
    assert quality.score(empty, quality.fit(empty, labels.limit(0))).count() == 0


def test_repair_files(spark, docs, empty, tmp_path):
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = bpe.tokenizer(path)
    repair.write(docs, str(tmp_path / "a"), path)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in repair.read_documents(spark, str(tmp_path / "a"), path).collect())
    start, want = 0, []
    for i, t in sorted(_texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    repair.write(empty, str(tmp_path / "b"), path)
    assert repair.read_documents(spark, str(tmp_path / "b"), path).count() == 0


def test_repair_grammar_random_access():
    rng = np.random.default_rng(4)
    ids = np.concatenate([np.zeros(50, np.int64), rng.integers(0, 6, 3000), np.tile([1, 2, 3], 200)])
    count = np.array([50, 1, 0, 2999, 600])
    s, symbols, left, right = repair.compress(ids, count, 100, rounds=5, rules=8, least=4)
    assert len(s) < len(ids) / 2 and symbols.sum() == len(s)
    assert (repair.expand(s, left, right, 100) == ids).all()
    payload = bpe._join(np.arange(5, dtype="<i8").tobytes(), *(bpe._planes(x) for x in (symbols, count, left, right, repair.lengths(left, right, 100), s)))
    block, at = repair.Block(payload, 100), np.r_[0, np.cumsum(count)]
    for i in range(5):
        assert (block.document(i) == ids[at[i]:at[i + 1]]).all()
    assert (block.whole() == ids).all()
    assert (block.tokens(3, 700, 790) == ids[51 + 700:51 + 790]).all()


def test_repair_word_table(monkeypatch):
    """Strings are told apart although their hashes agree."""
    import pyarrow as pa
    words = ["", "a", "b", "ab", "ba", "aé", "éa", "a" * 70000, *(f"w{i}" for i in range(500))]
    assert len(set(repair.string_hashes(pa.array(words)).tolist())) == len(words)
    for weak in (False, True):
        if weak:
            monkeypatch.setattr(repair, "string_hashes", lambda a: np.array([len(x) % 3 for x in a.to_pylist()], np.uint64))
        table = repair._Table()

        def learn(new, table=table):
            table.add(new, np.array([words.index(x) for x in new.to_pylist()], np.int32), np.ones(len(new), np.int64))
        for part in (words[:9], words[4:200], words[::-1]):
            ids, size = table.of(table.numbers(pa.array(part), learn))
            assert ids.tolist() == [words.index(x) for x in part] and (size == 1).all()


def test_repair_leaves_no_frequent_pair():
    rng = np.random.default_rng(5)
    words = [rng.integers(0, 90, 64) for _ in range(12)]
    ids = np.concatenate([words[i] for i in rng.integers(0, 12, 600)])
    count = np.array([20000, len(ids) - 20000])
    s, symbols, left, right = repair.compress(ids, count, 100)
    assert (repair.expand(s, left, right, 100) == ids).all() and repair.lengths(left, right, 100).max() > 16
    pairs = Counter(p for part in np.split(s, [symbols[0]]) for p in zip(part[:-1].tolist(), part[1:].tolist(), strict=True))
    assert max(pairs.values()) < repair.MIN_COUNT


def test_ann_recall_and_edges(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(20, 16))
    v = centre[rng.integers(0, 20, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    v[100:400] = v[0]                                       # a large group of equal vectors
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(2000, None, 1), (2050, [0.0] * 16, 1), (2100, [float("nan")] + [1.0] * 15, 1),
                                                           (2150, [None] + [1.0] * 15, 1), (2200, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in ann.nearest(df, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 50))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q, near in got.items():
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        true = np.lexsort((np.arange(1500), -s))[:5].tolist()
        hits += len(set(true) & {i for i, _ in near})
        assert len(near) == 5 and np.allclose([x for _, x in near], [unit[i] @ unit[q] for i, _ in near])
    assert hits >= 0.9 * 5 * len(got)
    assert ann.nearest(df.limit(0), lambda i: i % 50 == 0).count() == 0
    assert ann.nearest(df.filter("vec_id in (0, 1, 2)"), lambda i: i % 50 == 0).count() == 2


def test_ann_repeated_ids_and_lengths(spark):
    """Each row is a query and a candidate of its own; each length is searched by itself."""
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in rng.normal(size=d)]) for d, n in ((8, 60), (3, 12), (1, 1)) for i in rng.integers(0, 120, n)]
    rows += [(50, [1.0, 2.0, 3.0]), (50, [1.0, 2.0, 3.0]), (50, [2.0, 4.0, 6.0]), (100, [5.0] * 8), (100, [4.0, 5.0] * 4), (0, [1.0]), (150, [0.5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    want = []
    for i, (q, a) in enumerate(rows):
        if q % 50 == 0:
            near = sorted((-round(cos(a, b), 9), c) for j, (c, b) in enumerate(rows) if j != i and len(a) == len(b))
            want += [(q, n, -s) for n, (s, _) in enumerate(near[:5], 1)]
    got = ann.nearest(df, lambda i: i % 50 == 0, target=1.0).collect()
    assert sorted((r["query_id"], r["rank"], round(r["score"], 9)) for r in got) == sorted(want)
    assert sum(r["query_id"] == r["vec_id"] == 50 for r in got) >= 6      # the other rows of the id
    assert not any(r["query_id"] == 150 for r in got)                     # no other vector of its length


def _distance(a, b):
    """Best edit distance of ``a`` to any stretch of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination(spark, docs, empty):
    item = "the quick brown fox jumps over the lazy dog while forty two sleepy cats watch from a wall"
    bad = [item, item.replace("quick", "qick").replace("wall", "walls"), item[:30] + "XY" + item[32:60] + item[63:], item[:50], "nothing"]
    rows = [(i, f"before {t.upper() if i == 0 else t}\n after", "x") for i, t in enumerate(bad)] + [(8, None, "x"), (9, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, item)], "item_id long, text string")
    k = decontaminate.budget(len(item))
    want = {i: _distance(item, decontaminate.normalise(t)) for i, t, _ in rows}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.matches(df, items).collect()}
    assert got == {(i, j): d for i, d in want.items() if d <= k for j in (1, 4)}
    clean = decontaminate.clean(df, items)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == {i for i, d in want.items() if d > k}
    assert decontaminate.matches(empty, items).count() == 0 and decontaminate.matches(docs, items.limit(0)).count() == 0
    for a, b in (("kitten", "xxsittingxx"), ("abc", ""), ("aaaa", "aabaa")):
        assert decontaminate.myers(a, b)[0] == _distance(a, b)


def _edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = int(rng.integers(0, len(out)))
        kind = rng.integers(0, 3)
        if kind == 0:
            out[at] = "#"
        elif kind == 1:
            out.insert(at, "#")
        elif len(out) > 1:
            del out[at]
    return "".join(out)


def test_decontamination_short_items_have_their_whole_budget(spark):
    """Items of 1 to 130 characters with up to k + 2 edits, against plain edit distance."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdeéñ"), rng.integers(2, 8))) for _ in range(60)]
    sizes = [1, 2, 5, 9, 12, 19, *range(20, 84, 3), 100, 130]
    items = [(i, " ".join(rng.choice(words, 40))[:n].strip()) for i, n in enumerate(sizes)]
    docs = []
    for i, text in items:
        k = decontaminate.budget(len(text))
        assert k == len(text) // 20
        for edits in range(k + 3):
            before, after = " ".join(rng.choice(words, 8)), " ".join(rng.choice(words, 8))
            docs.append((len(docs), f"{before} ({_edited(rng, text, edits)}) {after}", i))
    docs += [(len(docs) + j, t, -1) for j, t in enumerate([None, "", " \n ", items[3][1] + "x", "y" + items[3][1], items[-1][1]])]
    df = spark.createDataFrame(docs, "doc_id long, text string, row long").repartition(4)
    known = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["start"], r["end"]) for r in decontaminate.matches(df, known).collect()}
    want = {}
    for d, text, _ in docs:
        norm = decontaminate.normalise(text)
        for i, raw in items:
            item = decontaminate.normalise(raw)
            k = len(item) // 20
            if k == 0:
                if re.search(rf"(?<![^\W_]){re.escape(item)}(?![^\W_])", norm):
                    want[d, i] = 0
            elif (distance := _distance(item, norm)) <= k:
                want[d, i] = distance
    assert {key: v[0] for key, v in got.items()} == want and len(want) > len(items)
    for (d, i), (distance, a, z) in got.items():
        assert _distance(items[i][1], decontaminate.normalise(docs[d][1])[a:z]) == distance
    clean = decontaminate.clean(df, known)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _, _ in docs} - {d for d, _ in want}


def test_decontamination_grams():
    rng = np.random.default_rng(12)
    text = "".join(rng.choice(list("abé"), 400))
    for size in decontaminate.SIZES:
        h = decontaminate.grams(decontaminate._codes(text), size)
        by = defaultdict(set)
        for i, g in enumerate(h.tolist()):
            by[text[i:i + size]].add(g)
        assert len(h) == 401 - size and all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)
        assert len(decontaminate.grams(decontaminate._codes("ab"), size)) == max(0, 3 - size)


def test_decontamination_plan_does_not_grow_with_the_items(spark, docs):
    few = spark.range(3).selectExpr("id item_id", "concat('item number ', sha2(cast(id as string), 256)) text")
    many = spark.range(3000).selectExpr("id item_id", "concat('item number ', sha2(cast(id as string), 256)) text")
    nodes = [decontaminate.matches(docs, t)._jdf.queryExecution().analyzed().toString().count("MapInArrow") for t in (few, many)]
    assert nodes[0] == nodes[1] <= 4


def test_url_rules(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block")],
                                  "host string, path string, action string")
    pages = [(1, "http://A.Example.NET/en/x?q"), (2, "https://b.net/"), (3, "http://example.com/de/1"), (4, "http://notexample.com/de/1"),
             (5, None), (6, "no scheme"), (7, "x://u.example.net/fr/"), (7, "x://u.example.net/fr/"), (8, "http://h.net?x://y")]
    df = spark.createDataFrame([(*p, "h") for p in pages], "page_id long, url string, rule string")
    out = urls.judge(df, rules, urls.UrlModel(None, None, 0.0)).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert len(out) == len(pages)
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2] is None and got[5] == ("", "", None, "allow")
    assert got[6][:2] == ("", "") and got[7][2] == "net/" and got[8] == ("h.net", "", None, "allow")
    assert urls.judge(df.limit(0), rules, urls.UrlModel(None, None, 0.0)).count() == 0


def test_url_suffix_rates_count_all_labels(spark):
    """The sample bounds the trees' rows only."""
    rows = [(f"http://h{i}.{'com' if i % 10 else f'rare{i % 7}'}/p/{i}?a={i % 5}", float(i % 3 == 0)) for i in range(700)]
    known = urls.parts(spark.createDataFrame(rows + rows[:50], "url string, label double"))
    model = urls.fit(known, max_train=40, trees=2)
    prior = sum(b for _, b in rows) / len(rows)
    by = defaultdict(list)
    for u, b in rows:
        by[u.split("/")[2].rsplit(".", 1)[1]].append(b)
    assert model.prior == prior and len(by) == 8
    got = {r["suffix"]: r["rate"] for r in model.rates.collect()}
    assert got == pytest.approx({k: (sum(v) + 20 * prior) / (len(v) + 20) for k, v in by.items()})
    assert urls.fit(known.limit(0)).prior == 0


def test_url_trees_held_out(spark):
    rng = np.random.default_rng(8)

    def make(i):
        bad = i % 4 == 0
        return f"http://h{i}.example.com/" + "/".join("".join(rng.choice(list("0123456789" if bad else "abcdefgh"), 6)) for _ in range(3)), float(bad)
    rows = [make(i) for i in range(600)]
    known = urls.parts(spark.createDataFrame(rows, "url string, label double"))
    held = {u for u, _ in rows[400:]}
    model = urls.fit(known.filter(~known.url.isin(*held)), trees=3)
    got = {r["url"]: r["p_block"] for r in model.score(known.filter(known.url.isin(*held))).collect()}
    assert np.mean([(got[u] >= 0.5) == b for u, b in rows[400:]]) > 0.95
    words = urls.parts(spark.createDataFrame([("http://spam-x.com/",), ("http://spammer.com/",), (None,)], "url string"))
    assert {r["host"]: r["label"] for r in urls.seed_labels(words).collect()} == {"spam-x.com": 1, "spammer.com": 0}
    with pytest.warns(UserWarning, match="no trees fitted"):
        assert urls.fit(known.filter("label = 0")).trees is None


def test_bpe_matches_library(docs, empty):
    path = byte_bpe_path()
    tok = bpe.tokenizer(path)
    out = bpe.decode(bpe.encode(docs, path, chunk_bytes=1 << 12, buckets=7), path).collect()
    want = Counter((i, tuple(tok.encode(t, add_special_tokens=False).ids)) for i, t in _texts())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out) == want
    assert all(r["text"] == tok.decode(r["ids"], skip_special_tokens=False) for r in out)
    assert bpe.encode(empty, path).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    rows = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert rows and not re.search("__", "".join(rows[0].asDict()))
