"""Frequent words get their ids where they lie; only the others are rows of a join."""

from pyspark.sql import functions as F

from redline.operators import encode


def _stored(monkeypatch):
    tables, real = {}, encode.cut_lineage

    def cut(df, name="table", **more):
        tables[name] = real(df, name, **more)
        return tables[name]
    monkeypatch.setattr(encode, "cut_lineage", cut)
    return tables


def test_only_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(encode, "COMMON", 2)
    tables = _stored(monkeypatch)
    rows = [(1, ["a", "b", "c", "a"], ["b", "d"]), (2, [], ["a"]), (3, ["q", "c"], []), (4, None, ["a"]), (5, ["a", None, "c"], ["b"])]
    df = spark.createDataFrame(rows, "pair_id long, s array<string>, t array<string>")
    v = spark.createDataFrame([("a", 4, 9), ("b", 5, 7), ("c", 6, 3), ("d", 7, 1)], "token string, token_id int, freq long")
    got = {r.pair_id: (r.si, r.ti) for r in encode.token_ids(df, v, {"s": "si", "t": "ti"}).collect()}
    assert got == {1: ([4, 5, 6, 4], [5, 7]), 2: ([], [4]), 3: ([encode.UNK_ID, 6], []), 4: ([], []), 5: ([4, 6], [5])}
    rare = [w for r in tables["common-ids"].collect() for w in r.rare or []]
    assert sorted(rare) == ["c", "c", "c", "d", "q"]


def test_rows_of_a_repeated_key_are_one(spark, monkeypatch):
    monkeypatch.setattr(encode, "COMMON", 1)
    rows = [(1, ["b", "c"], ["c"]), (1, ["a", "a", "c"], []), (2, ["c"], ["a"]), (None, ["a"], ["b"]), (None, ["b"], ["a"])]
    df = spark.createDataFrame(rows, "pair_id long, s array<string>, t array<string>")
    v = spark.createDataFrame([("a", 4, 9), ("b", 5, 7), ("c", 6, 3)], "token string, token_id int, freq long")
    got = {r.pair_id: (r.si, r.ti) for r in encode.token_ids(df, v, {"s": "si", "t": "ti"}).collect()}
    assert got == {1: ([4, 5, 4, 6, 6], [6]), 2: ([6], [4]), None: ([4, 5], [4, 5])}


def test_padding_is_written_as_one_text(spark):
    df = spark.createDataFrame([([],), ([7],), ([7, 8, 9],), ([7, 8, 9, 10, 11, 12],)], "ids array<int>")
    size = 5
    seq = encode.frame(F.col("ids"), size)
    n = F.least(F.size("ids") + 2, F.lit(size))
    _, out = encode.shift(seq, size)
    plain = lambda c: F.array_join(c.cast("array<string>"), " ")
    for text, want in ((encode.ints_text(seq, n, encode.PAD_ID, size), seq),
                       (encode.ints_text(encode.attention_mask(seq, size), n, 0, size), encode.attention_mask(seq, size)),
                       (encode.ints_text(out, n - 1, encode.IGNORE, size - 1), out)):
        assert [r[0] == r[1] for r in df.select(text, plain(want)).collect()] == [True] * 4
