"""Registered queries of the numbered operators and the pipeline."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.llm import ann, bpe, chat, decontaminate, embed_dedup, merkle, quality, repair, sharding, simhash, substring_dedup, trie, urls
from redline.llm.common import binary_parts, bounded, cut, read, release
from redline.plans.session import checkpoint_dir


CONTROL = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                    F.lit(CONTROL).alias("text"))
    return chat.read_back(chat.format_conversations(turns.unionByName(planted)))


def _kept_digest(batches):
    for b in batches:
        data, off = binary_parts(b.column("text"))
        raw = data.tobytes()
        out = []
        for i, runs in enumerate(b.column("removed").to_pylist()):
            h, at, gone = hashlib.sha256(), int(off[i]), 0
            for r in runs:
                h.update(raw[at:off[i] + r["lo"]])
                at = int(off[i] + r["hi"])
                gone += r["hi"] - r["lo"]
            h.update(raw[at:off[i + 1]])
            out.append((int(off[i + 1] - off[i]), gone, len(runs), h.hexdigest()))
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([b.column("doc"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3])],
                                         ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(read(spark, sf_dir, "documents"), finish=_kept_digest,
                                    schema="doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_sharding(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    rows = cut(sharding.records(read(spark, sf_dir, "documents")), "shard-records")
    stored = f"{checkpoint_dir(spark).rstrip('/')}/tables/shard-map-{uuid.uuid4().hex}"
    sharding.save_map(sharding.first_map(sharding.slot_bytes(rows), shards), stored)
    return sharding.place(rows, sharding.load_map(spark, stored)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op5_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    out = f"{checkpoint_dir(spark).rstrip('/')}/tables/repair-{uuid.uuid4().hex}"
    repair.write(read(spark, sf_dir, "documents"), out, path)
    release(spark)
    return repair.read_documents(spark, out, path)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, radius=2, seed=42)
    return found.select(F.col("id").alias("doc_id"),
                        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The query's rules (host, path, action).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    known = urls.parts(pages.select("url"))
    model = urls.fit(urls.seed_labels(known))
    return urls.judge(pages, rules, model)


def byte_bpe_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _bpe_digest(batches):
    for b in batches:
        ids, off = b.column("ids").flatten().to_numpy().astype("<u4"), b.column("ids").offsets.to_numpy()
        off = off - off[0]
        data, at = binary_parts(b.column("text"))
        text = data.tobytes()
        n = range(b.num_rows)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc"), pa.array(np.diff(off).astype(np.int64)),
             pa.array([hashlib.sha256(ids[off[i]:off[i + 1]].tobytes()).hexdigest() for i in n], pa.string()),
             pa.array([hashlib.sha256(text[at[i]:at[i + 1]]).hexdigest() for i in n], pa.string())],
            ["doc", "n_tokens", "ids_sha256", "decoded_sha256"])


def bpe_digests(docs: DataFrame) -> DataFrame:
    """n_tokens and digests of the ids and the decoded texts of ``docs``."""
    return bpe.round_trip(docs, byte_bpe_path(), _bpe_digest, "doc long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read(spark, sf_dir, "documents"))


def op11_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.98)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.build(*trie.graft(*trie.numbered(read(spark, sf_dir, "conversations"))))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str, levels: int = merkle.K) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fields = [F.col(c) for c in merkle.FIELDS]
    one_more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    changed = [one_more if c == "n_chars" else F.col(c) for c in merkle.FIELDS]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    leaf = merkle.hash_leaf(fields)
    manifest = merkle.build(docs, F.col("lang"), F.col("doc_id"), leaf,
                            {"claim": F.when(tampered, merkle.hash_leaf(changed)).otherwise(leaf)}, levels)
    hexed = F.lower(F.hex("leaf")).alias("leaf")
    claims = manifest.leaves.select("tree", "idx", "claim", "id", hexed).join(manifest.tops(), "tree")
    root = F.lit(manifest.root).cast("string")
    return merkle.prove(manifest, claims).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_sharding": op3_sharding,
    "op4_quality": op4_quality,
    "op5_repair": op5_repair,
    "op6_ann": op6_ann,
    "op7_decontaminate": op7_decontaminate,
    "op8_simhash": op8_simhash,
    "op9_url_filter": op9_url_filter,
    "op10_bpe": op10_bpe,
    "op11_embed_dedup": op11_embed_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": pipeline,
}
_TURNS = "string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)"
_LOSS = "string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant')"


def _escaped(column: str) -> str:
    return rf"regexp_replace({column}, '{chat._ESCAPE}', '\1\\\2\3', 'g')"


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text in SQL, bit by bit (fixed value: its polynomial)."""
    bits = "list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(r, b))"
    octets = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda r, b: {bits}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _leaf(n_chars: str) -> str:
    fields = (n_chars if c == "n_chars" else c for c in merkle.FIELDS)
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in fields) + ")"


def _halved(name: str) -> str:
    return (f"SELECT * REPLACE (lvl + 1 AS lvl, list_transform(range(0, len(hs), 2), lambda i: sha256(hs[i + 1] || "
            f"coalesce(hs[i + 2], ''))) AS hs) FROM {name} WHERE len(hs) > 1")


#: SQL without the formatting: digests of the turns themselves, and the length of
#: marks, roles and texts with their control strings escaped.
ORACLES: dict[str, str] = {
    "op1_chat_format": rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'),
e AS (SELECT *, replace(replace({_escaped("role")}, '\', '\\'), chr(10), '\n') AS erole, {_escaped("text")} AS etext FROM t)
SELECT conv_id, count(*) AS n_turns, sha256({_TURNS}) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce({_LOSS}, '')) AS loss_sha256,
       CAST(sum({len(chat.TURN)} + length(erole) + 1 + length(etext) + {len(chat.END)} + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
         CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf('(CAST(n_chars AS HUGEINT) + 1)')} END AS forged FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaf),
up AS (SELECT lang, 0 AS lvl, list(leaf ORDER BY idx) AS hs FROM o GROUP BY lang UNION ALL {_halved('up')}),
tops AS (SELECT lang, hs[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx FROM up WHERE len(hs) = 1),
over_all AS (SELECT 0 AS lvl, list(subroot ORDER BY idx) AS hs FROM tops UNION ALL {_halved('over_all')}),
nodes AS (SELECT lang, lvl, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS j FROM up),
over_nodes AS (SELECT lvl, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS j FROM over_all),
steps AS (
  SELECT o.lang, o.idx, l.lvl AS seq, (o.idx >> l.lvl) & 1 AS own, n.h FROM o
  JOIN up l ON l.lang IS NOT DISTINCT FROM o.lang AND len(l.hs) > 1
  LEFT JOIN nodes n ON n.lang IS NOT DISTINCT FROM o.lang AND n.lvl = l.lvl AND n.j = xor(o.idx >> l.lvl, 1)
  UNION ALL
  SELECT o.lang, o.idx, 1000 + l.lvl, (t.idx >> l.lvl) & 1, n.h FROM o
  JOIN tops t ON t.lang IS NOT DISTINCT FROM o.lang JOIN over_all l ON len(l.hs) > 1
  LEFT JOIN over_nodes n ON n.lvl = l.lvl AND n.j = xor(t.idx >> l.lvl, 1)),
paths AS (SELECT lang, idx, list({{'own': own, 'h': h}} ORDER BY seq) AS p, string_agg(h, '' ORDER BY seq) AS sibs FROM steps GROUP BY lang, idx),
out AS (
  SELECT o.doc_id, o.leaf, t.subroot, (SELECT hs[1] FROM over_all WHERE len(hs) = 1) AS root, sha256(coalesce(p.sibs, '')) AS proof_sha256,
         list_reduce(coalesce(p.p, []), lambda a, s: CASE WHEN s.h IS NULL THEN sha256(a) WHEN s.own = 1 THEN sha256(s.h || a)
                     ELSE sha256(a || s.h) END, coalesce(o.forged, o.leaf)) AS folded_root
  FROM o JOIN tops t ON t.lang IS NOT DISTINCT FROM o.lang
  LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM o.lang AND p.idx = o.idx)
SELECT *, folded_root = root AS verified FROM out""",
    "op11_embed_dedup": """
WITH RECURSIVE r AS (SELECT row_number() OVER () AS n, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (
  SELECT n, label, list_transform(v, lambda x: x / list_aggregate(list_transform(v, lambda y: abs(y)), 'max')) AS u FROM r
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
sized AS (SELECT *, sqrt(list_dot_product(u, u)) AS norm FROM good),
links AS (SELECT a.n AS a, b.n AS b FROM sized a JOIN sized b ON a.label = b.label AND a.n <> b.n AND len(a.u) = len(b.u)
          AND list_dot_product(a.u, b.u) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT n AS a, n AS b FROM r UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
low AS (SELECT reach.a AS n, min(r.vec_id) AS component_id FROM reach JOIN r ON r.n = reach.b GROUP BY reach.a),
per AS (SELECT a AS n, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM r JOIN low USING (n) LEFT JOIN per USING (n)""",
    "op12_prefix_trie": f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
             PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS s FROM t GROUP BY conv_id),
cut AS (SELECT *, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM own),
c AS (SELECT a.conv_id, list_concat(coalesce(b.s, [])[1:a.h], a.s[a.h + 1:]) AS s
      FROM cut a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
p AS (SELECT conv_id, len(s) AS n, d, s[1:d] AS pre, CASE WHEN d > 0 THEN s[1:d - 1] END AS up, CASE WHEN d > 0 THEN strlen(s[d].text) ELSE 0 END AS size
      FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM c)),
node AS (SELECT d, pre, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
                coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM p GROUP BY d, pre),
kids AS (SELECT d - 1 AS d, up AS pre, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
flat AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, pre)),
under AS (SELECT x.d, x.pre, count(*) FILTER (y.n_children = 0) AS n_leaves, sum((y.n_convs - 1) * y.size) AS saved
          FROM flat x JOIN flat y ON y.d >= x.d AND y.pre[1:x.d] = x.pre GROUP BY ALL)
SELECT x.conv_id, x.d AS depth, parent.conv_id AS parent_conv_id, x.n_convs, x.n_children, under.n_leaves,
       CAST(under.saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM flat x JOIN under USING (d, pre) LEFT JOIN node parent ON parent.d = x.d - 1 AND parent.pre = x.up""",
}
