"""The derived ``gec_pairs`` table: sentence pairs built from ``documents``.

The test data holds no sentence pairs, so both the Spark side and the DuckDB
oracle derive them the same way: split every document into sentences, and let
an md5 of the sentence pick one of six corruptions (drop a word, duplicate the
first, rotate, misspell one word, add an instruction prefix, leave as is).
Some rows get a null or blank ``incorrect`` or a null ``transformation`` so that
every cleaning rule has something to remove. ``pair_id`` is the stable order
for every tie: the document id times 2**32 plus the sentence's position, so no
two sentences share one (an id of 2**31 or more raises an overflow). Every
sentence with at least one word is kept, however long.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redline.functions.text import DUCK_WS, tokens

# Corruption kinds, indexed by md5 % 6.
KINDS = ["drop", "dup", "rotate", "replace", "prefix", "none"]
PREFIX = "fix grammar: "

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-repartition on ``key`` only when the scan yields fewer partitions than
    the cluster has cores (a few small files); a large scan is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, key)
    return df


def _lines(text) -> Column:
    """The sentences of a document, in order."""
    return F.split(F.regexp_replace(text, "([.!?])[ \\n]+", "$1\n"), "\n", -1)


def sentences(documents: DataFrame) -> DataFrame:
    """One row per sentence: ``doc_id, lang, pos (1-based), s, b (tokens), m (md5)``."""
    items = F.transform(_lines(F.col("text")), lambda x, i: F.struct(
        (i + 1).alias("pos"), x.alias("s"), tokens(x).alias("b"), F.md5(x).alias("m")))
    return documents.select("doc_id", "lang", F.inline(items))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("incorrect", T.StringType()), T.StructField("transformation", T.StringType())])))
def _corrupted(sentence: pa.Array) -> pa.Array:
    """The corruption of each sentence, in a list of one; a sentence without words has none."""
    ends, incorrect, transformation = [0], [], []
    for s in sentence.to_pylist():
        b = s.split() if s is not None else None          # the same words as ``tokens``
        if b:
            m = hashlib.md5(s.encode(), usedforsecurity=False).hexdigest()
            h, k = int(m[:8], 16), int(m[8:16], 16) % len(b)
            kind = KINDS[h % 6]
            if h % 97 == 0:
                x = None
            elif h % 89 == 0:
                x = "  "
            elif kind == "prefix":
                x = PREFIX + s
            elif kind == "none":
                x = s
            else:
                if kind == "drop":
                    del b[k]
                elif kind == "dup":
                    b.insert(0, b[0])
                elif kind == "rotate":
                    b.append(b.pop(0))
                else:
                    b[k] += "x"
                x = " ".join(b)
            incorrect.append(x)
            transformation.append(None if h % 83 == 0 else kind)
        ends.append(len(incorrect))
    items = pa.StructArray.from_arrays([pa.array(incorrect, pa.string()), pa.array(transformation, pa.string())], names=["incorrect", "transformation"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)


def gec_pairs_from(documents: DataFrame) -> DataFrame:
    """A sentence is a row before it is corrupted: Python holds a batch of sentences, not
    of documents. The corruption is a generator, so later filters neither repeat it nor wait for it."""
    rows = documents.select("doc_id", "lang", F.posexplode(_lines(F.col("text"))).alias("at", "correct"))
    rows = rows.select("doc_id", "lang", "at", "correct", F.inline(_corrupted("correct")))
    return rows.select(
        (F.col("doc_id") * F.lit(1 << 32) + (F.col("at") + 1)).alias("pair_id"),
        "correct", "incorrect", "transformation", "lang")


def gec_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return gec_pairs_from(spread(docs, "doc_id"))


def raw_english(pairs: DataFrame) -> DataFrame:
    """The first raw set's shape: ``modified, sentence, transformation`` (no lang)."""
    return pairs.where(F.col("lang") == "en").select(
        "pair_id", F.col("incorrect").alias("modified"),
        F.col("correct").alias("sentence"), "transformation")


def raw_multilingual(pairs: DataFrame) -> DataFrame:
    """The second raw set's shape: the same columns plus ``lang``. English rows
    belong to the first set, so every ``pair_id`` occurs in one set only."""
    return pairs.where(F.col("lang") != "en").select(
        "pair_id", F.col("incorrect").alias("modified"),
        F.col("correct").alias("sentence"), "transformation", "lang")


# DuckDB view of the same table, used by every oracle query.
GEC_PAIRS_SQL = f"""
WITH l AS (
  SELECT doc_id, lang,
         string_split(regexp_replace(text, '([.!?])[ \\n]+', '\\1' || chr(10), 'g'), chr(10)) AS ls
  FROM documents),
s AS (SELECT doc_id, lang, unnest(ls) AS s, unnest(range(1, len(ls) + 1)) AS pos FROM l),
t AS (SELECT *, list_filter(string_split_regex(s, '{DUCK_WS}'), lambda x: x <> '') AS b,
             ('0x' || substr(md5(s), 1, 8))::BIGINT AS h1,
             ('0x' || substr(md5(s), 9, 8))::BIGINT AS h2 FROM s),
u AS (SELECT *, h2 % len(b) + 1 AS k FROM t WHERE len(b) >= 1)
SELECT doc_id * 4294967296 + pos AS pair_id, s AS correct,
  CASE WHEN h1 % 97 = 0 THEN NULL WHEN h1 % 89 = 0 THEN '  '
       WHEN h1 % 6 = 0 THEN array_to_string(list_filter(b, lambda x, i: i <> k), ' ')
       WHEN h1 % 6 = 1 THEN array_to_string(list_concat([b[1]], b), ' ')
       WHEN h1 % 6 = 2 THEN array_to_string(list_concat(b[2:], [b[1]]), ' ')
       WHEN h1 % 6 = 3 THEN array_to_string(list_transform(b, lambda x, i: CASE WHEN i = k THEN x || 'x' ELSE x END), ' ')
       WHEN h1 % 6 = 4 THEN 'fix grammar: ' || s ELSE s END AS incorrect,
  CASE WHEN h1 % 83 = 0 THEN NULL
       ELSE (['drop','dup','rotate','replace','prefix','none'])[h1 % 6 + 1] END AS transformation,
  lang
FROM u
"""
