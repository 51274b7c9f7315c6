"""Pair-table sources and sinks.

* ``read_raw`` (S1/S2): one or many split paths of a raw set in one read.
* ``write_splits`` / ``read_pairs_csv`` (S4/S3): CSV that pandas writes and
  reads: header, no index, quotes doubled (not backslash-escaped), no trimming
  of leading/trailing blanks, multi-line fields. Reading applies pandas' default
  NA texts (``NA``, ``None``, ``null``, ...) and drops rows with a null text,
  as ``read_csv(...).dropna(subset=...)`` does.
* Parquet is the default sink (``fmt='parquet'``), partitioned by split/lang.
* ``save_vocab`` / ``load_vocab`` (S5): versions of the label vocabulary with its ids
  and the parameters it was built with, and a pointer to the current one that is
  switched atomically; a stored vocabulary is reused only when those parameters match.
"""

from __future__ import annotations

import csv
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redline.functions.text import PANDAS_NA_TOKENS, na_to_null
from redline.operators.corpus import drop_null_subset

PAIR_SCHEMA = T.StructType([
    T.StructField("pair_id", T.LongType()),
    T.StructField("incorrect", T.StringType()),
    T.StructField("correct", T.StringType()),
    T.StructField("transformation", T.StringType()),
    T.StructField("lang", T.StringType()),
])

_CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "encoding": "UTF-8",
}


def read_raw(spark: SparkSession, paths, fmt: str = "parquet", schema=None) -> DataFrame:
    """Read one split path or all split paths of a raw set (bag union)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    return r.load(paths)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet",
                 partition_by=("split",), mode: str = "overwrite") -> None:
    """One write job, one folder per split (and language when asked)."""
    w = df.write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        # null is written as an empty unquoted field (pandas writes NaN as ''),
        # the empty string as "" so it stays distinguishable in Spark.
        w = w.options(**_CSV_OPTIONS).option("nullValue", "").option("emptyValue", '""')
    w.format(fmt).save(path)


def file_headers(spark: SparkSession, files: list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files by their header row. Only first lines are read, on the driver,
    a few files at a time (what listing them costs as well); a compressed file
    is opened by its codec."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def header(file: str) -> tuple[str, ...]:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)) if "://" in file or file.startswith("file:") else jvm.org.apache.hadoop.fs.Path(file)
        stream = path.getFileSystem(conf).open(path)
        try:
            codec = codecs.getCodec(path)
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
                codec.createInputStream(stream) if codec is not None else stream, "UTF-8"))
            text = lines.readLine()
            while text is not None and text.count('"') % 2:        # a quoted name may hold a line break
                more = lines.readLine()
                if more is None:
                    break
                text = f"{text}\n{more}"
        finally:
            stream.close()
        return tuple(next(csv.reader([(text or "").removeprefix("\ufeff")]), ()))

    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(header, files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, names in zip(files, found, strict=True):
        if names:                                             # an empty file has no rows
            groups.setdefault(names, []).append(file)
    return groups


def read_pairs_csv(spark: SparkSession, path, schema: T.StructType = PAIR_SCHEMA,
                   na_tokens=PANDAS_NA_TOKENS, subset=("incorrect", "correct")) -> DataFrame:
    """S3: declared schema (no inference), pandas NA texts -> null, then
    ``dropna(subset)``. ``na_tokens=()`` keeps literal ``NA`` / ``None`` texts.

    ``path`` is a file, a folder or a list of them. Every file's columns are taken
    by the names in its own header, in any order: files are grouped by header, each
    group is one scan, and the groups are united by name. A file without
    ``pair_id`` gets none (null), any other missing column raises and names the file."""
    paths = [path] if isinstance(path, str) else list(path)
    parts = []
    for root in paths:
        listed = spark.read.format("text").load(root)
        folders = [c for c in listed.columns if c != "value"]       # columns that partition folders give
        groups = file_headers(spark, sorted(listed.inputFiles()))
        for names, files in sorted(groups.items()):
            raw = spark.read.options(**_CSV_OPTIONS)
            if folders:
                raw = raw.option("basePath", root)
            raw = raw.schema(T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])).csv(files)
            by_name = {n: f"c{i}" for i, n in reversed(list(enumerate(names)))} | {c: c for c in folders}
            missing = [f.name for f in schema.fields if f.name not in by_name and f.name != "pair_id"]
            if missing:
                raise ValueError(f"{files[0]}: no column {', '.join(missing)}")
            parts.append(raw.select(*[(F.col(by_name[f.name]) if f.name in by_name else F.lit(None)).cast(f.dataType).alias(f.name)
                                      for f in schema.fields]))
    df = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    text_cols = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    if na_tokens:
        df = df.select(*[na_to_null(c, na_tokens).alias(c) if c in text_cols else F.col(c)
                         for c in df.columns])
    return drop_null_subset(df, subset)


def save_vocab(vocab: DataFrame, path: str, lang: str | None, top_k: int) -> str:
    """Persist ``label, label_id, freq`` with the build parameters; returns
    the version's name.

    A version is written beside the others and becomes current by one atomic
    rename of a pointer file, so readers see the old vocabulary or the new one,
    never half of either, and a failed save leaves the old one current."""
    version = uuid.uuid4().hex
    (vocab.withColumn("vocab_lang", F.lit(lang).cast("string"))
     .withColumn("top_k", F.lit(top_k)).coalesce(1)  # at most top_k + 2 rows
     .write.mode("error").parquet(f"{path.rstrip('/')}/versions/{version}"))
    _switch(vocab.sparkSession, path, version)
    return version


def _switch(spark: SparkSession, path: str, version: str) -> None:
    """Point ``CURRENT`` at ``version`` (written aside, then renamed over the old one)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, current = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}") for name in (f"next-{version}", "CURRENT"))
    out = new.getFileSystem(conf).create(new, True)
    out.write(bytearray(version, "ascii"))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.getFileSystem(conf).makeQualified(new).toUri(), conf)
    files.rename(new.getFileSystem(conf).makeQualified(new), new.getFileSystem(conf).makeQualified(current), over)


def vocab_versions(spark: SparkSession, path: str) -> tuple[str | None, list[str]]:
    """(current version or None, all written versions)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    current, kept = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}") for name in ("CURRENT", "versions"))
    name = None
    if fs.exists(current):
        stream = fs.open(current)
        name = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
        stream.close()
    return name, sorted(s.getPath().getName() for s in fs.listStatus(kept)) if fs.exists(kept) else []


def load_vocab(spark: SparkSession, path: str, lang: str | None, top_k: int) -> DataFrame | None:
    """The current stored vocabulary if there is one and it was built with the
    same ``lang`` / ``top_k``; otherwise ``None`` (caller rebuilds). Only an absent
    pointer counts as no vocabulary; any other failure to read is raised."""
    version, _ = vocab_versions(spark, path)
    if version is None:
        return None
    v = spark.read.parquet(f"{path.rstrip('/')}/versions/{version}")
    meta = v.select("vocab_lang", "top_k").limit(1).collect()
    if not meta or meta[0]["vocab_lang"] != lang or meta[0]["top_k"] != top_k:
        return None
    return v.select("label", "label_id", "freq")
