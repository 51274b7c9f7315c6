"""Corpus build on a stream (the row-wise operators on ``readStream``).

The reference has no streaming logic; every corpus operator that is a pure
column function (fixture derivation, cleaning, the hash split) runs unchanged
on a streaming DataFrame. New raw files are turned into cleaned, split pairs
and appended to a Parquet table partitioned by ``split`` and ``lang``. The
stream keeps no state (no aggregation, no watermark), and its progress lives
in the checkpoint location, so a restarted or lost query resumes exactly
where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from redline.operators import corpus, split
from redline.plans.session import checkpoint_dir
from redline.sources import fixtures


def pairs_stream(spark: SparkSession, documents_dir: str, max_files: int | None = None) -> DataFrame:
    """``gec_pairs`` of every document file that arrives in ``documents_dir``; a
    micro-batch takes all new files unless ``max_files`` is given."""
    schema = spark.read.parquet(documents_dir).schema
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return fixtures.gec_pairs_from(reader.parquet(documents_dir).select("doc_id", "text", "lang"))


def cleaned_split_stream(pairs: DataFrame, multilingual_lang: str = "es") -> DataFrame:
    """The first corpus variant plus the hash split, as a stateless stream."""
    built = corpus.build_corpus(fixtures.raw_english(pairs), fixtures.raw_multilingual(pairs),
                                multilingual_lang)
    return split.hash_split(built)


def start(spark: SparkSession, documents_dir: str, out_dir: str,
          checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the corpus stream; ``available_now`` processes what is there and stops."""
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/streams/corpus"
    stream = cleaned_split_stream(pairs_stream(spark, documents_dir))
    w = (stream.writeStream.format("parquet").option("checkpointLocation", ckpt)
         .partitionBy("split", "lang").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(out_dir)
