"""URL filter (operator 9): rules first, gradient-boosted trees for the rest.

A rule (host, path, action) fits its host and all subdomains if the URL's path starts
with the rule's path; the longest rule wins. URLs that no rule fits are judged by
boosted trees on lexical features: length, depth, digit ratio, character entropy,
parameter counts, hyphens, host labels, and the smoothed block rate of the host's suffix.

The block rates by suffix and their prior are counted on all distinct labelled URLs; the
trees are fitted on at most ``MAX_TRAIN`` of them (chosen by hash). The given tables label no
URL, so the registered query labels training URLs by ``SEED_WORDS`` in the host; the words
themselves are not features.

Defined cases: a URL that is null or has no ``://`` has empty host and path and fits
no rule; a training set of one class judges all URLs alike, an empty one allows all (``fit``
warns that no trees were fitted);
repeated rows get equal verdicts; extra columns are ignored.
"""

from __future__ import annotations

import string
import warnings

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.llm.common import cut

MAX_TRAIN = 20_000
#: Words that mark unwanted hosts, the markers of the hosts in the given tables.
SEED_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")
FEATURES = ["f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_labels", "f_suffix"]


def parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    u = F.coalesce(F.col(url), F.lit(""))
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return urls.withColumn("host", F.translate(F.regexp_extract(u, whole, 1), string.ascii_uppercase, string.ascii_lowercase)
                           ).withColumn("path", F.regexp_extract(u, whole, 2))


def matched_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, action): the longest fitting rule of each distinct URL. Host suffixes of as
    many labels as some rule has join the rules by equality, so any number of rules works and a
    host of any length makes only those suffixes. Of equally long rules (``net`` + ``/en/`` and
    ``x.net`` + ``/e``) one that blocks wins, then the greatest."""
    rules = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "action").distinct()
    dots = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    sizes = rules.select((dots(F.col("suffix")) + 1).alias("n")).filter("n is not null").distinct().collect()   # label counts of rules
    wanted = F.array(*[F.lit(n) for n in sorted(r["n"] for r in sizes)]).cast("array<int>")
    most = dots(F.col("host")) + 1
    suffixes = F.transform(F.filter(wanted, lambda n: n <= most), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    pairs = (urls.select("url", "host", "path").distinct().filter("host <> ''")
             .select("url", "path", F.explode(suffixes).alias("suffix")).join(rules, "suffix")
             .filter(F.startswith("path", "prefix")))
    rule = F.concat("suffix", "prefix")
    best = F.max(F.struct(F.length(rule).alias("n"), F.when(F.col("action") == "block", 1).otherwise(0).alias("b"),
                          rule.alias("rule"), "action"))
    return pairs.groupBy("url").agg(best.alias("r")).select("url", F.col("r.rule").alias("rule"), F.col("r.action").alias("action"))


def features(urls: DataFrame) -> DataFrame:
    """Adds the lexical features but the suffix rate; ``suffix`` is the last host label."""
    u = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    count = lambda ch: (F.length(u) - F.length(F.replace(u, F.lit(ch), F.lit("")))).cast("double")
    digits = F.length(u) - F.length(F.regexp_replace(u, "[0-9]", ""))
    chars = F.array_distinct(F.split(u, ""))
    share = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    return (urls.withColumn("f_length", n).withColumn("f_depth", count("/")).withColumn("f_digits", digits / n)
            .withColumn("f_entropy", entropy).withColumn("f_params", count("=") + count("&"))
            .withColumn("f_hyphens", count("-")).withColumn("f_labels", F.size(F.split("host", r"\.")).cast("double"))
            .withColumn("suffix", F.substring_index("host", ".", -1)))


def seed_labels(urls: DataFrame, words: tuple[str, ...] = SEED_WORDS) -> DataFrame:
    """(url, host, label): 1 if a host label holds one of the words as a whole part."""
    pattern = r"(^|[.\-])(" + "|".join(words) + r")([.\-]|$)"
    return urls.filter("host <> ''").select("url", "host", F.col("host").rlike(pattern).cast("double").alias("label"))


class UrlModel:
    """Boosted trees with the suffix block rates of all labelled URLs."""

    def __init__(self, trees, rates: DataFrame | None, prior: float):
        self.trees, self.rates, self.prior = trees, rates, prior

    def score(self, urls: DataFrame) -> DataFrame:
        """Adds ``p_block``."""
        if self.trees is None:
            return urls.withColumn("p_block", F.lit(float(self.prior)))
        rows = features(urls).join(self.rates, "suffix", "left").withColumn(
            "f_suffix", F.coalesce("rate", F.lit(float(self.prior))))
        scored = self.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="f").transform(rows))
        return scored.select(*urls.columns, vector_to_array("probability")[1].alias("p_block"))


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN, trees: int = 20, depth: int = 4, seed: int = 7) -> UrlModel:
    """Suffix rates of all labelled URLs (url, host, label), trees on at most ``max_train`` distinct ones."""
    known = labelled.groupBy("url", "host").agg(F.max("label").alias("label"))
    counts = cut(known.groupBy(F.substring_index("host", ".", -1).alias("suffix"))
                 .agg(F.sum("label").alias("s"), F.count(F.lit(1)).alias("n")), "url-suffix-counts")
    total = counts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = (total["s"] or 0.0) / (total["n"] or 1)
    train = cut(features(known.orderBy(F.xxhash64("url"), "url").limit(max_train)), "url-train")
    drawn = train.agg(F.avg("label")).first()[0]
    if drawn in (None, 0.0, 1.0):
        warnings.warn(f"no trees fitted: the labelled URLs drawn are of one class or none; p_block is {prior} for all", stacklevel=2)
        return UrlModel(None, None, prior)
    rates = counts.select("suffix", ((F.col("s") + F.lit(20 * prior)) / (F.col("n") + 20)).alias("rate"))
    rows = train.join(rates, "suffix").withColumn("f_suffix", F.col("rate"))
    # rare blocks weigh as much as the rest of the sample together
    weight = F.when(F.col("label") == 1, F.lit(0.5 / drawn)).otherwise(F.lit(0.5 / (1 - drawn)))
    gbt = GBTClassifier(featuresCol="f", labelCol="label", weightCol="w", maxIter=trees, maxDepth=depth, seed=seed)
    data = VectorAssembler(inputCols=FEATURES, outputCol="f").transform(rows).withColumn("w", weight).select("f", "label", "w")
    data = data.repartition(4).cache()
    try:
        return UrlModel(gbt.fit(data), rates, prior)
    finally:
        data.unpersist()


def judge(pages: DataFrame, rules: DataFrame, model: UrlModel, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) for every row."""
    rows = parts(pages.select("page_id", "url"))
    found = matched_rules(rows, rules)
    scored = model.score(rows).join(found, "url", "left")
    verdict = F.coalesce("action", F.when(F.col("p_block") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p_block")
