"""Run records: masked loss, best checkpoint, run configuration.

``runs`` has one row per (run, epoch): small by nature (runs x epochs), but
everything is still an aggregation or a per-run window bounded by the number
of epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The defaults that a stored run configuration overrides.
DEFAULT_CONFIG = {
    "freeze_encoder": "false",
    "d_model": "512",
    "num_heads": "8",
    "d_ff": "2048",
    "num_layers": "4",
    "max_len": "128",
}


def masked_loss(token_losses: DataFrame, batch: str = "batch", loss: str = "nll",
                label: str = "label") -> DataFrame:
    """A10: per batch, the mean loss over positions whose label is not -100; then
    the plain mean over batches (mean of batch means, not the token mean).
    A batch with no visible position has no mean and takes no part in the
    loss; ``n_batches`` counts it. Without any visible position the loss is 0."""
    per = token_losses.groupBy(batch).agg(
        F.avg(F.when(F.col(label) != -100, F.col(loss))).alias("batch_loss"))
    return per.agg(F.coalesce(F.avg("batch_loss"), F.lit(0.0)).alias("loss"),
                   F.count(F.lit(1)).alias("n_batches"))


def masked_array_loss(rows: DataFrame, batch: str = "batch", losses: str = "losses", labels: str = "labels") -> DataFrame:
    """A10 on encoded rows: ``labels`` and ``losses`` are arrays by position, and
    positions labelled -100 don't count. Each row is reduced to its loss sum and
    number of visible positions where it lies, so nothing is exploded and the
    shuffle carries two numbers a batch and task. Same result as ``masked_loss``.
    A null loss at a visible position is no position; arrays of unequal length are
    read up to the shorter."""
    n = F.least(F.size(losses), F.size(labels))
    seen = F.filter(F.arrays_zip(F.slice(losses, 1, n).alias("x"), F.slice(labels, 1, n).alias("y")),
                    lambda p: (p["y"] != -100) & p["x"].isNotNull())
    total = F.aggregate(seen, F.lit(0).cast("decimal(38,12)"), lambda acc, p: (acc + p["x"].cast("decimal(24,12)")).cast("decimal(38,12)"))
    per = rows.select(batch, total.alias("_s"), F.size(seen).alias("_n")).groupBy(batch).agg(
        F.sum("_s").cast("double").alias("_s"), F.sum("_n").alias("_n"))
    mean = F.when(F.col("_n") > 0, (F.col("_s") / F.col("_n")).cast("decimal(24,12)"))
    return per.agg(F.coalesce(F.round(F.avg(mean).cast("double"), 9), F.lit(0.0)).alias("loss"), F.count(F.lit(1)).alias("n_batches"),
                   F.coalesce(F.sum("_n"), F.lit(0)).alias("n_positions"))


def best_checkpoint(runs: DataFrame, run: str = "run_id", epoch: str = "epoch",
                    val_loss: str = "val_loss") -> DataFrame:
    """Per run, the epoch with the lowest validation loss (first epoch wins
    ties, as a strict ``<`` running best does), and how often a checkpoint
    would have been saved. Null and NaN losses are never below the running
    best, so they are never saved nor best."""
    usable = F.when(~F.isnan(F.col(val_loss).cast("double")), F.col(val_loss))
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    by_loss = Window.partitionBy(run).orderBy(F.col("_loss").asc_nulls_last(), F.col(epoch))
    marked = (runs.withColumn("_loss", usable).withColumn("_best_before", F.min("_loss").over(w))
              .withColumn("saved", F.col("_loss").isNotNull() & (F.col("_best_before").isNull() | (F.col("_loss") < F.col("_best_before"))))
              .withColumn("_rank", F.row_number().over(by_loss)))
    # numeric aggregates only: the best row is marked by the window, so no
    # struct ordering (and no sort-based aggregation) is needed
    is_best = (F.col("_rank") == 1) & F.col("_loss").isNotNull()
    return marked.groupBy(run).agg(
        F.max(F.when(is_best, F.col(epoch))).alias("best_epoch"),
        F.max(F.when(is_best, F.col(val_loss))).alias("best_val_loss"),
        F.sum(F.col("saved").cast("int")).cast("bigint").alias("n_saves"),
        F.count(F.lit(1)).alias("n_epochs"))


def merged_config(stored: Column, defaults: dict | None = None) -> Column:
    """Stored values override the defaults; keys missing in ``stored`` keep
    the default; extra stored keys are kept."""
    d = defaults or DEFAULT_CONFIG
    dmap = F.create_map(*[x for k, v in sorted(d.items()) for x in (F.lit(k), F.lit(v))])
    stored = F.coalesce(stored, F.create_map().cast("map<string,string>"))
    return F.map_zip_with(dmap, stored, lambda k, dv, sv: F.coalesce(sv, dv))
