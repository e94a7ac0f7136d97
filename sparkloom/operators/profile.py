"""Aggregates that describe shards, windows, labels and training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.tokens import IGNORE
from sparkloom.operators.order import running_sum
from sparkloom.operators.windows import WindowSpec, window_counts


def window_stats(windows: DataFrame, doc: str) -> DataFrame:
    per = windows.groupBy(doc).agg(F.count("*").alias("w"), F.sum("overlap_len").alias("o"), F.sum("n_tokens").alias("t"))
    return per.agg(F.count("*").alias("docs"), F.sum((F.col("w") > 1).cast("long")).alias("windowed_docs"), F.sum("w").alias("windows"), F.avg("w").alias("windows_per_doc"), (F.sum("o") / F.sum("t")).alias("overlap_fraction"))


def _window_tokens(n: Column, spec: WindowSpec) -> Column:
    """Tokens of all windows of a document of n tokens, repeated ones and end marks included, in closed form."""
    s = max(spec.length - spec.overlap, spec.length // 2)
    # Windows k = 0 .. m-1 start at k*s; those with k*s + length >= n end the document.
    full = F.when(n < spec.length, 0).otherwise(F.floor((n - spec.length + s - 1) / s))  # windows that stop before the end
    m = F.least(F.ceil(n / s), F.lit(spec.cap + 1))
    full = F.least(full, m)
    tail = m - full
    # Tail windows have n - k*s tokens for k = full .. m-1, and an end mark each.
    ends = tail * n - F.lit(s) * F.floor((full + m - 1) * tail / 2) + tail
    return F.when(n <= 0, 0).when(n < spec.length, n + 1).otherwise(full * spec.length + ends).cast("long")


def shard_tokens(docs: DataFrame, spec: WindowSpec, *, n: str = "n", by: list[str] | None = None) -> DataFrame:
    by = by or ["bucket", "file_idx"]
    return docs.where(F.col(n) > 0).groupBy(*by).agg(F.sum(_window_tokens(F.col(n), spec)).alias("tokens"))


def shard_stats(docs: DataFrame, spec: WindowSpec, least_chars: int, *, by: tuple[str, ...] = ("bucket", "file_idx")) -> DataFrame:
    """Documents read and skipped, windows and tokens of each shard, in one aggregation over counts."""
    kept = F.col("chars") >= least_chars
    d = window_counts(docs, spec, "n")
    return d.groupBy(*by).agg(
        F.count("*").alias("docs_read"),
        F.sum((~kept).cast("long")).alias("docs_skipped"),
        F.sum(F.when(kept, F.col("n_windows")).otherwise(0)).alias("windows"),
        F.sum(F.when(kept, _window_tokens(F.col("n"), spec)).otherwise(0)).alias("tokens"),
    )


def bucket_rollup(shards: DataFrame) -> DataFrame:
    total = F.lit("TOTAL")
    r = shards.rollup("split", "bucket").agg(F.count("*").alias("shards"), F.sum("tokens").alias("tokens"), F.grouping("split").alias("gs"), F.grouping("bucket").alias("gb"))
    return r.select(F.when(F.col("gs") == 1, total).otherwise(F.col("split")).alias("split"), F.when(F.col("gb") == 1, total).otherwise(F.col("bucket")).alias("bucket"), "shards", "tokens")


def eod_census(windows: DataFrame, eod, by: list[str]) -> DataFrame:
    n = windows.select(*by, F.size("tokens").cast("long").alias("n"), F.size(F.filter("tokens", lambda x: x == eod)).cast("long").alias("e"), (F.element_at("tokens", -1) == eod).cast("long").alias("last"))
    return n.groupBy(*by).agg(F.count("*").alias("windows"), F.sum("n").alias("tokens"), F.sum("e").alias("eods"), F.sum("last").alias("ending"), F.sum(F.col("e") - F.col("last")).alias("interior"), (F.sum("e") / F.sum("n")).alias("eod_fraction"))


def label_census(sequences: DataFrame, eod: int) -> DataFrame:
    count = lambda a, f: F.size(F.filter(a, f)).cast("long")
    after = F.slice("labels", F.lit(2), F.size("labels"))
    seen = F.slice("input_ids", F.lit(2), F.greatest(F.col("content_len") - 1, F.lit(0)))
    c = sequences.select(count(after, lambda x: x != IGNORE).alias("t"), count(after, lambda x: x == eod).alias("e"), count(seen, lambda x: x == eod).alias("a"))
    return c.agg(F.count("*").alias("sequences"), F.sum("t").alias("trained"), F.sum("e").alias("eod_trained"), F.sum(F.col("a") - F.col("e")).alias("eod_masked"))


def interval_metrics(log: DataFrame, every: int) -> DataFrame:
    """Means of loss and gradient norm, tokens and packing of each interval of steps."""
    g = log.groupBy(F.floor(F.col("step") / every).cast("long").alias("interval"))
    return g.agg(F.count("*").alias("rows"), F.avg("loss").alias("mean_loss"), F.avg("grad_norm").alias("mean_grad_norm"), F.sum("trained").alias("tokens"), (F.sum("trained") * 100.0 / F.sum("possible")).alias("packing_pct"))


def interval_rates(log: DataFrame, every: int) -> DataFrame:
    """(interval, seconds, tokens_per_second, seconds_per_step): an interval lasts from the last row before it, or its own first row, to its last row
    (`clock`, in seconds). Intervals are few, so their order is one small sort."""
    g = log.groupBy(F.floor(F.col("step") / every).cast("long").alias("interval")).agg(F.sum("trained").alias("t"), F.countDistinct("step").alias("n"), F.min("clock").alias("a"), F.max("clock").alias("z"))
    since = F.coalesce(F.lag("z").over(Window.orderBy("interval")), F.col("a"))
    g = g.withColumn("seconds", F.col("z") - since)
    return g.select("interval", "seconds", F.when(F.col("seconds") > 0, F.col("t") / F.col("seconds")).otherwise(0.0).alias("tokens_per_second"), (F.col("seconds") / F.col("n")).alias("seconds_per_step"))


def running_tokens(log: DataFrame) -> DataFrame:
    """Trained tokens of each step over ranks, and so far."""
    return running_sum(log.groupBy("step").agg(F.sum("trained").alias("tokens")), "step", "tokens", "total")


def eval_perplexity(losses: DataFrame, most: int | None) -> DataFrame:
    """Mean loss over the first `most` batches (None: 100), and exp of it held at 20."""
    kept = losses.where(F.col("batch_idx") < (most or 100))
    return kept.agg(F.count("*").alias("batches"), F.avg("loss").alias("eval_loss"), F.exp(F.least(F.avg("loss"), F.lit(20.0))).alias("perplexity"))
