"""Decoding filters over a table of logits (prompt_id, token_id, logit): one row a token, windows by prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repetition_penalty(logits: DataFrame, generated: DataFrame, penalty: float) -> DataFrame:
    """Logits of tokens in `generated` (prompt_id, token_id) move away from being chosen; the prompt's own tokens don't count."""
    hit = logits.join(generated.select("prompt_id", "token_id").distinct().withColumn("_hit", F.lit(True)), ["prompt_id", "token_id"], "left")
    moved = F.when(F.col("logit") < 0, F.col("logit") * penalty).otherwise(F.col("logit") / penalty)
    return hit.withColumn("logit", F.when(F.col("_hit"), moved).otherwise(F.col("logit"))).drop("_hit")


def temperature(logits: DataFrame, t: float) -> DataFrame:
    return logits if t == 1.0 else logits.withColumn("logit", F.col("logit") / t)


def top_k(logits: DataFrame, k: int | None) -> DataFrame:
    """The k highest, with ties of the k-th. 0 and None keep all."""
    if not k:
        return logits
    r = F.rank().over(Window.partitionBy("prompt_id").orderBy(F.desc("logit")))
    return logits.withColumn("_r", r).where(F.col("_r") <= k).drop("_r")


def softmax(logits: DataFrame, out: str = "prob") -> DataFrame:
    w = Window.partitionBy("prompt_id")
    e = logits.withColumn("_e", F.exp(F.col("logit") - F.max("logit").over(w)))
    return e.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def top_p(logits: DataFrame, p: float | None) -> DataFrame:
    """Tokens while what stands before them sums to at most p; the first always stays. Probabilities are those of the tokens that are there."""
    if p is None:
        return logits
    w = Window.partitionBy("prompt_id").orderBy(F.desc("logit"), "token_id").rowsBetween(Window.unboundedPreceding, 0)
    s = softmax(logits, "_p").withColumn("_b", F.sum("_p").over(w) - F.col("_p"))
    first = F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("logit"), "token_id")) == 1
    return s.withColumn("_f", first).where(F.col("_f") | (F.col("_b") <= p)).drop("_p", "_b", "_f")


def argmax(logits: DataFrame) -> DataFrame:
    """Highest logit, ties to the lower id."""
    return logits.groupBy("prompt_id").agg(F.max_by("token_id", F.struct("logit", -F.col("token_id"))).alias("token_id"))


def draw(logits: DataFrame, seed: int) -> DataFrame:
    """One token by inverse cumulative probability at a draw that seed and prompt fix."""
    from sparkloom.operators.windows import stable_draw

    w = Window.partitionBy("prompt_id").orderBy("token_id").rowsBetween(Window.unboundedPreceding, 0)
    c = softmax(logits, "_p").withColumn("_c", F.sum("_p").over(w)).withColumn("_u", stable_draw(F.lit(seed), F.col("prompt_id")))
    return c.groupBy("prompt_id").agg(F.coalesce(F.min(F.when(F.col("_c") > F.col("_u"), F.col("token_id"))), F.max("token_id")).alias("token_id"))


def all_stopped(tokens: DataFrame, eos: int) -> DataFrame:
    """Steps at which every prompt has produced the end."""
    return tokens.groupBy("step").agg(F.bool_and(F.col("token_id") == eos).alias("stop"))


def masked_cross_entropy(logits: DataFrame, targets: DataFrame, ignore: int = -100) -> DataFrame:
    """Mean negative log-probability of targets (prompt_id, target) that are not ignored."""
    w = Window.partitionBy("prompt_id")
    peak = F.max("logit").over(w)
    lse = logits.withColumn("_m", peak).withColumn("_l", F.col("_m") + F.log(F.sum(F.exp(F.col("logit") - F.col("_m"))).over(w)))
    hit = lse.join(targets.where(F.col("target") != ignore), "prompt_id").where(F.col("token_id") == F.col("target"))
    return hit.agg(F.count("*").alias("targets"), F.avg(F.col("_l") - F.col("logit")).alias("loss"))


def token_rank(logits: DataFrame, token: int) -> DataFrame:
    """(prompt_id, prob, rank): the token's probability and how many are strictly above it."""
    s = softmax(logits).withColumn("rank", (F.rank().over(Window.partitionBy("prompt_id").orderBy(F.desc("logit"))) - 1).cast("int"))
    return s.where(F.col("token_id") == token).select("prompt_id", "prob", "rank")


def token_rank_stats(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.avg("prob").alias("mean_prob"), F.expr("percentile(prob, 0.5)").alias("median_prob"), F.max("prob").alias("max_prob"), F.expr("percentile(rank, 0.5)").alias("median_rank"), F.avg((F.col("rank") == 0).cast("double")).alias("top1_share"))


def stop_stats(outputs: DataFrame, eos: int) -> DataFrame:
    """Of outputs (prompt_id, tokens): how many stopped at the end mark, and the median tokens up to it."""
    at = outputs.withColumn("_at", F.array_position("tokens", eos))
    return at.agg(F.count("*").alias("outputs"), F.sum((F.col("_at") > 0).cast("long")).alias("stopped"), F.avg((F.col("_at") > 0).cast("double")).alias("share"), F.expr("percentile(CASE WHEN _at > 0 THEN _at END, 0.5)").alias("median_tokens"))
