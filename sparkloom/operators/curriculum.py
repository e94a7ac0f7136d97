"""Phases of a weighted mix: shares, demand, shortfall and switching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.order import running_sum


def normalise(mix: DataFrame) -> DataFrame:
    """Weights of a phase that sum to 1. Phases without length, weight, or with a negative weight are an error when they are read."""
    w = Window.partitionBy("phase_idx")
    total = F.sum("weight").over(w)
    bad = (F.col("duration_tokens") <= 0) | (F.min("weight").over(w) < 0) | (total <= 0)
    share = F.when(bad, F.raise_error(F.concat(F.lit("phase "), F.col("phase_idx").cast("string"), F.lit(" needs a length and weights that are not negative and sum above 0"))).cast("double")).otherwise(F.col("weight") / total)
    return mix.withColumn("weight", share)


def demand(mix: DataFrame) -> DataFrame:
    """Tokens that each phase takes from a bucket, and all phases up to it."""
    d = mix.withColumn("demand", F.col("weight") * F.col("duration_tokens"))
    return d.withColumn("cumulative", F.sum("demand").over(Window.partitionBy("bucket").orderBy("phase_idx").rowsBetween(Window.unboundedPreceding, 0)))


def shortfall(mix: DataFrame, available: DataFrame, allow_exhaustion: bool = False) -> DataFrame:
    """(bucket, demand, available, shortfall, severity) where all phases together take more than there is."""
    total = mix.groupBy("bucket").agg(F.sum(F.col("weight") * F.col("duration_tokens")).alias("demand"))
    d = total.join(available.select("bucket", F.col("tokens").alias("available")), "bucket", "left").fillna(0, ["available"])
    short = d.where(F.col("demand") > F.col("available"))
    return short.select("bucket", "demand", "available", (F.col("demand") - F.col("available")).alias("shortfall"), F.lit("WARNING" if allow_exhaustion else "BUDGET").alias("severity"))


def unknown_buckets(mix: DataFrame, present: DataFrame) -> DataFrame:
    """(bucket, finding): named but not there (unknown), there but never named (unused)."""
    named, there = mix.select("bucket").distinct(), present.select("bucket").distinct()
    return named.join(there, "bucket", "left_anti").withColumn("finding", F.lit("unknown")).unionByName(there.join(named, "bucket", "left_anti").withColumn("finding", F.lit("unused")))


def phase_of_steps(steps: DataFrame, durations: list[int]) -> DataFrame:
    """(step, tokens, phase_idx, phase_tokens): a phase ends with the step that reaches its length; the next begins at 0, so what goes beyond is
    not carried over; the last phase has no end. The loop is over phases, with one look at the running sum for each."""
    run = running_sum(steps.select("step", "tokens"), "step", "tokens", "_t")
    starts: list[tuple[int, int | None]] = [(0, None)]
    for need in durations[:-1]:
        base, after = starts[-1]
        left = run if after is None else run.where(F.col("step") > after)
        hit = left.where(F.col("_t") >= base + need).agg(F.min_by("_t", "step"), F.min("step")).first()
        if hit[1] is None:
            break
        starts.append((hit[0], hit[1]))
    phase, base = F.lit(0), F.lit(0)
    for i, (b, after) in enumerate(starts[1:], 1):
        phase, base = F.when(F.col("step") > after, i).otherwise(phase), F.when(F.col("step") > after, b).otherwise(base)
    return run.select("step", "tokens", phase.alias("phase_idx"), (F.col("_t") - base).cast("long").alias("phase_tokens"))


def loop_tokens(batch: Column, accumulation: Column, world: Column, length: Column, steps: Column) -> Column:
    return (batch * accumulation * world * length).cast("long") * steps


def budget_ratio(plan: DataFrame) -> DataFrame:
    """`plan` with loop_tokens, ratio and whether it is outside 0.95 to 1.05 of the demand."""
    p = plan.withColumn("loop_tokens", loop_tokens(*[F.col(c) for c in ("batch", "accumulation", "world", "length", "steps")]))
    p = p.withColumn("ratio", F.col("loop_tokens") / F.col("demand"))
    return p.withColumn("mismatch", (F.col("ratio") < 0.95) | (F.col("ratio") > 1.05))


def exhaustion_code(dry: DataFrame, ids: DataFrame, known: list[str]) -> DataFrame:
    """Over all slots: the highest id of a newly dry bucket plus 1, or 0."""
    new = dry.where(~F.col("bucket").isin(known)).join(ids, "bucket")
    return new.agg(F.coalesce(F.max("bucket_id") + 1, F.lit(0)).cast("int").alias("code"))


def renormalise(mix: DataFrame, dry: DataFrame) -> DataFrame:
    """`mix` without the buckets of `dry`, weights of a phase summing to 1 again; a phase whose buckets are all dry has no rows."""
    left = mix.join(dry.select("bucket").distinct(), "bucket", "left_anti").where("weight > 0")
    return left.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("phase_idx")))


def exhaustion_policy(dry: DataFrame, ids: DataFrame, known: list[str], allow: bool) -> DataFrame:
    """(action, reason) after a step: `halt` for the newly dry bucket of the highest id, the same on every rank, unless buckets may run dry: then
    `renormalise`; `continue` where nothing is new."""
    code = exhaustion_code(dry, ids, known)
    named = code.join(ids, F.col("code") == F.col("bucket_id") + 1, "left")
    new = F.col("code") > 0
    return named.select(F.when(~new, "continue").otherwise("renormalise" if allow else "halt").alias("action"), F.when(new & F.lit(not allow), F.concat(F.lit("bucket_exhausted:"), "bucket")).alias("reason"))
