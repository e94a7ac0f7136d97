"""Checkpoints and run states as tables."""

from __future__ import annotations

from json import dumps, loads

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.tokens import step_of_name

PARTIAL, FINAL, SHUTDOWN = ".partial", "final", "-shutdown"


def list_checkpoints(found: DataFrame) -> DataFrame:
    """(name, step, place) of complete checkpoints (name, step, has_state); by step, `final` last whatever its step."""
    ok = found.where(F.col("has_state") & ~F.col("name").endswith(PARTIAL) & F.col("step").isNotNull())
    order = Window.orderBy((F.col("name") == FINAL).cast("int"), "step", "name")
    return ok.select("name", "step", (F.row_number().over(order) - 1).cast("int").alias("place"))


def parsed_steps(names: DataFrame) -> DataFrame:
    return names.withColumn("parsed", step_of_name(F.col("name")))


def retention(listed: DataFrame, keep_last: int | None, milestone: int | None) -> DataFrame:
    """`listed` with `keep`. The final one, the newest shutdown and the newest regular one always stay; then the last k regular ones and those
    at multiples. Without either rule all stay."""
    if keep_last is None and milestone is None:
        return listed.withColumn("keep", F.lit(True))
    kind = F.when(F.col("name") == FINAL, "final").when(F.col("name").endswith(SHUTDOWN), "shutdown").otherwise("regular")
    newest = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("place")))
    k = listed.withColumn("kind", kind).withColumn("_n", newest)
    last = F.when(F.col("kind") == "regular", F.col("_n") <= max(keep_last or 0, 1)).otherwise(F.col("_n") == 1)
    regular_mark = (F.col("kind") == "regular") & (F.col("step") > 0) & (F.col("step") % (milestone or 1) == 0)
    keep = (F.col("kind") == "final") | last | (regular_mark if milestone else F.lit(False))
    return k.withColumn("keep", keep).drop("kind", "_n")


def resume_from(listed: DataFrame, hint: str) -> DataFrame:
    """(name): the newest for `auto`, none for `scratch`, else the one named, which must be there."""
    if hint == "scratch":
        return listed.select("name").limit(0)
    if hint == "auto":
        return listed.agg(F.max_by("name", "place").alias("name")).where("name IS NOT NULL")
    one = listed.where(F.col("name") == hint).select("name")
    missing = F.raise_error(F.lit(f"resume path does not exist or has no state: {hint}")).cast("string")
    return one.agg(F.max("name").alias("name")).select(F.when(F.col("name").isNull(), missing).otherwise(F.col("name")).alias("name"))


def status_line(status: Column, alive: Column, pid: Column, has_checkpoint: Column) -> Column:
    pid = pid.cast("string")
    return (
        F.when(status.isNull() & has_checkpoint, "NO RUN STATE (checkpoint only)")
        .when(status.isNull(), "EMPTY")
        .when((status == "running") & ~alive, F.concat(F.lit("CRASHED (PID "), pid, F.lit(", exited)")))
        .when(status == "running", F.concat(F.lit("RUNNING (PID "), pid, F.lit(")")))
        .when(status == "error", F.concat(F.lit("ERROR (PID "), pid, F.when(alive, ", still alive)").otherwise(", exited)")))
        .when(status == "completed", "COMPLETED")
        .when(status == "stopped", "STOPPED")
        .when(status == "halted", "HALTED (bucket exhausted; needs attention)")
        .otherwise(F.upper(status))
    )


def progress_rows(states: DataFrame, trainers: DataFrame) -> DataFrame:
    """(run, step, max_steps, pct, loss, tokens): the run state where there is one, else the checkpoint's."""
    s = states.select("run", F.lit(True).alias("_s"), F.col("step").alias("s_step"), F.col("max_steps").alias("s_max"), F.col("loss").alias("s_loss"), F.col("tokens").alias("s_tokens"))
    t = trainers.select("run", F.lit(True).alias("_t"), F.col("step").alias("t_step"), F.col("loss").alias("t_loss"), F.col("tokens").alias("t_tokens"))
    j = s.join(t, "run", "full")
    pick = lambda a, b, zero: F.when(F.col("_s"), F.col(a)).when(F.col("_t"), F.col(b)).otherwise(zero)
    most = F.when(F.col("_s"), F.col("s_max")).otherwise(0)
    step = pick("s_step", "t_step", 0)
    pct = F.when(most > 0, F.round(step / most * 100, 1))
    return j.select("run", step.alias("step"), most.alias("max_steps"), pct.alias("pct"), pick("s_loss", "t_loss", float("inf")).alias("loss"), pick("s_tokens", "t_tokens", 0).alias("tokens"))


def shutdown_status(reason: Column) -> Column:
    return F.when(reason.startswith("bucket_exhausted"), "halted").when(reason == "completed", "completed").when(reason == "error", "error").otherwise("stopped")


def orchestrator_decision(status: Column) -> Column:
    """What a job chain does after a run: nothing more, again, or leave it to a person."""
    return F.when(status == "completed", "done").when(status.isin("halted", "error"), "manual").when(status.isin("stopped", "running"), "resubmit").otherwise("start")


def scratch_guard(listed: DataFrame, hint: str, force: bool = False, shown: int = 5) -> DataFrame:
    """(allowed, clobbered): whether a run may begin from scratch, which would lose the checkpoints that are there; the first of their names."""
    names = F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), 1, shown), ", ")
    guarded = hint == "scratch" and not force
    return listed.agg(F.count("*").alias("n"), names.alias("names")).select((F.lit(not guarded) | (F.col("n") == 0)).alias("allowed"), F.when(F.lit(guarded) & (F.col("n") > 0), F.col("names")).alias("clobbered"))


def canonical_hash(json: Column) -> Column:
    """Name of a configuration: the first 16 hex digits of the SHA-256 of its JSON with keys in order at every level and a space after commas and
    colons, whatever the text's own order and spaces. Text that is no JSON has none."""

    @F.pandas_udf("string")
    def same(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else dumps(loads(t), sort_keys=True)
            except ValueError:
                return None

        return texts.map(one)

    return F.concat(F.lit("sha256:"), F.substring(F.sha2(same(json).cast("binary"), 256), 1, 16))
