"""How far each file was read, merged over slots and free of any topology. -1 means done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DONE = -1
SCHEMA_VERSION = 2


def merge(progress: DataFrame) -> DataFrame:
    """(bucket, file_idx, progress): done wins, else the furthest. Commutative, associative and idempotent."""
    done = F.bool_or(F.col("progress") == DONE)
    return progress.groupBy("bucket", "file_idx").agg(F.when(done, DONE).otherwise(F.max("progress")).cast("int").alias("progress"))


def resume(items: DataFrame, merged: DataFrame, item_no: str = "item_no") -> DataFrame:
    """Items that are still to come; `item_no` counts a file's items from 1."""
    left = items.join(merged, ["bucket", "file_idx"], "left")
    return left.where(F.col("progress").isNull() | ((F.col("progress") != DONE) & (F.col(item_no) > F.col("progress")))).drop("progress")


def cut(emitted: DataFrame, sizes: DataFrame) -> DataFrame:
    """Progress after the items in `emitted` (bucket, file_idx, item_no), done where a file's last item is among them."""
    last = emitted.groupBy("bucket", "file_idx").agg(F.max("item_no").alias("p"))
    return last.join(sizes, ["bucket", "file_idx"]).select("bucket", "file_idx", F.when(F.col("p") >= F.col("n"), DONE).otherwise(F.col("p")).cast("int").alias("progress"))


def consumed(progress: DataFrame) -> DataFrame:
    """Items by bucket over saved slots; an item that two slots claim counts twice."""
    return progress.groupBy("bucket").agg(F.sum(F.greatest("progress", F.lit(0))).alias("items"))


def batch_cursors(items: DataFrame, by: list[str], order: str, cursor: list[str]) -> DataFrame:
    """Each batch's last item."""
    last = F.max_by(F.struct(*cursor), order).alias("c")
    return items.groupBy(*by).agg(last).select(*by, *[F.col(f"c.{c}").alias(c) for c in cursor])


def usable(states: DataFrame) -> DataFrame:
    """States of the supported schema version."""
    return states.where(F.col("schema_version") == SCHEMA_VERSION)


def restore_slots(states: DataFrame, world: int, workers: int) -> DataFrame:
    """(restore): whether counters and dry buckets can be taken over, which needs states and all of them with this topology."""
    same = F.coalesce(F.bool_and((F.col("world_size") == world) & (F.col("num_workers") == workers)), F.lit(False))
    return usable(states).agg(same.alias("restore"), F.count("*").alias("states"))


def commit(cursors: DataFrame, accumulation: int, *, by: list[str], order: str) -> DataFrame:
    """(by..., state, cursor columns): each slot's last cursor that belongs to a whole optimizer step (committed), and the last one after it, if any
    (pending). `order` counts the micro steps of all slots from 0; a step is made of `accumulation` of them, so what came after the last whole step was
    never trained on and must be read again."""
    seen = cursors.agg(F.coalesce(F.max(order) + 1, F.lit(0)).alias("_seen"))
    # One number, joined to every row.
    c = cursors.join(F.broadcast(seen)).withColumn("state", F.when(F.col(order) < F.col("_seen") - F.col("_seen") % accumulation, "committed").otherwise("pending")).drop("_seen")
    rest = [x for x in cursors.columns if x not in (*by, order)]
    last = F.max_by(F.struct(order, *rest), order).alias("c")
    return c.groupBy(*by, "state").agg(last).select(*by, "state", *[F.col(f"c.{x}").alias(x) for x in (order, *rest)])
