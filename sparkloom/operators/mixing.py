"""Several ordered streams into one: in turn, one after the other, or by weighted draws.

A stream's items carry their number in it (`ord`, from 0). The place of an item in the mix follows from stream lengths or from
a small table of draws, so items are joined or mapped, never sorted into one partition.
"""

from __future__ import annotations

import random
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.windows import stable_draw


def lengths(items: DataFrame, stream: str, ord_: str = "ord") -> dict:
    """Items of each stream; there are as many rows as streams."""
    return {r[0]: r[1] for r in items.groupBy(stream).agg((F.max(ord_) + 1).alias("n")).collect()}


def round_robin(items: DataFrame, stream: str, sizes: dict, ord_: str = "ord", out: str = "place") -> DataFrame:
    """One item of each stream in turn, in order of name; an exhausted stream drops out. An item stands behind what every stream gave
    in full rounds before, and behind the streams before its own that still give one in this round."""
    at = F.col(ord_)
    names = sorted(sizes)
    before = sum((F.least(at, F.lit(sizes[n])) for n in names), F.lit(0))
    same = F.lit(0).cast("long")
    for i, own in enumerate(names):
        ahead = sum((F.when(F.lit(sizes[n]) > at, 1).otherwise(0) for n in names[:i]), F.lit(0))
        same = F.when(F.col(stream) == own, ahead).otherwise(same)
    return items.withColumn(out, (before + same).cast("long"))


def chain(items: DataFrame, stream: str, sizes: dict, ord_: str = "ord", out: str = "place") -> DataFrame:
    """Streams one after the other, in order of name."""
    start = F.lit(None).cast("long")
    names = sorted(sizes)
    for n, a in zip(names, accumulate([0, *[sizes[n] for n in names]]), strict=False):
        start = F.when(F.col(stream) == n, a).otherwise(start)
    return items.withColumn(out, (start + F.col(ord_)).cast("long"))


def pick(u: Column, weights: dict[str, float]) -> Column:
    """The name whose share of the weights holds u in [0, 1), names in order."""
    names, total, at, out = sorted(n for n, w in weights.items() if w > 0), sum(weights.values()), 0.0, None
    for n in names[:-1]:
        at += weights[n]
        out = (F if out is None else out).when(u < at / total, n)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def draws(counters: DataFrame, weights: dict[str, float], seed: int = 42) -> DataFrame:
    """(slot, counter, bucket, k): a bucket for each counter of a slot, and how often the slot drew it before. Depends on seed, slot and
    counter only, so any part of the stream can be made again."""
    d = counters.withColumn("bucket", pick(stable_draw(F.lit(seed), F.col("slot"), F.col("counter")), weights))
    return d.withColumn("k", (F.row_number().over(Window.partitionBy("slot", "bucket").orderBy("counter")) - 1).cast("long"))


def uniform(buckets: list[str]) -> dict[str, float]:
    """Equal weights, for a random interleave without preference."""
    return dict.fromkeys(sorted(buckets), 1.0)


def join_draws(drawn: DataFrame, items: DataFrame) -> DataFrame:
    """Items (slot, bucket, ord, ...) at the counters that drew them."""
    return drawn.join(items.withColumnRenamed("ord", "k"), ["slot", "bucket", "k"])


#: Fixed multipliers of seed, worker and counter.
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def counter_random(seed: int, worker: int, counter: int) -> random.Random:
    """A Mersenne Twister that only these three numbers seed."""
    a, b, c = (x * m for x, m in zip((seed, worker, counter), _MULTIPLIERS, strict=True))
    return random.Random((a ^ b ^ c) % 2**64)


def interleave_slot(sizes: dict[str, int], weights: dict[str, float], worker: int, seed: int = 42, counter: int = 0, gone: tuple[str, ...] = (), most: int | None = None):
    """(counter, bucket, k) until all buckets are dry. Drawing a dry bucket takes it out, and the same counter draws again among the rest."""
    left = {n: weights[n] for n in sorted(sizes) if weights.get(n, 0) > 0 and n not in gone}
    given = dict.fromkeys(left, 0)
    while left and (most is None or counter < most):
        name = counter_random(seed, worker, counter).choices(list(left), weights=list(left.values()), k=1)[0]
        if given[name] >= sizes[name]:
            del left[name]
            continue
        yield counter, name, given[name]
        given[name] += 1
        counter += 1


def weighted_interleave(queues: DataFrame, weights: dict[str, float], seed: int = 42) -> DataFrame:
    """(slot, worker, counter, bucket, k) from queue sizes (slot, worker, bucket, n), with exhaustion: a slot's draws are sequential and
    read sizes only; items join on (slot, bucket, k)."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        worker, slot = rows[0]["worker"], rows[0]["slot"]
        out = list(interleave_slot({r["bucket"]: r["n"] for r in rows}, weights, worker, seed))
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        n = len(out)
        return pa.table({"slot": pa.array([slot] * n, pa.int32()), "worker": pa.array([worker] * n, pa.int32()), "counter": pa.array(cols[0], pa.int64()), "bucket": pa.array(cols[1], pa.string()), "k": pa.array(cols[2], pa.int64())})

    slim = queues.select(F.col("slot").cast("int"), F.col("worker").cast("int"), "bucket", F.col("n").cast("long"))
    return slim.groupBy("slot").applyInArrow(run, "slot int, worker int, counter long, bucket string, k long")
