"""Connected components of an edge table, without collecting it: alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, materialise

MAX_ROUNDS = 64


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of `edges` (columns a, b): label is the component's smallest node.

    A large star hangs the larger neighbours of each node on its smallest neighbour, a small star does so with the smaller
    ones; edges never multiply, and components end as stars around their smallest node. The rounds needed grow with the
    logarithm of a component's size. Every round is written to the shared folder. A hub's edges are split by the
    adaptive skew join; broadcasting hubs instead makes twice as many plans, whose memory was measured to be more than it saves.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialise(now, "cc")
    mark = None
    for _ in range(MAX_ROUNDS):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, now = now, materialise(small, "cc")
        discard(before.sparkSession, before)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
