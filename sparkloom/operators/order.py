"""Order and place as columns: files, lines, shuffles, slots, batches. Nothing here depends on Spark's partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_index(df: DataFrame, bucket: str, file: str, out: str = "file_idx") -> DataFrame:
    """Rank of a file's name within its bucket, from 0. Ranks come from the distinct names, which are few, and are joined back."""
    ranks = df.select(bucket, file).distinct().withColumn(out, (F.dense_rank().over(Window.partitionBy(bucket).orderBy(file)) - 1).cast("int"))
    return df.join(ranks.withColumnsRenamed({bucket: "_b", file: "_f"}), F.col(bucket).eqNullSafe(F.col("_b")) & F.col(file).eqNullSafe(F.col("_f")), "left").drop("_b", "_f")


def bucket_ids(df: DataFrame, bucket: str = "bucket") -> DataFrame:
    """(bucket, bucket_id) in order of name."""
    return df.select(bucket).distinct().withColumn("bucket_id", (F.row_number().over(Window.orderBy(bucket)) - 1).cast("int"))


#: Parts that a group's rows are ranked in.
PARTS = 64


def _even_parts(df: DataFrame, lead: str) -> Column:
    """A number or text that grows with `lead`: by its quantiles over all rows, of which the driver gets one list, or by a text's first two letters."""
    kind = df.schema[lead].dataType
    if not isinstance(kind, T.NumericType):
        return F.substring(F.col(lead).cast("string"), 1, 2)
    cuts = df.agg(F.percentile_approx(lead, [i / PARTS for i in range(1, PARTS)])).first()[0] or []
    part = F.lit(0)
    for i, cut in enumerate(sorted(set(cuts)), 1):
        part = F.when(F.col(lead) > F.lit(cut), i).otherwise(part)
    return part


def positions(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Place of a row in its group, from 0; `order` must be unique in a group, else ties stand in any order. A null stands first.

    A group may hold all rows, so it isn't ranked in one task: the first column of `order` cuts it into even parts, and a row's place is its rank
    in its part plus the sizes of the parts before.
    """
    return _ranked_by_parts(df.withColumn("_p", _even_parts(df, order[0])), group, order, df.columns, out)


def _ranked_by_parts(parted: DataFrame, group: list[str], order: list[str], columns: list[str], out: str) -> DataFrame:
    """Rank by `order` in each group's parts `_p`, plus the sizes of the parts before; these are a few numbers for each group."""
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    names = {g: f"_g{i}" for i, g in enumerate(group)} | {"_p": "_q"}
    sizes = parted.groupBy(*group, "_p").agg(F.count("*").alias("_c"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c").withColumnsRenamed(names)
    ranked = parted.withColumn("_at", F.row_number().over(Window.partitionBy(*group, "_p").orderBy(*order)) - 1)
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in names.items()]
    return ranked.join(starts, same).withColumn(out, (F.col("_at") + F.col("_start")).cast("long")).select(*[c for c in columns if c != out], out)


def running_sum(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """The sum of `value` over all rows up to and with this one in the order of `order`, which must be unique. By even parts, as places are."""
    parted = df.withColumn("_p", _even_parts(df, order))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over PARTS rows
    starts = parted.groupBy("_p").agg(F.sum(value).alias("_s")).select(F.col("_p").alias("_q"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    own = F.sum(value).over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return parted.withColumn("_own", own).join(F.broadcast(starts), F.col("_p").eqNullSafe(F.col("_q"))).select(*[c for c in df.columns if c != out], (F.col("_start") + F.col("_own")).alias(out))


def shuffle_key(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]).cast("binary"))


def shuffled_positions(df: DataFrame, group: list[str], ids: list[str], seed: int = 42, out: str = "doc_pos", parts: int = 2) -> DataFrame:
    """A permutation of each group that depends on seed and names only. The key has the file but no epoch: every pass is the same.

    A group may hold a large share of all rows, so it isn't ranked in one task: the first `parts` digits of the md5 cut it into even parts, a
    row's place is its rank in its part plus the sizes of the parts before, and these are a few numbers for each group.
    """
    keyed = df.withColumn("_k", shuffle_key(seed, *group[-1:], *ids)).withColumn("_p", F.substring("_k", 1, parts))
    return _ranked_by_parts(keyed, group, ["_k", *ids], df.columns, out)


def legacy_permutation(seed: int, file_idx: int, n: int) -> list[int]:
    """The permutation of numpy's legacy generator, seeded by the pair; for runs that must repeat an older order."""
    import numpy as np

    order = np.arange(n)
    np.random.RandomState(hash((seed, file_idx)) % (2**31)).shuffle(order)
    return order.tolist()


def legacy_positions(df: DataFrame, group: list[str], file_idx: str, ids: list[str], seed: int = 42, out: str = "doc_pos") -> DataFrame:
    """`shuffled_positions` by the legacy permutation: only counts of rows travel to the generator, one row for each file."""
    ranked = positions(df, group, ids, "_at")
    kinds = dict(ranked.dtypes)
    counts = ranked.groupBy(*group).agg(F.count("*").alias("_n"))

    def make(batches):
        import pyarrow as pa

        for b in batches:
            t = pa.Table.from_batches([b]).to_pylist()
            for r in t:
                order = legacy_permutation(seed, r[file_idx], r["_n"])
                back = {c: pa.array([r[c]] * r["_n"], b.schema.field(c).type) for c in group}
                yield pa.RecordBatch.from_arrays([*back.values(), pa.array(order, pa.int64()), pa.array(range(r["_n"]), pa.int64())], names=[*group, "_at", out])

    schema = ", ".join(f"{g} {kinds[g]}" for g in group) + f", _at long, {out} long"
    return ranked.join(counts.mapInArrow(make, schema), [*group, "_at"]).drop("_at")


def line_slots(line: str, world: int, workers: int) -> Column:
    """Slot that reads a line when lines are dealt out in turn; slot = rank * workers + worker."""
    return (F.col(line) % (world * workers)).cast("int")


def range_slot(index: str | Column, n: Column | int, parts: int) -> Column:
    """Part of a contiguous range split, the remainder to the last part."""
    index, n = (F.col(index) if isinstance(index, str) else index), (n if isinstance(n, Column) else F.lit(n))
    per = F.floor(n / parts)
    return F.when(per == 0, parts - 1).otherwise(F.least(F.floor(index / F.greatest(per, F.lit(1))), F.lit(parts - 1))).cast("int")


def assign_longest_first(shards: DataFrame, slots: int, *, bucket: str = "bucket", index: str = "file_idx", size: str = "tokens") -> DataFrame:
    """(bucket, file_idx, slot): shards by size, largest first (ties: higher index), each to the lightest slot (ties: lower number).
    A shard is a row of a small table; a bucket's shards are one group."""
    kinds = dict(shards.dtypes)

    def deal(t):
        import heapq

        import pyarrow as pa

        rows = sorted(zip(t.column(size).to_pylist(), t.column(index).to_pylist(), range(t.num_rows), strict=True), reverse=True)
        load, out = [(0, s) for s in range(slots)], [0] * t.num_rows
        for n, _, i in rows:
            w, s = heapq.heappop(load)
            out[i] = s
            heapq.heappush(load, (w + n, s))
        return t.select([bucket, index]).append_column("slot", pa.array(out, pa.int32()))

    return shards.select(bucket, index, size).groupBy(bucket).applyInArrow(deal, f"{bucket} {kinds[bucket]}, {index} {kinds[index]}, slot int")


def clamp_workers(requested: Column, least_shards: Column, world: Column) -> Column:
    """Workers of a rank so that each has a shard; 0 stays 0; null where there are fewer shards than ranks."""
    most = F.greatest(F.lit(1), F.floor(least_shards / world))
    return F.when(least_shards < world, None).when(requested == 0, 0).otherwise(F.least(requested, most)).cast("int")


def batches(df: DataFrame, slot: list[str], order: str, size: int, drop_last: bool) -> DataFrame:
    """Adds batch_idx; `order` counts a slot's items from 0."""
    df = df.withColumn("batch_idx", F.floor(F.col(order) / size).cast("long"))
    if not drop_last:
        return df
    return df.withColumn("_c", F.count("*").over(Window.partitionBy(*slot, "batch_idx"))).where(F.col("_c") == size).drop("_c")


def loader_order(batches_: DataFrame, rank: list[str], worker: str, batch: str, out: str = "place") -> DataFrame:
    """Place of each batch (rank..., worker, batch) in what a rank's loader gives: one batch of each worker in turn, workers that are done left out."""
    return positions(batches_, rank, [batch, worker], out)
