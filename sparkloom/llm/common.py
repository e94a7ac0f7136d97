"""Helpers shared by the operators: the shared folder, written tables, prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in a local session without it a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="sparkloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Texts can be long: no more than so many rows go to a Python worker at once."""
    now = int(spark.conf.get(_BATCH_ROWS, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(_BATCH_ROWS, str(rows))
    return spark


@contextmanager
def with_bounded_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """The same for what is written inside; afterwards the session is as it was."""
    before = spark.conf.get(_BATCH_ROWS, "10000")
    bounded_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/sparkloom/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Remove the written table that `df` reads, which nothing needs any more."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def join_hot(rows: DataFrame, side: DataFrame, key: str, count: str, most: int = 1000) -> DataFrame:
    """`rows` with the columns of `side` (one row a key), which says in `count` how many rows of `rows` have the key; rows without a
    key there go.

    Keys with more than 1/`most` of the rows could land in one task; there are fewer than `most` of them, whatever the rows, so
    these are broadcast, and the rest is shuffled.
    """
    total = side.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * most > total
    is_hot = side.where(hot).drop(count)
    held = rows.join(F.broadcast(is_hot), key)
    rest = rows.join(F.broadcast(is_hot.select(key)), key, "left_anti").join(side.where(~hot).drop(count), key)
    return held.select(*rest.columns).unionByName(rest)


#: Bits of a filter of ids, whatever their number.
ID_BITS = 1 << 25


def id_filter(wanted: DataFrame, *cols: str) -> bytes:
    """A bit for the hash of each row's `cols`, packed. A dozen parts come to the driver, whatever the size."""
    import numpy as np

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(ID_BITS, bool)
        for b in batches:
            bits[b.column(0).to_numpy() & (ID_BITS - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(ID_BITS // 8, np.uint8)
    for row in wanted.select(F.xxhash64(*cols).alias("h")).coalesce(12).mapInArrow(mark, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return out.tobytes()


def marked(h, bits):
    """Which of the hashes `h` have their bit in an `id_filter`."""
    import numpy as np

    h = h & (ID_BITS - 1)
    return (np.frombuffer(bits, np.uint8)[h >> 3] >> (7 - (h & 7)).astype(np.uint8)) & 1 == 1


def parted(df: DataFrame, named: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows of `df` that `named` (_id, _row: digest of the text) surely doesn't name, and the others: those that it names, and a few. Joins of
    the others alone don't send the rest through a shuffle, however many rows are named."""
    bits = df.sparkSession.sparkContext.broadcast(id_filter(named, "_id", "_row"))

    @F.pandas_udf("boolean")
    def is_marked(h):
        import pandas as pd

        return pd.Series(marked(h.to_numpy(), bits.value))

    perhaps = is_marked(F.xxhash64(F.col(id_col), F.xxhash64(text_col)))
    return df.where(~perhaps), df.where(perhaps)


def is_named(id_col: str, text_col: str) -> Column:
    """Whether a row is the one with `_id` and `_row`; null ids equal each other."""
    return F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_row"))


def drop_rows(df: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`df` without the rows that `gone`, a written table, names by id and digest of the text (_id, _row); null ids equal each other."""
    apart, perhaps = parted(df, gone, id_col, text_col)
    return apart.unionByName(perhaps.join(gone, is_named(id_col, text_col), "left_anti"))


def utf8(column: Column) -> Column:
    return column.cast("string").cast("binary")


def id_hash(column: Column) -> Column:
    """crc32 of the id as text; -1 where the id is null."""
    return F.coalesce(F.crc32(utf8(column)), F.lit(-1).cast("long"))


def running_total(df: DataFrame, order: list[str], value: str, out: str, what: str) -> DataFrame:
    """Adds `out`: the sum of `value` over all rows that stand before this one in `order`.

    A range sort deals the rows out; each partition sums alone, then gets the total of those before it. Only one
    number for each partition comes to the driver. `order` must be unique, else ties stand in any order.
    """
    spark = df.sparkSession
    ordered = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            v = b.column(b.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype("int64")
            ends = np.cumsum(v) + before
            if len(v):
                before = int(ends[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), part, "int32")), pa.array(ends - v)], names=[*b.schema.names, "_part", "_before"])

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    numbered = materialise(ordered.mapInArrow(number, f"{fields}, _part int, _before long"), what)
    totals = sorted(numbered.groupBy("_part").agg(F.sum(value).alias("n")).collect())
    starts, total = [], 0
    for part, n in totals:
        starts.append((part, total))
        total += n
    base = spark.createDataFrame(starts, "_part int, _start long")
    return numbered.join(F.broadcast(base), "_part").select(*df.columns, (F.col("_before") + F.col("_start")).alias(out))
