"""JSON lines in and out, plain or gzipped, with line numbers that don't need whole files in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.tokens import strip

#: Input names: shards are made from both, the streaming path reads plain files only.
BOTH, PLAIN = "*.{jsonl,jsonl.gz}", "*.jsonl"


class NoInput(FileNotFoundError):
    """There is nothing to read; commands end with this code."""

    exit_code = 1


def find_inputs(spark: SparkSession, path: str, pattern: str = BOTH) -> list[str]:
    """The input files under `path`, sorted; NoInput if there are none. Only names are read, through Spark, so any store will do."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path").distinct().orderBy("path")
    names = [r.path for r in found.collect()]
    if not names:
        raise NoInput(f"no {pattern} under {path}")
    return names


def read_lines(spark: SparkSession, path: str, pattern: str = BOTH) -> DataFrame:
    """(file, value) of each line. Without numbers, so large files split into many tasks."""
    return spark.read.option("pathGlobFilter", pattern).text(path).select(F.col("_metadata.file_name").alias("file"), "value")


def read_numbered(spark: SparkSession, path: str, pattern: str = BOTH) -> DataFrame:
    """(file, line_num, value), lines from 1. Files may be split: lines are numbered inside each part, and a part begins where the counts of
    the parts before it end. Both passes read the same parts; there is one count for each."""
    df = spark.read.option("pathGlobFilter", pattern).text(path)
    parts = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for b in batches:
            nums = []
            for key in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                n = n + 1 if key == last else 1
                last = key
                nums.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nums, pa.int64())], names=["p", "file", "at", "value", "n"])

    numbered = parts.mapInArrow(number, "p string, file string, at long, value string, n long")
    before = Window.partitionBy("p").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy("p", "at").agg(F.max("n").alias("c")).select("p", "at", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    return numbered.join(starts, ["p", "at"]).select("file", (F.col("start") + F.col("n")).alias("line_num"), "value")


def estimate_lines(spark: SparkSession, path: str, pattern: str = PLAIN, first: int = 1000) -> DataFrame:
    """(file, bytes, lines): lines of each file guessed from the size of its first ones. An estimate by design, of the first lines only; empty files have no row."""
    n = read_numbered(spark, path, pattern).where(F.col("line_num") <= first)
    seen = n.groupBy("file").agg(F.count("*").alias("c"), F.sum(F.octet_length("value") + 1).alias("b"))
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    return sizes.join(seen, "file", "left").select("file", "bytes", F.coalesce(F.round(F.col("bytes") * F.col("c") / F.col("b")), F.lit(0)).cast("long").alias("lines"))


def texts(lines: DataFrame, *, least_chars: int = 200, streaming: bool = False) -> DataFrame:
    """`lines` with text and status: ok, short, missing or bad. Blank lines go. For shards, a missing text is an empty one and is counted unstripped; on
    the streaming path it is missing, and text is stripped first."""
    rows = lines.where(strip("value") != "")
    j = F.from_json("value", "text string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.withColumn("_j", j)
    bad = F.col("_j").isNull() | F.col("_j._bad").isNotNull()
    text = F.col("_j.text")
    text = strip(text) if streaming else F.coalesce(text, F.lit(""))
    rows = rows.withColumn("text", text)
    status = F.when(bad, "bad").when(F.col("text").isNull(), "missing").when(F.length("text") < least_chars, "short").otherwise("ok")
    return rows.withColumn("status", status).drop("_j")


def stream_texts(spark: SparkSession, path: str, pattern: str = PLAIN, *, least_chars: int = 200) -> DataFrame:
    """The streaming path: lines of files as they come, with text and status. There must be a file to begin with."""
    find_inputs(spark, path, pattern)
    return texts(spark.readStream.option("pathGlobFilter", pattern).text(path), least_chars=least_chars, streaming=True)


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_num, value, prompt); raises at the first line that is no object with a prompt, by file and line."""
    rows = read_numbered(spark, path, "*").where(strip("value") != "")
    v = F.try_parse_json("value")
    rows = rows.withColumn("_v", v).withColumn("_k", F.json_object_keys("value"))
    problem = F.when(F.col("_v").isNull(), "invalid JSON").when(F.col("_k").isNull(), "expected a JSON object").when(~F.array_contains("_k", "prompt"), "missing required key 'prompt'")
    rows = rows.withColumn("_e", problem)
    first = rows.where("_e IS NOT NULL").orderBy("file", "line_num").select("file", "line_num", "_e").first()
    if first is not None:
        raise ValueError(f"{first[0]}:{first[1]}: {first[2]}")
    return rows.select("file", "line_num", "value", F.get_json_object("value", "$.prompt").alias("prompt"))


def write_lines(df: DataFrame, path: str, order: list[str], *, one_file: bool = False) -> None:
    """A JSON object for each row, in the given order over the sorted file names; letters outside ASCII stay as they are. `one_file` puts all into one
    task and file, which suits small results that a person reads."""
    columns = [c for c in df.columns if c not in order] or df.columns
    rows = df.orderBy(*order).select(F.to_json(F.struct(*columns)).alias("value"))
    (rows.coalesce(1) if one_file else rows).write.text(path)
