"""Small JSON states: replaced as a whole by the driver, read tolerantly as tables."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run's status record, and the training state beside a checkpoint: fixed names.
RUN = "status string, pid int, started_at string, updated_at string, global_step long, max_steps long, loss double, learning_rate double, tokens_trained long, tokens_per_sec double, error string, latest_checkpoint string, checkpoint string, config_path string"
TRAINER = "schema_version int, step long, tokens_trained long, config_hash string, model_arch_hash string, curriculum struct<phase_idx:int,phase_tokens_consumed:long,current_mix:map<string,double>>, timing struct<wallclock_seconds_elapsed:double,last_save_duration_seconds:double,saved_at:string>, metrics struct<loss:double,learning_rate:double,grad_norm:double,tokens_per_sec:double>, lineage struct<resumed_from:string,is_shutdown_checkpoint:boolean>"
TRAINER_VERSION = 1


def replace_state(path: str, data: dict, *, durable: bool = False) -> None:
    """Readers see the old state or the new one, never a part; `durable` also outlives a power cut. A sibling file gets the whole text first and then
    the name, which a file system does at once."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    sibling = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    text = json.dumps(data, indent=2) + "\n"
    try:
        sibling.write_text(text)
        if durable:
            with sibling.open("rb") as f:
                os.fsync(f.fileno())
        sibling.replace(target)
    finally:
        sibling.unlink(missing_ok=True)


def _objects(spark: SparkSession, paths: list[str] | str, schema: str) -> DataFrame:
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    bad = f"{schema}, _bad string"
    j = raw.withColumn("j", F.from_json("value", bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowNonNumericNumbers": "true"}))
    return j.where(F.col("j").isNotNull() & F.col("j._bad").isNull()).select("path", "j.*").drop("_bad")


def read_runs(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """A row for each readable run state; corrupt files give none, unknown keys are dropped, the older name of the newest checkpoint is taken over."""
    r = _objects(spark, paths, RUN)
    return r.withColumn("latest_checkpoint", F.coalesce("latest_checkpoint", "checkpoint")).drop("checkpoint")


def read_trainers(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """A row for each readable training state of the supported version."""
    t = _objects(spark, paths, TRAINER)
    return t.where(F.coalesce("schema_version", F.lit(TRAINER_VERSION)) == TRAINER_VERSION)


def unreadable(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path) of training states that can't be read, or not in the supported version."""
    every = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path")).distinct()
    return every.join(read_trainers(spark, paths).select("path"), "path", "left_anti")


def write_slots(states: DataFrame, path: str) -> None:
    """Progress and counters of all slots, a row for each."""
    states.write.mode("overwrite").parquet(path)


def read_slots(spark: SparkSession, path: str, single: str | None = None) -> DataFrame:
    """All slots' states, or the older single file's where the folder isn't there."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if single is None or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.read.parquet(single)
