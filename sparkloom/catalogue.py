"""All queries of the library and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import corpus, io, records, reports, training

REGISTRIES = (corpus.R, io.R, training.R, reports.R, records.R)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for r in REGISTRIES for k, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for r in REGISTRIES for k, s in r.sql.items()}
