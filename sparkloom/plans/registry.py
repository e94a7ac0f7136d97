"""Queries and the SQL that says the same, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            key = name or f.__name__
            if key in self.queries:
                raise ValueError(f"{key} is there already")
            self.queries[key] = f
            if sql is not None:
                self.sql[key] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], columns: str) -> str:
    """The same literal rows in SQL."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v) if not isinstance(v, float) else f"{v!r}::DOUBLE"

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + f") AS t({columns}))"
