"""Named queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.shape import constants
from ..sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The star schema at one scale; each table is read when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._kept = spark, sf_dir, {}

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A sub-plan that a query uses several times, written at its first use and read at all."""
        if name not in self._kept:
            self._kept[name] = written(build())
        return self._kept[name]

    def constants(self, rows: list[tuple], schema: str) -> DataFrame:
        return constants(self.spark, rows, schema)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers f(tables) -> DataFrame under its name."""

    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap
