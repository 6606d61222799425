"""Reshaping: long and wide, dense grids, ragged unions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import NumericType


def melt(df: DataFrame, keys: list[str], values: list[str], name: str = "stat", value: str = "value") -> DataFrame:
    return df.unpivot(keys, values, name, value)


def widen(df: DataFrame, keys: list[str], name: str, value: str, names: list[str], how=F.max) -> DataFrame:
    """One pivot with its values given, so that no job looks for them."""
    return df.groupBy(*keys).pivot(name, names).agg(how(value))


def densify(df: DataFrame, left: DataFrame, right: DataFrame, keys: list[str], fill: dict) -> DataFrame:
    """All combinations of two small lists of keys, with what df has for them."""
    out = left.crossJoin(right).join(df, keys, "left")
    return out.fillna(fill)


def union_ragged(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.toDF(*(c if c in keep else prefix + c for c in df.columns))


def explode_delimited(df: DataFrame, column: str, sep: str, out: str) -> DataFrame:
    return df.withColumn(out, F.explode(F.split(column, sep)))


def matching(df: DataFrame, pattern: str, keep: list[str]) -> DataFrame:
    """keep and the columns whose names match."""
    return df.select(*keep, *(c for c in df.columns if c not in keep and re.search(pattern, c)))


def sum_numeric(df: DataFrame, by: list[str]) -> DataFrame:
    """Sums of all numeric columns."""
    names = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in by]
    return df.groupBy(*by).agg(*(F.sum(c).alias(c) for c in names))


def constants(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of constants as VALUES, whose size the planner knows; a table made from Python rows counts as of unknown size and is never broadcast."""
    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v)

    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    names = [n.strip("`") for n, _ in fields]
    values = ", ".join(f"({', '.join(map(literal, r))})" for r in rows)
    return spark.sql(f"SELECT {', '.join(f'CAST(c{i} AS {k}) AS `{n}`' for i, (n, (_, k)) in enumerate(zip(names, fields)))} FROM VALUES {values} AS v({', '.join(f'c{i}' for i in range(len(fields)))})")
