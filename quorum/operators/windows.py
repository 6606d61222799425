"""Window operators with explicit tie-breaks; null values get no rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranges import quantiles


def _by(keys) -> list:
    return [keys] if isinstance(keys, str) else list(keys)


def rank(kind: str, value: str, by, desc: bool = True, tie=()) -> Column:
    """dense, min, ordinal or average rank of a value in its group; null stays null."""
    order = F.col(value).desc_nulls_last() if desc else F.col(value).asc_nulls_last()
    w = Window.partitionBy(*_by(by)).orderBy(order)
    if kind == "dense":
        out = F.dense_rank().over(w)
    elif kind == "min":
        out = F.rank().over(w)
    elif kind == "ordinal":
        out = F.row_number().over(Window.partitionBy(*_by(by)).orderBy(order, *_by(tie)))
    else:
        out = F.rank().over(w) + (F.count("*").over(Window.partitionBy(*_by(by), value)) - 1) / 2.0
    return F.when(F.col(value).isNotNull(), out)


def subset_rank(value: str, mask: Column, by, desc: bool = True) -> Column:
    """Rank among the rows of the mask only; others get none."""
    order = F.col(value).desc_nulls_last() if desc else F.col(value).asc_nulls_last()
    keep = F.coalesce(mask & F.col(value).isNotNull(), F.lit(False))
    return F.when(keep, F.rank().over(Window.partitionBy(*_by(by), keep).orderBy(order)))


def trailing_mean(value: str, by, order, k: int, current: bool = False, least: int = 1) -> Column:
    """Mean of the last k rows, without the current one unless asked; null below `least` values."""
    w = Window.partitionBy(*_by(by)).orderBy(*_by(order)).rowsBetween(-k + current, 0 if current else -1)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def leave_one_out(value: str, by) -> Column:
    """Mean of the group's other rows; null where there are none."""
    w = Window.partitionBy(*_by(by))
    n = F.count(value).over(w)
    return F.when(n > 1, (F.sum(value).over(w) - F.col(value)) / (n - 1))


def beside(df: DataFrame, groups: DataFrame, by) -> DataFrame:
    """df with the columns of groups, a row per key of df; null keys are one group.

    For few groups of any size, as seasons: groups is broadcast, so no task sorts or holds a group as it would under a window.
    """
    keys = _by(by)
    g = groups.withColumnsRenamed({k: f"_by_{k}" for k in keys})
    return df.join(F.broadcast(g), [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in keys]).drop(*(f"_by_{k}" for k in keys))


def with_group(df: DataFrame, by, **aggs: Column) -> DataFrame:
    """df with aggregates of its groups, which are few (beside)."""
    return beside(df, df.groupBy(*_by(by)).agg(*(c.alias(name) for name, c in aggs.items())), by)


def running_sum(value: str, by, order) -> Column:
    return F.sum(value).over(Window.partitionBy(*_by(by)).orderBy(*_by(order)).rowsBetween(Window.unboundedPreceding, 0))


def fill_median(df: DataFrame, value: str, by: str, out: str, default: float | None = None) -> DataFrame:
    """Group median, else the whole median, else a constant, in place of null; medians are exact and no buffer holds a group's values (ranges.quantiles)."""
    g = quantiles(df, by, value, [0.5]).select(F.col(by).alias("_by"), F.col("quantiles")[0].alias("_group"))
    whole = quantiles(df, None, value, [0.5]).agg(F.max(F.col("quantiles")[0]).alias("_whole"))  # one row, also of an empty table
    x = df.join(g, F.col(by).eqNullSafe(F.col("_by")), "left").crossJoin(whole)
    return x.withColumn(out, F.coalesce(value, "_group", "_whole", F.lit(default).cast("double"))).drop("_by", "_group", "_whole")


def streaks(df: DataFrame, outcome: str, by, order) -> DataFrame:
    """Signed run lengths of equal outcomes: +k for 1, -k for -1, 0 for ties; runs end with the group."""
    w = Window.partitionBy(*_by(by)).orderBy(*_by(order))
    x = df.withColumn("_new", F.when(F.lag(outcome).over(w).eqNullSafe(F.col(outcome)), 0).otherwise(1))
    x = x.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy(*_by(by), "_run").orderBy(*_by(order)))
    return x.withColumn("streak", (n * F.col(outcome)).cast("int")).drop("_new", "_run")


def latest_per(df: DataFrame, by, *order: Column) -> DataFrame:
    """One row per key: the first in the given order, which must be total."""
    return top_per(df, by, 1, *order)


def top_per(df: DataFrame, by, k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*_by(by)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def modal(df: DataFrame, by, value: str) -> DataFrame:
    """The most frequent value per key, the smallest of equals."""
    n = df.where(F.col(value).isNotNull()).groupBy(*_by(by), value).agg(F.count("*").alias("n"))
    return latest_per(n, by, F.col("n").desc(), F.col(value).asc())
