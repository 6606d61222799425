"""Leak-free season features: totals, pooled rates, shrinkage, lags, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expr import clip, shrunk
from .windows import with_group


class LeakError(ValueError):
    """A feature frame reaches into the season that it is to predict."""


def guard_history(history: DataFrame, season: str, target: int) -> DataFrame:
    """history, if all of it lies before the target season."""
    last = history.agg(F.max(season).alias("m")).first()["m"]
    if last is not None and last >= target:
        raise LeakError(f"history has season {last}; the target is {target}")
    return history


def leakage_columns(columns: list[str], outcome_prefix: str = "y_", lag_prefixes: tuple[str, ...] = ("p1_", "p2_", "t3_"), keys: tuple[str, ...] = ()) -> list[str]:
    """Feature columns that carry neither a lag prefix nor are keys or outcomes."""
    return [c for c in columns if not c.startswith((outcome_prefix, *lag_prefixes)) and c not in keys]


def season_totals(df: DataFrame, entity: str, season: str, week: str, sums: list[str], means: list[str], last: str) -> DataFrame:
    """Sums, means, games, and the last known value of a column by week."""
    return df.groupBy(season, entity).agg(*(F.sum(c).alias(c) for c in sums), *(F.avg(c).alias(f"mean_{c}") for c in means), F.count("*").alias("games"), F.max_by(last, F.when(F.col(last).isNotNull(), F.struct(week, last))).alias(last))


def pooled_rate(df: DataFrame, by: list[str], num: str, den: str) -> DataFrame:
    """Ratio of sums."""
    return df.groupBy(*by).agg(F.sum(num).alias("_n"), F.sum(den).alias("_d")).select(*by, F.when(F.col("_d") > 0, F.col("_n") / F.col("_d")).alias("base_rate"))


def shrunk_rates(df: DataFrame, base: DataFrame, by: list[str], num: str, den: str, k: float) -> DataFrame:
    """Own rate drawn to the group's pooled rate by k units of evidence."""
    x = df.join(base, by, "left")
    own = F.when(F.col(den) > 0, F.col(num) / F.col(den))
    return x.withColumn("rate", shrunk(own, den, "base_rate", k))


def lags(df: DataFrame, entity: str, season: str, values: list[str], by: tuple[int, ...] = (1, 2)) -> DataFrame:
    """p1_, p2_ ... values of the entity's seasons exactly that many before (shifted keys, not shifted rows)."""
    out = df
    for n in by:
        prior = df.select(entity, (F.col(season) + n).alias(season), *(F.col(v).alias(f"p{n}_{v}") for v in values))
        out = out.join(prior, [entity, season], "left")
    return out


def first_snapshot(df: DataFrame, season: str, week: str) -> DataFrame:
    """The rows of each season's first week."""
    return with_group(df, season, _w=F.min(week)).where(F.col(week) == F.col("_w")).drop("_w")


def latest_contract(df: DataFrame, entity: str, signed: str, target: str, tie: str) -> DataFrame:
    """Each entity's latest row signed no later than its target."""
    w = Window.partitionBy(entity).orderBy(F.col(signed).desc(), F.col(tie).desc())
    return df.where(F.col(signed) <= F.col(target)).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def availability(df: DataFrame, team_periods: DataFrame, entity: str, team: str, season: str, period: str) -> DataFrame:
    """Periods played over periods the entity's team had, at most 1."""
    played = df.groupBy(season, entity).agg(F.count_distinct(period).alias("played"), F.max(team).alias(team))
    slate = team_periods.groupBy(season, team).agg(F.count_distinct(period).alias("slate"))
    return played.join(slate, [season, team], "left").withColumn("availability", clip(F.try_divide("played", "slate"), 0.0, 1.0))


def profile_shares(df: DataFrame, by: list[str], kind: str, value: str, kinds: list[str]) -> DataFrame:
    """Share of each kind in its group's total, one column per kind."""
    p = df.groupBy(*by).pivot(kind, kinds).agg(F.sum(value))
    total = sum((F.coalesce(F.col(k), F.lit(0.0)) for k in kinds[1:]), F.coalesce(F.col(kinds[0]), F.lit(0.0)))
    return p.select(*by, *(F.when(total > 0, F.coalesce(F.col(k), F.lit(0.0)) / total).alias(f"share_{k}") for k in kinds))
