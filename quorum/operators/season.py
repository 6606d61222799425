"""A season's blend: shared names, current injuries and roles, subtotal rows, rankings, and the pipeline that joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import games_available
from .joins import left_unique

SLATE = 17
PRICED_OUT = 0.15  # fixed values: the share of a starter's level below which an estimate says "no role", and starters by position
STARTERS = {"QB": 12, "RB": 24, "WR": 36, "TE": 12}


def primary_name_keys(df: DataFrame, name: str, ident: str, points: str, out: str = "join_key") -> DataFrame:
    """Only the holder of a shared name with most points keeps the name as join key; others get a key that nothing else has."""
    w = Window.partitionBy(name).orderBy(F.col(points).desc_nulls_last(), ident)
    first = F.row_number().over(w) == 1
    return df.withColumn(out, F.when(F.col(name).isNull(), None).when(first, F.col(name)).otherwise(F.concat(F.lit("__ambiguous_"), F.col(ident).cast("string"), F.lit("__"))))


def misses(df: DataFrame, source: DataFrame, key: str, points: str, ident: str, by: str, top: int) -> DataFrame:
    """Per group: rows without a match in source, and the `top` of them with most points, joined by commas."""
    gone = df.join(source.select(key).distinct(), key, "left_anti")
    w = Window.partitionBy(by).orderBy(F.col(points).desc_nulls_last(), ident)
    x = gone.withColumn("_rn", F.row_number().over(w))
    listed = F.array_sort(F.collect_list(F.when(F.col("_rn") <= top, F.struct("_rn", F.col(ident).cast("string").alias("i")))))  # nulls are not collected: `top` at most
    return x.groupBy(by).agg(F.count("*").alias("missing"), F.array_join(F.transform(listed, lambda s: s["i"]), ", ").alias("highest"))


def attach_report(df: DataFrame, report: DataFrame, key: str) -> DataFrame:
    """df with an injury report's columns; a key with several reports has none of them."""
    return left_unique(df, report, key)


def first_game(schedule: DataFrame, season: str, week: str, day: str) -> DataFrame:
    """Each season's first day of week one."""
    return schedule.where(F.col(week) == 1).groupBy(season).agg(F.min(day).alias("opener"))


def injury_adjusted(df: DataFrame, values: list[str], flag: str, days: Column, out: Column, slate: int = SLATE) -> DataFrame:
    """values scaled by the share of the slate that an injury leaves; nothing left withdraws them (null and flagged).

    days: until the return, null where unknown; `out`, of an unknown return, is a status that alone withdraws.
    """
    share = F.when(days.isNotNull(), games_available(days, slate) / slate).when(F.coalesce(out, F.lit(False)), 0.0).otherwise(1.0)
    x = df.withColumn("share", share)
    gone = F.col("share") <= 0
    return x.withColumns({v: F.when(~gone, F.col(v) * F.col("share")) for v in values} | {flag: gone | F.coalesce(F.col(flag), F.lit(True))})


def current_depth(charts: DataFrame, at: str, ident: str, position: str, place: str, starters: dict[str, int]) -> DataFrame:
    """ident, depth_rank on the latest chart: 1 for starters, 2 for the first behind them; the best of several places."""
    last = charts.agg(F.max(at).alias("_last"))
    x = charts.where(F.col(position).isin(*starters)).crossJoin(last).where(F.col(at) == F.col("_last"))
    n = F.try_element_at(F.create_map(*(F.lit(v) for kv in starters.items() for v in kv)), F.col(position))
    return x.where(F.col(ident).isNotNull()).groupBy(ident).agg(F.min(F.greatest(F.lit(1), F.col(place).cast("int") - n + 1)).alias("depth_rank"))


def role_withdrawn(df: DataFrame, depth: DataFrame, ident: str, position: str, points: str, values: list[str], flag: str, starters: dict[str, int], share: float = PRICED_OUT) -> DataFrame:
    """values withdrawn where a second opinion sees no role: behind the starters and below a share of the starters' median, or on no chart and at zero.

    A position with fewer known points than starters has no level.  withdrawn says which rows.
    """
    n = F.try_element_at(F.create_map(*(F.lit(v) for kv in starters.items() for v in kv)), F.col(position))
    w = Window.partitionBy(position).orderBy(F.col(points).desc_nulls_last(), ident)
    top = df.where(F.col(points).isNotNull()).withColumn("_n", n).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.col("_n"))
    level = top.groupBy(position).agg(F.median(points).alias("_level"), F.count("*").alias("_have"), F.max("_n").alias("_n")).where("_have >= _n").select(position, (F.col("_level") * share).alias("_floor"))
    x = df.join(depth, ident, "left").join(level, position, "left")
    speaks = F.coalesce(*(F.col(v) for v in values)).isNotNull()
    buried = F.coalesce((F.col("depth_rank") >= 2) & (F.col(points) < F.col("_floor")), F.lit(False))
    absent = F.col("depth_rank").isNull() & F.coalesce(F.col(points) <= 0, F.lit(False))
    x = x.withColumn("withdrawn", speaks & (buried | absent))
    return x.withColumns({v: F.when(~F.col("withdrawn"), F.col(v)) for v in values} | {flag: F.col("withdrawn") | F.coalesce(F.col(flag), F.lit(True))}).drop("_floor")


def with_subtotals(df: DataFrame, by: list[str], slot: str, values: list[str], bench: tuple[str, ...], label: str) -> DataFrame:
    """df and, per group, a row of the starters' sums and one of the bench's."""
    on_bench = F.col(slot).isin(*bench)
    sums = df.groupBy(*by, F.when(on_bench, "Bench").otherwise("Starting Lineup").alias(slot)).agg(*(F.sum(v).alias(v) for v in values))
    return df.unionByName(sums.withColumn(label, F.lit("Total")), allowMissingColumns=True)


def in_order(column: str, order: list[str]) -> Column:
    """Place of a value in a list, values outside last: a key to sort by."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return F.when(at > 0, at).otherwise(len(order) + 1)


def team_projections(lineups: DataFrame, by: list[str], slot: str, owner: str, free: str, bench: tuple[str, ...], estimate: str, fallback: str, actual: str) -> DataFrame:
    """Sums per team over starters who are owned; an unknown estimate falls back, and `diff` is what it adds."""
    x = lineups.where(F.coalesce(F.col(owner) != free, F.lit(False)) & ~F.coalesce(F.col(slot).isin(*bench), F.lit(False)))
    g = x.groupBy(*by, owner).agg(F.sum(actual).alias(actual), F.sum(fallback).alias(fallback), F.sum(F.coalesce(estimate, fallback)).alias(estimate))
    return g.withColumn("diff", F.col(estimate) - F.col(fallback))


def rankings(lineups: DataFrame, position: str, positions: list[str], estimate: str, ident: str, owner: str | None = None, mine: str | None = None, free: str = "Free Agent") -> DataFrame:
    """Rows of some positions with their place by estimate; with `mine`, only that owner's rows and free ones (places are of all)."""
    x = lineups.where(F.col(position).isin(*positions)).withColumn("place", F.row_number().over(Window.partitionBy(position).orderBy(F.col(estimate).desc_nulls_last(), ident)))
    return x if mine is None else x.where(F.col(owner).isin(mine, free))
