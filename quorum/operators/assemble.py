"""Whole pipelines in one call: declared sources of estimates to blended, reconciled, scored and ranked lines."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

BLEND, MEAN = "true", "mean"


@dataclass(frozen=True)
class Sources:
    """Which source stands in for which.

    first: the most complete; second: filled from it; books: filled from the mean of those two; own: sources that abstain, never filled.
    weights: source to weight, or to a weight per stat (others 0).  doubled: stats of the first that are halved where they are over
    `ratio` times the second's and over `least`.
    """

    first: str
    second: str
    books: tuple[str, ...] = ()
    own: tuple[str, ...] = ()
    weights: dict = field(default_factory=dict)
    doubled: tuple[str, ...] = ()
    ratio: float = 1.75
    least: float = 40.0

    @property
    def all(self) -> tuple[str, ...]:
        return (self.first, self.second, *self.books, *self.own)

    def weight(self, source: str) -> Column:
        w = self.weights.get(source, 0.0)
        if not isinstance(w, dict):
            return F.lit(float(w))
        return reduce(lambda c, kv: c.when(F.col("stat") == kv[0], float(kv[1])), w.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)


def lines(entities: DataFrame, estimates: DataFrame, keys: list[str], stats: list[str], src: Sources, carry: list[str]) -> DataFrame:
    """keys, stat, carry, a column per source, a flag <source>_imputed, `mean` and `true`: a row per entity and stat, in one shuffle on the keys.

    estimates: keys, stat, source, value; unknown keys, stats and sources take no part, of several values the greatest counts.  entities: keys (unique) and carry.
    The blend takes real values by renormalised weights; where none has weight, all values at their face weights (nulls as 0).
    """
    empty = [F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("value")]
    whole = F.struct(*(F.col(c) for c in carry), F.lit(True).alias("_here"))
    grid = entities.select(*keys, F.explode(F.array(*map(F.lit, stats))).alias("stat"), *empty, whole.alias("_e"))
    given = estimates.where(F.col("stat").isin(*stats) & F.col("source").isin(*src.all)).select(*keys, "stat", "source", F.col("value").cast("double").alias("value"), F.lit(None).cast(grid.schema["_e"].dataType).alias("_e"))
    x = grid.union(given).repartition(*keys).groupBy(*keys, "stat").agg(F.first("_e", ignorenulls=True).alias("_e"), *(F.max(F.when(F.col("source") == s, F.col("value"))).alias(s) for s in src.all))
    x = x.where("_e IS NOT NULL").select(*keys, "stat", *(F.col(f"_e.{c}").alias(c) for c in carry), *src.all)
    a, b = F.col(src.first), F.col(src.second)
    if src.doubled:
        x = x.withColumn(src.first, F.when(F.col("stat").isin(*src.doubled) & (a > src.ratio * b) & (a > src.least), a / 2).otherwise(a))
    x = x.withColumns({f"{s}_imputed": F.col(s).isNull() for s in src.all}).withColumn(src.second, F.coalesce(b, a))
    x = x.withColumn(MEAN, F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b)))
    x = x.withColumns({s: F.coalesce(s, MEAN) for s in src.books})
    w = {s: src.weight(s) for s in src.all}
    real = {s: F.when(F.col(f"{s}_imputed"), 0.0).otherwise(w[s]) for s in src.all}
    add = lambda cs: reduce(lambda p, q: p + q, cs)
    v = lambda s: F.coalesce(F.col(s), F.lit(0.0))
    total = add(real.values())
    return x.withColumn(BLEND, F.when(total > 0, add(v(s) * real[s] for s in src.all) / total).otherwise(add(v(s) * w[s] for s in src.all)))


def reconciled(x: DataFrame, team: str, identities: list[tuple[str, str]], value: str = BLEND) -> DataFrame:
    """value of both stats of each pair scaled so that a team's two sums meet in the middle, where both are positive; one aggregation per team for all pairs."""
    names = [s for pair in identities for s in pair]
    if len(set(names)) < len(names):
        raise ValueError("a stat of two identities")
    sums = x.where(F.col("stat").isin(*names) & F.col(team).isNotNull()).groupBy(F.col(team).alias("_team")).agg(*(F.sum(F.when(F.col("stat") == s, F.col(value))).alias(f"_s{i}") for i, s in enumerate(names)))
    ratio = F.lit(None).cast("double")
    for i, s in enumerate(names):
        own, other = F.col(f"_s{i}"), F.col(f"_s{i ^ 1}")
        ratio = F.when((F.col("stat") == s) & (own > 0) & (other > 0), (own + other) / 2 / own).otherwise(ratio)
    y = x.join(sums, F.col(team) == F.col("_team"), "left")
    return y.withColumn(value, F.col(value) * F.coalesce(ratio, F.lit(1.0))).drop(*sums.columns)


def scored(x: DataFrame, keys: list[str], carry: list[str], rules: DataFrame, slot: str, base: str, of: list[str], flags: dict[str, Column] | None = None) -> DataFrame:
    """keys, carry and <source>_points for all sources in one aggregation: the rule (slot, stat, points) of the row's slot, else of the base slot (0 is a rule).

    flags: conditions on a row, by the name of a column that says whether any row of the line meets it.  A line without any ruled value has null points; other unknown values count as 0.
    """
    own = rules.select(F.col("slot").alias(slot), "stat", F.col("points").alias("_own"))
    common = rules.where(F.col("slot") == base).select("stat", F.col("points").alias("_base"))
    y = x.join(own, [slot, "stat"], "left").join(common, "stat", "left").withColumn("_p", F.coalesce("_own", "_base"))
    ruled = F.col("_p").isNotNull()
    points = [F.when(F.count(F.when(ruled, F.col(s))) > 0, F.sum(F.coalesce(F.col(s), F.lit(0.0)) * F.col("_p"))).alias(f"{s}_points") for s in of]
    return y.groupBy(*keys).agg(*(F.first(c).alias(c) for c in carry), *points, *(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in (flags or {}).items()))


def clean_lineups(lineups: DataFrame, estimates: DataFrame, keys: list[str], stats: list[str], src: Sources, rules: DataFrame, slot: str, base: str, official: str, actual: str, within: list[str], digits: int = 9) -> DataFrame:
    """lineups with <source>_points and dense <source>_rank within groups, for every source, the mean and the blend, and `rank` of the actual points.

    All points are shifted by what the official projection has beyond the first source's own.  Ranks are of points at `digits` places; null points have none.
    """
    of = [*src.all, MEAN, BLEND]
    x = scored(lines(lineups, estimates, keys, stats, src, [slot]), keys, [], rules, slot, base, of)
    shift = F.col(official) - F.col(f"{src.first}_points")
    y = lineups.join(x, keys, "left").withColumn("_shift", shift)
    y = y.withColumns({f"{s}_points": F.col(f"{s}_points") + F.col("_shift") for s in of}).drop("_shift")

    def rank(c: str) -> Column:
        w = Window.partitionBy(*within).orderBy(F.round(c, digits).desc_nulls_last())
        return F.when(F.col(c).isNotNull(), F.dense_rank().over(w))

    return y.withColumns({f"{s}_rank": rank(f"{s}_points") for s in of} | {"rank": rank(actual)})


def season_projections(players: DataFrame, estimates: DataFrame, keys: list[str], stats: list[str], src: Sources, identities: list[tuple[str, str]], rules: DataFrame, slot: str, base: str, team: str, position: str, model: str | None = None, digits: int = 9) -> DataFrame:
    """players with <source>_points, floor, ceiling and n_sources of the real ones, the blend's rank in its position, and a model's rank and difference.

    The blend is reconciled over the identities of teams before it is scored; single sources keep what they said.  A source counts where it has
    a real value other than zero; bounds are of such sources' points, null below two.
    """
    of = [*src.all, BLEND]
    carry = list(dict.fromkeys([slot, team, position]))
    x = reconciled(lines(players, estimates, keys, stats, src, carry), team, identities) if identities else lines(players, estimates, keys, stats, src, carry)
    spoke = {f"_r_{s}": ~F.col(f"{s}_imputed") & (F.col(s) != 0) for s in src.all}
    y = players.join(scored(x, keys, [], rules, slot, base, of, spoke), keys, "left")
    real = F.filter(F.array(*(F.when(F.col(f"_r_{s}"), F.col(f"{s}_points")) for s in src.all)), lambda v: v.isNotNull())
    y = y.withColumn("_real", real)
    two = F.size("_real") >= 2
    y = y.withColumns({"floor": F.when(two, F.array_min("_real")), "ceiling": F.when(two, F.array_max("_real")), "n_sources": F.greatest(F.size("_real"), F.lit(0))}).drop("_real", *spoke)

    def rank(c: str) -> Column:
        w = Window.partitionBy(position).orderBy(F.round(c, digits).desc_nulls_last())
        return F.when(F.col(c).isNotNull(), F.rank().over(w))

    y = y.withColumn("pos_rank", rank(f"{BLEND}_points"))
    return y.withColumn("model_rank", rank(f"{model}_points")).withColumn("model_delta", F.col("pos_rank") - F.col("model_rank")) if model else y
