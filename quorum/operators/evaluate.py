"""Measures of forecasts, comparisons of frames, and the rule that decides between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import col
from .windows import rank


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over rows that have both; null where one side does not vary."""
    a, b = col(x), col(y)
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def spearman(df: DataFrame, by: str, x: str, y: str, least: int = 3) -> DataFrame:
    """Rank correlation per group with average ranks; null below `least` rows."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.select(by, rank("average", x, by).alias("_x"), rank("average", y, by).alias("_y"))
    return d.groupBy(by).agg(F.count("*").alias("n"), correlation("_x", "_y").alias("_r")).select(by, "n", F.when(F.col("n") >= least, F.col("_r")).alias("rho"))


def partial_corr(xy, xz, yz):
    """Correlation of x and y given z, from three Pearson correlations."""
    return F.try_divide(xy - xz * yz, F.sqrt((1 - xz * xz) * (1 - yz * yz)))


def mae(df: DataFrame, by: str, actual: str, estimates: list[str]) -> DataFrame:
    """Mean absolute errors on the rows that all estimates cover."""
    ok = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (actual, *estimates)))
    return df.where(ok).groupBy(by).agg(F.count("*").alias("n"), *(F.avg(F.abs(F.col(e) - F.col(actual))).alias(f"mae_{e}") for e in estimates))


def top_n_hits(df: DataFrame, by: str, ident: str, predicted: str, actual: str, n: int) -> DataFrame:
    """Share of the n best by prediction that are among the n best in fact."""
    p = F.row_number().over(Window.partitionBy(by).orderBy(F.col(predicted).desc_nulls_last(), ident))
    a = F.row_number().over(Window.partitionBy(by).orderBy(F.col(actual).desc_nulls_last(), ident))
    x = df.select(by, p.alias("_p"), a.alias("_a"))
    return x.groupBy(by).agg((F.count_if((F.col("_p") <= n) & (F.col("_a") <= n)) / F.least(F.lit(n), F.count("*"))).alias("hit_rate"))


def top_n_hits_by_season(df: DataFrame, season: str, by: str, ident: str, predicted: str, actual: str, n: int) -> DataFrame:
    """top_n_hits() of every season, averaged over the seasons."""
    x = top_n_hits(df.withColumn("_k", F.struct(season, by)), "_k", ident, predicted, actual, n)
    return x.groupBy(F.col(f"_k.{by}").alias(by)).agg(F.avg("hit_rate").alias("hit_rate"), F.count("*").alias("seasons"))


def residual_correlations(df: DataFrame, keys: list[str], source: str, residual: str) -> DataFrame:
    """Pearson correlation of every pair of sources' residuals on common keys."""
    a, b = df.select(*keys, F.col(source).alias("a"), F.col(residual).alias("_x")), df.select(*keys, F.col(source).alias("b"), F.col(residual).alias("_y"))
    return a.join(b, keys).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), correlation("_x", "_y").alias("r"))


def frame_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Per column: cells compared, cells that differ, largest difference; keys of one side only count as differing."""
    o, n = old.select(*keys, *(F.col(v).alias(f"_o_{v}") for v in values), F.lit(1).alias("_o")), new.select(*keys, *(F.col(v).alias(f"_n_{v}") for v in values), F.lit(1).alias("_n"))
    j = o.join(n, keys, "full")
    one = F.col("_o").isNull() | F.col("_n").isNull()
    parts = []
    for v in values:
        a, b = F.col(f"_o_{v}").cast("double"), F.col(f"_n_{v}").cast("double")
        bad = one | (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > tolerance, F.lit(False))
        parts += [F.count("*").alias(f"{v}|n"), F.count_if(bad).alias(f"{v}|bad"), F.max(F.abs(a - b)).alias(f"{v}|max")]
    g = j.agg(*parts)
    rows = F.explode(F.array(*(F.struct(F.lit(v).alias("column"), F.col(f"{v}|n").alias("cells"), F.col(f"{v}|bad").alias("differing"), F.col(f"{v}|max").alias("max_diff")) for v in values)))
    return g.select(rows.alias("r")).select("r.*")


def calibration(df: DataFrame, bands: DataFrame, at: str, predicted: str, actual: str) -> DataFrame:
    """n, mean and spread of errors and the share over-estimated per band (low, high] of another value."""
    x = df.join(F.broadcast(bands), (F.col(at) > F.col("low")) & (F.col(at) <= F.col("high")))
    e = F.col(predicted) - F.col(actual)
    return x.groupBy("band").agg(F.count("*").alias("n"), F.avg(e).alias("bias"), F.stddev_samp(e).alias("sd"), F.avg((e > 0).cast("double")).alias("share_over"), F.median(e).alias("median"))


def collapse(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One row per key from several pools: the first known value by pool, and how far the pools disagree."""
    return df.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value), (F.max(value) - F.min(value)).alias("disagreement"), F.count(value).alias("pools"))


# The rule's limits.
LEAST_GAIN, MOST_LOSS, MOST_REGRESSIONS, MOST_MEAN_MAE, MOST_STAT_MAE = 0.005, 0.005, 1, 0.5, 2.0


def verdict(ranks: DataFrame, errors: DataFrame, by: list[str]) -> DataFrame:
    """by, mean_gain, worst_gain, regressions, mean_mae, worst_mae, verdict and the clause that decided it.

    ranks: by, group, base_rho, rho, base_top, top; errors: by, stat, base_mae, mae.  Clauses in order: too small a mean gain in rank
    correlation, too large a loss in one group, hit rates that fall in too many groups, errors (in per cent) that grow too much
    on the mean or in one stat; whatever passes all merges.  Rows with an unknown side are not compared.
    """
    gain = F.col("rho") - F.col("base_rho")
    r = ranks.groupBy(*by).agg(F.avg(gain).alias("mean_gain"), F.min(gain).alias("worst_gain"), F.count_if(F.col("top") < F.col("base_top")).alias("regressions"))
    change = F.when(F.col("base_mae") > 0, 100 * (F.col("mae") - F.col("base_mae")) / F.col("base_mae"))
    e = errors.groupBy(*by).agg(F.avg(change).alias("mean_mae"), F.max(change).alias("worst_mae"))
    x = r.join(e, by, "left")
    clause = (
        F.when(F.col("mean_gain").isNull(), "nothing comparable")
        .when(F.col("mean_gain") < LEAST_GAIN, "mean gain")
        .when(F.col("worst_gain") < -MOST_LOSS, "group loss")
        .when(F.col("regressions") > MOST_REGRESSIONS, "hit rates")
        .when(F.col("mean_mae") > MOST_MEAN_MAE, "mean error")
        .when(F.col("worst_mae") > MOST_STAT_MAE, "stat error")
        .otherwise("passed")
    )
    return x.withColumn("clause", clause).withColumn("verdict", F.when(F.col("clause") == "passed", "merge").otherwise("reject"))


def weighted_mean(df: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """Mean of a value weighted by n, over rows that have both."""
    ok = F.col(value).isNotNull() & F.col(n).isNotNull()
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.when(ok, F.col(value) * F.col(n))), F.sum(F.when(ok, F.col(n)))).alias(f"mean_{value}"), F.sum(F.when(ok, F.col(n))).alias(n))


def blend_mae(df: DataFrame, by: list[str], base: str, source: str, actual: str, weights: list[float]) -> DataFrame:
    """Mean absolute error of (1 - w) base + w source at several weights, on rows that have all three."""
    x = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (base, source, actual))).withColumn("weight", F.explode(F.array(*map(F.lit, weights))))
    guess = (1 - F.col("weight")) * F.col(base) + F.col("weight") * F.col(source)
    return x.groupBy(*by, "weight").agg(F.count("*").alias("n"), F.avg(F.abs(guess - F.col(actual))).alias("mae"))


def holdout_r2(df: DataFrame, by: list[str], predicted: str, actual: str) -> DataFrame:
    """1 - squared errors over squared deviations from the mean; null where the actual never varies."""
    e = F.col(actual) - F.col(predicted)
    g = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.sum(e * e).alias("_sse"), F.var_pop(actual).alias("_v"))
    return g.select(*by, "n", F.when(F.col("_v") > 0, 1 - F.col("_sse") / (F.col("_v") * F.col("n"))).alias("r2"))


def prior_weight(df: DataFrame, by: list[str], n: str, k: float, at: float = 0.95) -> DataFrame:
    """Weight k / (n + k) that a prior keeps at a high percentile of the evidence."""
    return df.groupBy(*by).agg(F.percentile(n, at).alias("n")).withColumn("prior_weight", k / (F.col("n") + k))


def match_share(df: DataFrame, dim: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Rows, rows whose key the dimension has, and their percentage."""
    d = dim.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_hit", F.lit(1))
    g = df.join(d, key, "left").groupBy(*by).agg(F.count("*").alias("n"), F.count("_hit").alias("matched"))
    return g.withColumn("matched_pct", F.round(100 * F.col("matched") / F.col("n"), 1))


def spearman_without(df: DataFrame, by: str, blend: str, without: str, actual: str) -> DataFrame:
    """Rank correlation of a blend, and of the blend without a source, with the outcome, on rows that both cover."""
    d = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (blend, without, actual)))
    return spearman(d, by, blend, actual).withColumnRenamed("rho", "rho_with").join(spearman(d, by, without, actual).select(by, F.col("rho").alias("rho_without")), by)


def common_mask(column: str, rule: str):
    """Populations of an evaluation: all rows, rows whose team played, rows that played themselves."""
    return {"all": F.lit(True), "team": F.coalesce(F.col("team_played"), F.lit(False)), "played": F.coalesce(F.col(column), F.lit(False))}[rule]


def attach_played(df: DataFrame, usage: DataFrame, keys: list[str], entity: str, team: str) -> DataFrame:
    """played (the entity has a row in usage) and team_played (its team has one)."""
    own = usage.select(*keys, entity).distinct().withColumn("played", F.lit(True))
    its = usage.select(*keys, team).distinct().withColumn("team_played", F.lit(True))
    x = df.join(own, [*keys, entity], "left").join(its, [*keys, team], "left")
    return x.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("played", "team_played")})


def worst_spread(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """The largest range that any of the columns has in a group."""
    spread = [F.max(v) - F.min(v) for v in values]
    return df.groupBy(*by).agg(F.greatest(*spread).alias("worst"))
