"""Blending competing estimates: provenance-tracked imputation, renormalised weights, rule prices, reconciliation.

Estimates are long: keys, stat, source, value, is_imputed.  A null flag means that nothing vouches for the value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def impute(df: DataFrame, target: str, source: str, flag: str) -> DataFrame:
    """Target filled from source; the flag marks filled values and never loses an earlier mark (null counts as marked)."""
    prior = F.coalesce(F.col(flag), F.lit(True)) if flag in df.columns else F.lit(False)
    return df.withColumns({flag: F.col(target).isNull() | prior, target: F.coalesce(target, source)})


def coverage(df: DataFrame, real: str = "NOT coalesce(is_imputed, true) AND value IS NOT NULL") -> DataFrame:
    """Per source and stat: rows, real values and their percentage."""
    return df.groupBy("source", "stat").agg(F.count("*").alias("n"), F.count_if(F.expr(real)).alias("real")).withColumn("real_pct", F.round(100 * F.col("real") / F.col("n"), 1))


def with_weights(df: DataFrame, weights: DataFrame) -> DataFrame:
    """df with `weight`: a source's weight for the stat (weights: source, weight and perhaps stat), else its general one (null stat), else 0."""
    if "stat" not in weights.columns:
        weights = weights.withColumn("stat", F.lit(None).cast("string"))
    own = weights.where("stat IS NOT NULL").select("source", "stat", F.col("weight").alias("_own"))
    general = weights.where("stat IS NULL").select("source", F.col("weight").alias("_general"))
    return df.join(own, ["source", "stat"], "left").join(general, "source", "left").withColumn("weight", F.coalesce("_own", "_general", F.lit(0.0))).drop("_own", "_general")


def weighted(df: DataFrame, weights: DataFrame, keys: list[str], renormalise: bool = True) -> DataFrame:
    """Blend per key and stat: real values by renormalised weights; where no real value has weight, or without `renormalise`, the face-value sum.

    Missing provenance (no is_imputed column) counts as real; a null value never does.  A source without a weight has weight 0.
    """
    flag = F.coalesce(F.col("is_imputed"), F.lit(True)) if "is_imputed" in df.columns else F.lit(False)
    real = (~flag & F.col("value").isNotNull()).cast("double")
    x = with_weights(df, weights).withColumns({"_r": real * F.col("weight"), "_v": F.coalesce("value", F.lit(0.0))})
    g = x.groupBy(*keys, "stat").agg(F.sum(F.col("_v") * F.col("_r")).alias("_num"), F.sum("_r").alias("_den"), F.sum(F.col("_v") * F.col("weight")).alias("_face"))
    value = F.when(F.col("_den") > 0, F.col("_num") / F.col("_den")).otherwise(F.col("_face")) if renormalise else F.col("_face")
    return g.select(*keys, "stat", value.alias("value"))


def variants(df: DataFrame, weights: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """weighted() under several weight tables (weights: variant, source, weight and perhaps stat) in one pass, with a column `variant`; every variant of `names` has every key."""
    both = F.concat_ws("\x1f", "variant", "source")
    x = df.withColumn("variant", F.explode(F.array(*map(F.lit, names)))).withColumn("source", both)
    return weighted(x, weights.withColumn("source", both).drop("variant"), [*keys, "variant"])


def _total(x: DataFrame, keys: list[str], points, ruled) -> DataFrame:
    g = x.groupBy(*keys).agg(F.sum(F.when(ruled, F.coalesce("value", F.lit(0.0)) * points)).alias("_p"), F.count(F.when(ruled, F.col("value"))).alias("_n"), F.count_if(ruled & points.isNull()).alias("_bad"))
    return g.select(*keys, F.when((F.col("_n") > 0) & (F.col("_bad") == 0), F.col("_p")).alias("points"))


def score(df: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Points by a rule table (stat, points): a stat without a value scores 0, a key without any ruled value null, and a rule without a price makes the total null."""
    x = df.join(rules.withColumn("_has", F.lit(True)), "stat", "left")
    return _total(x, keys, F.col("points"), F.coalesce("_has", F.lit(False)))


def score_by_slot(df: DataFrame, rules: DataFrame, keys: list[str], slot: str, base: str) -> DataFrame:
    """Rules of the row's slot, or the base slot's where the slot has no rule for the stat (a rule of exactly 0 is one); null as in score()."""
    own = rules.select(F.col("slot").alias(slot), "stat", F.col("points").alias("_own"), F.lit(True).alias("_has"))
    common = rules.where(F.col("slot") == base).select("stat", F.col("points").alias("_base"), F.lit(True).alias("_common"))
    x = df.join(own, [slot, "stat"], "left").join(common, "stat", "left")
    return _total(x, keys, F.when(F.col("_has"), F.col("_own")).otherwise(F.col("_base")), F.coalesce("_has", "_common", F.lit(False)))


def spread(df: DataFrame, keys: list[str], stat: str | None = None) -> DataFrame:
    """Floor, ceiling and number of sources with a real value other than zero; bounds null below two."""
    x = df.where("value IS NOT NULL AND value <> 0 AND NOT coalesce(is_imputed, true)")
    g = x.groupBy(*keys).agg(F.min("value").alias("floor"), F.max("value").alias("ceiling"), F.count("*").alias("n_sources"))
    two = F.col("n_sources") >= 2
    return g.select(*keys, F.when(two, F.col("floor")).alias("floor"), F.when(two, F.col("ceiling")).alias("ceiling"), "n_sources")


def halve_doubled(value: str, other: str, ratio: float = 1.75, least: float = 40.0):
    v, o = F.col(value), F.col(other)
    return F.when((v > ratio * o) & (v > least), v / 2).otherwise(v)


def reconcile(df: DataFrame, left: str, right: str, by: str | list[str]) -> DataFrame:
    """Both columns scaled per group so that their sums meet in the middle, where both sums are positive."""
    w = Window.partitionBy(by)
    a, b = F.sum(left).over(w), F.sum(right).over(w)
    ok = (a > 0) & (b > 0)
    mid = (a + b) / 2
    return df.select(*(c for c in df.columns if c not in (left, right)), F.when(ok, F.col(left) * mid / a).otherwise(F.col(left)).alias(left), F.when(ok, F.col(right) * mid / b).otherwise(F.col(right)).alias(right))


def split_total(total: str, ratio: str):
    """Assisted and solo parts of a total by their ratio: assisted = T / (ratio + 0.5), solo = ratio * assisted."""
    assisted = F.try_divide(F.col(total), F.col(ratio) + 0.5)
    return assisted, F.col(ratio) * assisted


def coverage_gaps(registry: DataFrame, keys: list[str], column: str, points: str) -> DataFrame:
    """Rules that carry points but have no column to score, each once."""
    return registry.where(F.col(column).isNull() & (F.col(points) != 0)).select(*keys).distinct()


def scoring_coverage(registry: DataFrame, by: list[str], column: str, points: str) -> DataFrame:
    """Per league: rules, rules without a column, and whether all are covered."""
    g = registry.groupBy(*by).agg(F.count("*").alias("rules"), F.count_if(F.col(column).isNull() & (F.col(points) != 0)).alias("unmapped"))
    return g.withColumn("covered", F.col("unmapped") == 0)


def rule_table(base: DataFrame, overrides: DataFrame, names: DataFrame, ident: str, slot: str, rewrites: dict, ignored: list) -> DataFrame:
    """slot, ident, points, label for every slot that overrides name: its own points where it has them (0 counts), else the base's.

    Ignored ids go; rewritten ids add up with those that they become; labels come by the final id, null where unknown.
    """
    slots = overrides.select(slot).distinct()
    own = overrides.select(ident, slot, F.col("points").alias("_own"))
    x = base.where(~F.col(ident).isin(*ignored)).crossJoin(slots).join(own, [ident, slot], "left")
    to = F.create_map(*(F.lit(v) for kv in rewrites.items() for v in kv))
    x = x.withColumns({ident: F.coalesce(F.try_element_at(to, F.col(ident)), F.col(ident)), "points": F.coalesce("_own", "points")})
    return x.groupBy(slot, ident).agg(F.sum("points").alias("points")).join(names, ident, "left")
