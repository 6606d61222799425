"""Second choices: what the strength of a team is worth to the one behind its first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def team_strength(games: DataFrame, by: list[str], home: str, away: str, spread: str) -> DataFrame:
    """Mean spread of every team: as given at home, with the other sign away; games without one do not count."""
    g = games.where(F.col(spread).isNotNull())
    sides = F.explode(F.array(F.struct(F.col(home).alias("team"), F.col(spread).cast("double").alias("s")), F.struct(F.col(away).alias("team"), (-F.col(spread).cast("double")).alias("s"))))
    return g.select(*by, sides.alias("_x")).groupBy(*by, F.col("_x.team").alias("team")).agg(F.avg("_x.s").alias("strength"))


def seconds(df: DataFrame, team: list[str], value: str, ident: str, place: int = 2) -> DataFrame:
    """The row of each team that stands at `place` by value."""
    w = Window.partitionBy(*team).orderBy(F.col(value).desc(), ident)
    return df.where(F.col(value).isNotNull()).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == place).drop("_rn")


def fit_line(df: DataFrame, x: str, y: str, least: int = 100) -> DataFrame:
    """One row: intercept, slope, r2 and the residuals' standard deviation; none below `least` rows."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = d.agg(F.count("*").alias("n"), F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.var_pop(y).alias("_v"))
    return g.where(F.col("n") >= least).select("n", "intercept", "slope", "r2", F.sqrt(F.greatest(F.lit(0.0), F.col("_v") * (1 - F.coalesce("r2", F.lit(0.0))))).alias("sd"))


def attach_handcuff(board: DataFrame, strength: DataFrame, line: DataFrame, team: str, points: str, ident: str, eligible, place: int = 2) -> DataFrame:
    """board with strength, place in the team (of eligible rows with points), and for the second the expected value and its premium over an average team's."""
    ok = F.coalesce(eligible, F.lit(False)) & F.col(points).isNotNull() & F.col(team).isNotNull()
    x = board.withColumn("_ok", ok)
    w = Window.partitionBy(team, "_ok").orderBy(F.col(points).desc_nulls_last(), ident)
    x = x.withColumn("backfield_rank", F.when(F.col("_ok"), F.row_number().over(w))).drop("_ok")
    mean = strength.agg(F.avg("strength").alias("_mean"))
    x = x.join(strength, team, "left").crossJoin(line.select("intercept", "slope", "r2")).crossJoin(mean)
    two = F.col("backfield_rank") == place
    return x.withColumns({"handcuff_carries": F.when(two, F.col("intercept") + F.col("slope") * F.col("strength")), "handcuff_premium": F.when(two, F.col("slope") * (F.col("strength") - F.col("_mean"))), "handcuff_r2": F.col("r2")}).drop("intercept", "slope", "r2", "_mean")
