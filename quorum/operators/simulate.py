"""Season simulation with draws that depend on keys alone, so any partitioning gives the same trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import hash_uniform


def normal_draw(mean: Column, sd: Column, *keys) -> Column:
    """Box-Muller on two hashed uniforms, at least 0."""
    u, v = hash_uniform(*keys, F.lit(1)), hash_uniform(*keys, F.lit(2))
    return F.greatest(F.lit(0.0), mean + sd * F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v))


def strength(facts: DataFrame, period: str, last: int = 6, spread: float = 2.0) -> DataFrame:
    """team, mean of its last scores that are not zero, and `spread` times the population deviation of all of them."""
    x = facts.where(F.col("score") > 0).withColumn("_back", F.row_number().over(Window.partitionBy("team").orderBy(F.col(period).desc(), "opponent")))
    return x.groupBy("team").agg(F.avg(F.when(F.col("_back") <= last, F.col("score"))).alias("mean"), (spread * F.stddev_pop("score")).alias("sd"))


def trials(schedule: DataFrame, strength: DataFrame, n: int) -> DataFrame:
    """trial, game, and both teams' drawn scores; schedule (game, home, away), strength (team, mean, sd)."""
    spark = schedule.sparkSession
    h, a = (strength.select(F.col("team").alias(k), F.col("mean").alias(f"{k}_m"), F.col("sd").alias(f"{k}_s")) for k in ("home", "away"))
    x = schedule.join(h, "home").join(a, "away").crossJoin(spark.range(n).withColumnRenamed("id", "trial"))
    return x.select("trial", "game", "home", "away", *(normal_draw(F.col(f"{k}_m"), F.col(f"{k}_s"), "trial", "game", F.lit(i)).alias(f"{k}_score") for i, k in enumerate(("home", "away"))))


def standings(drawn: DataFrame) -> DataFrame:
    """trial, team, wins, points, place: by wins, then points, then team."""
    def side(a, b):
        return drawn.select("trial", F.col(a).alias("team"), F.col(f"{a}_score").alias("points"), (F.col(f"{a}_score") > F.col(f"{b}_score")).cast("int").alias("won"))

    t = side("home", "away").unionByName(side("away", "home")).groupBy("trial", "team").agg(F.sum("won").alias("wins"), F.sum("points").alias("points"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy("trial").orderBy(F.col("wins").desc(), F.col("points").desc(), "team")))


def odds(places: DataFrame, spots: int) -> DataFrame:
    return places.groupBy("team").agg(F.avg((F.col("place") <= spots).cast("double")).alias("playoff_odds"), F.avg("wins").alias("mean_wins"))


def place_distribution(places: DataFrame, teams: int) -> DataFrame:
    """Percentage of trials in which a team takes each place."""
    p = places.groupBy("team").pivot("place", list(range(1, teams + 1))).agg(F.count("wins"))
    n = sum((F.coalesce(F.col(str(i)), F.lit(0)) for i in range(2, teams + 1)), F.coalesce(F.col("1"), F.lit(0)))
    return p.select("team", *((100 * F.coalesce(F.col(str(i)), F.lit(0)) / n).alias(f"place_{i}") for i in range(1, teams + 1)))


def swing(places: DataFrame, drawn: DataFrame, game: int, spots: int) -> DataFrame:
    """How much each team's odds move with the winner of one game."""
    w = drawn.where(F.col("game") == game).select("trial", (F.col("home_score") > F.col("away_score")).alias("_home"))
    x = places.join(w, "trial").groupBy("team").agg(F.avg(F.when(F.col("_home"), (F.col("place") <= spots).cast("double"))).alias("if_home"), F.avg(F.when(~F.col("_home"), (F.col("place") <= spots).cast("double"))).alias("if_away"))
    return x.withColumn("swing", F.abs(F.col("if_home") - F.col("if_away")))


def seeding_outcomes(places: DataFrame, team: int) -> DataFrame:
    """Of one team: the share of trials with each number of wins and place, and the mean points there."""
    x = places.where(F.col("team") == team)
    n = x.agg(F.count("*").alias("_n"))
    return x.groupBy("wins", "place").agg(F.count("*").alias("trials"), F.avg("points").alias("mean_points")).crossJoin(n).withColumn("share", F.col("trials") / F.col("_n")).drop("_n")


def with_results(drawn: DataFrame, known: DataFrame) -> DataFrame:
    """drawn with the results that are given (game, home_score, away_score) in place of drawn ones."""
    k = known.select("game", F.col("home_score").alias("_h"), F.col("away_score").alias("_a"))
    return drawn.join(k, "game", "left").select("trial", "game", "home", "away", F.coalesce("_h", "home_score").alias("home_score"), F.coalesce("_a", "away_score").alias("away_score"))
