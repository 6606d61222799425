"""Results over time: facts per team and week, records, leaderboards, luck, line-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def team_facts(games: DataFrame, period: str, home: str, away: str, home_score: str, away_score: str) -> DataFrame:
    """Two rows per game, with outcome (1, 0, -1); one pass over the games."""
    def side(a, b, sa, sb):
        return F.struct(F.col(a).alias("team"), F.col(b).alias("opponent"), F.col(sa).alias("score"), F.col(sb).alias("against"))

    x = games.select(F.col(period), F.inline(F.array(side(home, away, home_score, away_score), side(away, home, away_score, home_score))))
    return x.withColumn("outcome", F.signum(F.col("score") - F.col("against")).cast("int"))


def cumulative(facts: DataFrame, team: str, order: list[str]) -> DataFrame:
    """Wins, ties and losses so far, and the share won on entering a game (ties left out)."""
    w = Window.partitionBy(team).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    n = lambda v, frame: F.sum((F.col("outcome") == v).cast("int")).over(frame)
    won, lost = n(1, before), n(-1, before)
    return facts.withColumns({"wins": n(1, upto), "ties": n(0, upto), "losses": n(-1, upto), "entering_pct": F.when(won + lost > 0, won / (won + lost))})


def leaderboard(facts: DataFrame, team: str, period: str, value: int = 1) -> DataFrame:
    """Places by number of outcomes now and a period ago (ties by name), and the change."""
    last = facts.agg(F.max(period).alias("_last"))
    x = facts.crossJoin(F.broadcast(last)).groupBy(team).agg(F.count_if(F.col("outcome") == value).alias("now"), F.count_if((F.col("outcome") == value) & (F.col(period) < F.col("_last"))).alias("before"))
    r = lambda c: F.row_number().over(Window.orderBy(F.col(c).desc(), team))
    return x.select(team, "now", "before", r("now").alias("place"), (r("before") - r("now")).alias("change"))


def records(df: DataFrame, by: list[str], value: str, n: int, desc: bool = True) -> DataFrame:
    """Rows of rank n or better, all that tie included."""
    order = F.col(value).desc() if desc else F.col(value)
    return df.where(F.col(value).isNotNull()).withColumn("place", F.rank().over(Window.partitionBy(*by).orderBy(order))).where(F.col("place") <= n)


def leaders(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """The best value per group and all names that have it."""
    x = records(df, by, value, 1)
    return x.groupBy(*by).agg(F.max(value).alias("best"), F.array_join(F.array_sort(F.collect_set(name)), ", ").alias("leaders"))


def head_to_head(facts: DataFrame) -> DataFrame:
    return facts.groupBy("team", "opponent").agg(F.count_if(F.col("outcome") == 1).alias("wins"), F.count_if(F.col("outcome") == -1).alias("losses"), F.count_if(F.col("outcome") == 0).alias("ties"), F.avg("score").alias("mean_score"))


# Weights of the luck index, its constant shifts, and the shift of idle players by week.
LUCK = {"scheduling": 0.30, "projection": 0.10, "idle": 0.25, "history": 0.10, "optimal_actual": 0.10, "optimal_optimal": 0.10, "margin": 0.05}
SHIFTS = {"projection": -0.0140, "optimal_actual": -0.1872, "opp_optimal_actual": -0.4970}
IDLE_SHIFTS = (-0.04821658498574727, -0.05462462377911275, -0.07378159473523208, -0.05988203396348101, -0.12914084334115997, -0.13103688629728863, -0.19256673733397794, -0.08341519059524279, -0.18534342059744405, -0.17147536390054255, -0.14725777569565657, -0.07753578793949584, -0.16768422902890318, -0.13733533055934166, -0.08955988712865509, -0.08746216288440906, -0.11969066586929249, -0.1611111111111111)


def luck(facts: DataFrame, period: str, week: str) -> DataFrame:
    """facts with the weekly luck index and its ten terms, each in [-1, 1] before its shift.

    facts: period, week (1 to 18), team, opponent, score, against, outcome, and of the team's line-up projected (points), idle (players
    who could not play), places, optimal (points of the best line-up); a team plays once a period.
    """
    c = F.col
    w = Window.partitionBy(period)
    own = Window.partitionBy("team")
    x = facts.withColumns({"_rank": F.rank().over(w.orderBy(c("score").desc())), "_n": F.count("*").over(w), "_mean": F.avg("score").over(own), "_sd": F.stddev_pop("score").over(own)})
    opp = x.select(period, c("team").alias("opponent"), *(c(k).alias(f"_o{k}") for k in ("_rank", "_mean", "_sd", "score", "idle", "places", "optimal")))
    x = x.join(opp, [period, "opponent"])
    clip = lambda v, m: F.greatest(F.lit(-m), F.least(F.lit(m), v))
    others = (c("_n") - 1).cast("double")
    scheduling = (
        F.when(c("_rank") < c("_o_rank"), (c("_rank") - 1) / others)
        .when(c("_rank") > c("_o_rank"), -(c("_n") - c("_rank")) / others)
        .when(c("_rank") < c("_n") / 2, -(c("_n") - c("_rank") - 1) / others / 2)
        .otherwise((c("_rank") - 1) / others / 2)
    )
    z = lambda score, mean, sd: F.when(c(sd) > 0, clip((c(score) - c(mean)) / c(sd) / 2, 1.0)).otherwise(0.0)
    gap = clip((c("score") - c("against")) / F.least("score", "against"), 0.2) / 0.2
    margin = F.when((c("score") != 0) & (c("against") != 0), F.signum(gap) - gap).otherwise(0.0)
    surprise = F.when(c("projected") != 0, clip((c("score") - c("projected")) / c("projected"), 0.25) / 0.25).otherwise(0.0)
    idle = lambda n, of: -c(n) / c(of)
    shift = F.element_at(F.array(*map(F.lit, IDLE_SHIFTS)), c(week))

    def against_actual(best, theirs):
        return F.when((c("outcome") == -1) & (c(best) > c(theirs)), -1.0).when((c("outcome") == -1) & (c(best) == c(theirs)), -0.5).when((c("outcome") == 0) & (c(best) > c(theirs)), -0.5).otherwise(0.0)

    a, b = c("optimal"), c("_ooptimal")
    both = F.when(c("outcome") == 1, F.when(a < b, 1.0).when(a == b, 0.5).otherwise(0.0)).when(c("outcome") == -1, F.when(a > b, -1.0).when(a == b, -0.5).otherwise(0.0)).otherwise(F.when(a > b, -0.5).when(a < b, 0.5).otherwise(0.0))
    terms = {
        "scheduling": (LUCK["scheduling"], scheduling),
        "history": (LUCK["history"] * 2 / 3, z("score", "_mean", "_sd")),
        "opp_history": (LUCK["history"] / 3, z("_oscore", "_o_mean", "_o_sd")),
        "margin": (LUCK["margin"], margin),
        "projection": (LUCK["projection"], surprise - SHIFTS["projection"]),
        "idle": (LUCK["idle"] * 2 / 3, idle("idle", "places") - shift),
        "opp_idle": (LUCK["idle"] / 3, idle("_oidle", "_oplaces") - shift),
        "optimal_actual": (LUCK["optimal_actual"] * 2 / 3, against_actual("optimal", "_oscore") - SHIFTS["optimal_actual"]),
        "opp_optimal_actual": (LUCK["optimal_actual"] / 3, against_actual("_ooptimal", "score") - SHIFTS["opp_optimal_actual"]),
        "optimal_optimal": (LUCK["optimal_optimal"], both),
    }
    x = x.withColumns({f"luck_{k}": v for k, (_, v) in terms.items()})
    total = sum((n * c(f"luck_{k}") for k, (n, _) in terms.items()), F.lit(0.0))
    return x.select(*facts.columns, *(f"luck_{k}" for k in terms), total.alias("luck"))


def remaining_difficulty(schedule: DataFrame, played: DataFrame, power: DataFrame) -> DataFrame:
    """team, opp_points_for, opp_win_pct, opp_power_rank, difficulty: what the opponents still to come have shown, per team of a schedule (team, opponent).

    played: team, score, outcome of games so far; power: team, power.  Means pool the opponents' games (win percentage: decided ones), an opponent counts as often
    as it is met.  Each mean is scaled over the teams' means onto the range of the teams' own values, the lower end where it does not vary; difficulty is the mean
    of the three.
    """
    won, lost = F.count_if(F.col("outcome") == 1), F.count_if(F.col("outcome") == -1)
    own = played.groupBy(F.col("team").alias("opponent")).agg(F.count("*").alias("_n"), F.sum("score").alias("_points"), won.alias("_won"), (won + lost).alias("_decided")).join(power.withColumnRenamed("team", "opponent"), "opponent")
    pct = lambda w, d: F.coalesce(F.try_divide(w, d), F.lit(0.0))
    values = {"opp_points_for": F.col("_points") / F.col("_n"), "opp_win_pct": pct(F.col("_won"), F.col("_decided")), "opp_power_rank": F.col("power")}
    bounds = own.agg(*(f(v).alias(f"{p}{c}") for c, v in values.items() for p, f in (("_low_", F.min), ("_high_", F.max))))  # one row
    x = schedule.join(own, "opponent").groupBy("team").agg((F.sum("_points") / F.sum("_n")).alias("opp_points_for"), pct(F.sum("_won"), F.sum("_decided")).alias("opp_win_pct"), F.avg("power").alias("opp_power_rank"))
    w = Window.partitionBy()  # a row a team

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.col(f"_low_{c}") + F.coalesce(F.try_divide(F.col(c) - low, high - low), F.lit(0.0)) * (F.col(f"_high_{c}") - F.col(f"_low_{c}"))

    return x.crossJoin(bounds).select("team", *values, (sum((scaled(c) for c in values), F.lit(0.0)) / 3).alias("difficulty"))


def year_adjusted(df: DataFrame, year: str, score: str, base_year: int, also: dict[str, str] | None = None):
    """Scores in units of the base year's median; also: further columns in the same units, under new names."""
    m = df.groupBy(year).agg(F.median(score).alias("_m"))
    b = m.where(F.col(year) == base_year).select(F.col("_m").alias("_b"))
    unit = F.col("_m") / F.col("_b")
    return df.join(m, year).crossJoin(F.broadcast(b)).withColumns({"adjusted": F.col(score) / unit} | {out: F.col(c) / unit for c, out in (also or {}).items()}).drop("_m", "_b")


def best_lineup(df: DataFrame, team: list[str], player: str, points: str, eligible: str, slots: dict[str, int]) -> DataFrame:
    """Greedy line-up: slots by length of name then name, each takes its best eligible players who are left; one window a slot, over one shuffle."""
    x = df.where(F.col(points).isNotNull()).select(*team, player, points, eligible).withColumn("_used", F.lit(False))
    for s in sorted(slots, key=lambda s: (len(s), s)):
        free = ~F.col("_used") & F.array_contains(eligible, s)
        place = F.sum(free.cast("int")).over(Window.partitionBy(*team).orderBy(F.col(points).desc(), player).rowsBetween(Window.unboundedPreceding, 0))
        x = x.withColumn("_used", F.col("_used") | free & (place <= slots[s]))
    return x.groupBy(*team).agg(F.sum(F.when(F.col("_used"), F.col(points)).otherwise(0.0)).alias("best"), F.count_if("_used").cast("int").alias("used"))


def is_playoff(games: DataFrame, by: list[str], week: str, regular: int, spots: int) -> DataFrame:
    """games with is_playoff: after the regular season, two teams, a home team that stands among the `spots`, and, beyond the first
    such week, an away team that has not lost since and won its last game (a tie goes by points_for).

    games: by, week, home, away, home_standing, away_losses (since the regular season), away_last, away_last_against, away_points_for, last_points_for.
    """
    first = F.col(week) == regular + 1
    won = (F.col("away_last") > F.col("away_last_against")) | (F.col("away_last") == F.col("away_last_against")) & (F.col("away_points_for") > F.col("last_points_for"))
    ok = (F.col(week) > regular) & F.col("away").isNotNull() & (F.col("home_standing") <= spots) & (first | (F.col("away_losses") == 0) & won)
    return games.withColumn("is_playoff", F.coalesce(ok, F.lit(False)))


def lineup_measures(df: DataFrame, by: list[str], slot: str, points: str, projected: str, status: str, tds: str, bench: tuple[str, ...] = ("BE", "IR")) -> DataFrame:
    """Per line-up: points of starters and bench, projection, surprise, touchdowns, idle starters, the best three, mean per slot kept by the caller."""
    starts = ~F.coalesce(F.col(slot).isin(*bench), F.lit(False))
    s = lambda c: F.sum(F.when(starts, F.col(c)).otherwise(0.0))
    top = F.slice(F.sort_array(F.collect_list(F.when(starts, F.col(points))), asc=False), 1, 3)
    g = df.groupBy(*by).agg(s(points).alias("actual"), s(projected).alias("projected"), F.sum(F.when(F.col(slot) == bench[0], F.col(points)).otherwise(0.0)).alias("bench"), s(tds).alias("touchdowns"), F.count_if(starts & (F.col(status) == "bye")).alias("byes"), F.count_if(starts & (F.col(status) == "inactive")).alias("inactive"), F.aggregate(top, F.lit(0.0), lambda a, v: a + v).alias("trio"))
    return g.withColumn("surprise", F.col("actual") - F.col("projected"))


def weekly_finish(period: str, score: str):
    return F.rank().over(Window.partitionBy(period).orderBy(F.col(score).desc()))


def extremes(df: DataFrame, by: list[str], name: str, metrics: list[str]) -> DataFrame:
    """Per metric the best and the worst value with all names that have them."""
    x = df.unpivot([*by, name], metrics, "metric", "value").where("value IS NOT NULL")
    w = Window.partitionBy(*by, "metric")
    x = x.withColumns({"_hi": F.max("value").over(w), "_lo": F.min("value").over(w)})
    names = lambda m: F.array_join(F.array_sort(F.collect_set(F.when(F.col("value") == F.col(m), F.col(name)))), ", ")
    return x.groupBy(*by, "metric").agg(F.max("_hi").alias("best"), names("_hi").alias("best_names"), F.min("_lo").alias("worst"), names("_lo").alias("worst_names"))


def division_standings(facts: DataFrame, division: str) -> DataFrame:
    """Place of each team in its division by wins, then points, then name."""
    g = facts.groupBy(division, "team").agg(F.count_if(F.col("outcome") == 1).alias("wins"), F.sum("score").alias("points"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy(division).orderBy(F.col("wins").desc(), F.col("points").desc(), "team")))


# The weights of dominance, mean score and mean margin.
DOMINANCE, SCORED, MARGIN = 0.8, 0.15, 0.05


def power_ranking(facts: DataFrame) -> DataFrame:
    """team, power: two-step dominance (row sums of the matrix of wins and of its square), with the whole parts of mean score and mean margin.

    A row sum of the square is the wins over each opponent times that opponent's wins, so counts per pair meet totals per team and no win meets another.
    """
    pairs = facts.where(F.col("outcome") == 1).groupBy("team", "opponent").agg(F.count("*").alias("_n"))
    wins = pairs.groupBy(F.col("team").alias("opponent")).agg(F.sum("_n").alias("_wins"))
    dominance = pairs.join(wins, "opponent", "left").groupBy("team").agg(F.sum(F.col("_n") * (1 + F.coalesce("_wins", F.lit(0)))).alias("_d"))
    mean = facts.groupBy("team").agg(F.avg("score").alias("_s"), F.avg(F.col("score") - F.col("against")).alias("_m"))
    power = DOMINANCE * F.coalesce("_d", F.lit(0)) + SCORED * F.col("_s").cast("long") + MARGIN * F.col("_m").cast("long")
    return mean.join(dominance, "team", "left").select("team", F.round(power, 2).alias("power"))


def expected_standings(facts: DataFrame, period: str) -> DataFrame:
    """Wins against everybody every period (strength of a team without its schedule), beside the wins it got."""
    w = Window.partitionBy(period)
    below = F.count("*").over(w) - F.rank().over(w.orderBy(F.col("score").desc())) - (F.count("*").over(Window.partitionBy(period, "score")) - 1)
    x = facts.withColumn("_ap", below / F.nullif(F.count("*").over(w) - 1, F.lit(0)))
    return x.groupBy("team").agg(F.sum((F.col("outcome") == 1).cast("double")).alias("won"), F.sum("_ap").alias("deserved"))
