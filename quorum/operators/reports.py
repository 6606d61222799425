"""Reports over a league's history: awards, records set in a week, tidbits of a week, cards of pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

TOP = "top"
LOW = "low"


@dataclass(frozen=True)
class Award:
    """The team with the most (or least) of a measure: its sum, its mean, its best single row, or its newest row."""

    name: str
    measure: str
    how: str = "mean"  # sum, mean, row, newest
    high: bool = True

    def value(self, newest: Column) -> Column:
        c = F.col(self.measure)
        c = F.when(newest, c) if self.how == "newest" else c
        f = {"sum": F.sum, "mean": F.avg}.get(self.how) or (F.max if self.high else F.min)
        return f(c).cast("double")


def awards(df: DataFrame, team: str, period: str, of: list[Award], by: tuple[str, ...] = (), digits: int = 9) -> DataFrame:
    """by, award, value, leaders: one row per award, all teams that tie joined by ", " in order of name, each once.

    All awards come from one aggregation per team; the newest period is that of the group (by).  Values are compared at `digits` places,
    since sums in another order differ in their last bits.  A team without a value wins nothing; an award without any has no row.
    Names of awards must differ.
    """
    if len({a.name for a in of}) < len(of):
        raise ValueError("awards of one name")
    ends = df.groupBy(*by).agg(F.max(period).alias("_last"))
    x = df.join(ends, list(by)) if by else df.crossJoin(F.broadcast(ends))  # one row
    newest = F.col(period) == F.col("_last")
    per = x.groupBy(*by, team).agg(*(F.round(a.value(newest), digits).alias(f"_a{i}") for i, a in enumerate(of)))
    rows = F.array(*(F.struct(F.lit(a.name).alias("award"), F.lit(a.high).alias("_high"), F.col(f"_a{i}").alias("value")) for i, a in enumerate(of)))
    long = per.select(*by, team, F.inline(rows)).where("value IS NOT NULL")
    tied = long.groupBy(*by, "award", "_high", "value").agg(F.array_join(F.array_sort(F.collect_set(F.col(team).cast("string"))), ", ").alias("_names"))
    key = F.when(F.col("_high"), F.col("value")).otherwise(-F.col("value"))
    return tied.groupBy(*by, "award").agg(F.max_by("value", key).alias("value"), F.max_by("_names", key).alias("leaders"))


@dataclass(frozen=True)
class Stat:
    """A measure whose records are announced: how deep, in the league and in a franchise, at either end (0: not)."""

    name: str
    top: int = 5
    low: int = 5
    franchise_top: int = 1
    franchise_low: int = 1


def records_set(df: DataFrame, team: str, season: str, stats: list[Stat], at: Column) -> DataFrame:
    """scope (league or franchise), stat, end (top or low), place, and the rows' team and value: records among the rows of `at`, over all rows.

    Places count better rows, so ties share one (nulls have none).  Franchise records are those of teams of the newest season that
    played in two seasons or more.  A place is needed only as deep as the deepest record announced, so each task passes on but its
    own such rows before the shuffle.
    """
    ends = [(s.name, end, sign, league, own) for s in stats for end, sign, league, own in ((TOP, 1, s.top, s.franchise_top), (LOW, -1, s.low, s.franchise_low))]
    rows = F.array(*(F.struct(F.lit(n).alias("stat"), F.lit(end).alias("end"), F.lit(a).alias("_league"), F.lit(b).alias("_own"), F.col(n).cast("double").alias("value"), (sign * F.col(n)).cast("double").alias("_key")) for n, end, sign, a, b in ends))
    long = df.select(F.col(team).alias("team"), at.alias("_at"), F.inline(rows)).where("value IS NOT NULL")
    seasons = df.groupBy(F.col(team).alias("team")).agg(F.min(season).alias("_first"), F.max(season).alias("_last"))
    newest = df.agg(F.max(season).alias("_newest"))  # one row
    known = seasons.crossJoin(F.broadcast(newest)).where("_first < _last AND _last = _newest").select("team")

    def scope(x: DataFrame, name: str, depth: str, keys: list[str]) -> DataFrame:
        most = max(b if depth == "_own" else a for _, _, _, a, b in ends)
        w = Window.partitionBy("stat", "end", *keys).orderBy(F.col("_key").desc())
        x = x.where(F.col(depth) > 0).withColumn("place", F.rank().over(w)).where(F.col("place") <= most)
        return x.where(F.col("_at") & (F.col("place") <= F.col(depth))).select(F.lit(name).alias("scope"), "stat", "end", "place", "team", "value")

    return scope(long, "league", "_league", []).unionByName(scope(long.join(known, "team", "leftsemi"), "franchise", "_own", ["team"]))


def tidbits(df: DataFrame, by: list[str], team: str, measures: list[str], first: tuple[str, ...] = ()) -> DataFrame:
    """by, measure, best, best_value, worst, worst_value: one team each, without ties.

    The worst is the first team that has the least, the best the last that has the most, or the first one for the measures in `first`.
    Nulls take no part; a measure that is null throughout has no row.
    """
    rows = F.array(*(F.struct(F.lit(m).alias("measure"), F.lit(m in first).alias("_first"), F.col(m).cast("double").alias("_v")) for m in measures))
    x = df.select(*by, F.col(team).alias("_t"), F.inline(rows)).where("_v IS NOT NULL")
    low = F.min(F.struct("_v", "_t"))
    high = F.max(F.struct("_v", "_t"))
    firsts = F.min(F.struct((-F.col("_v")).alias("_v"), F.col("_t")))
    g = x.groupBy(*by, "measure", "_first").agg(low.alias("_low"), high.alias("_high"), firsts.alias("_firsts"))
    best = F.when(F.col("_first"), F.col("_firsts._t")).otherwise(F.col("_high._t"))
    return g.select(*by, "measure", best.alias("best"), F.col("_high._v").alias("best_value"), F.col("_low._t").alias("worst"), F.col("_low._v").alias("worst_value"))


def slot_means(df: DataFrame, by: list[str], slot: str, points: str, slots: dict[str, str]) -> DataFrame:
    """Mean points per slot, one column each (name to slot); null where a line-up has none."""
    return df.groupBy(*by).agg(*(F.avg(F.when(F.col(slot) == s, F.col(points))).alias(c) for c, s in slots.items()))


def pair_cards(facts: DataFrame, season: str, period: str, divisions: DataFrame) -> DataFrame:
    """Per ordered pair that met: games, wins, losses, ties, win share, mean scores and margin, their newest game, and how both stand now.

    facts: season, period, team, opponent, score, against, outcome; divisions: team, division.  How a team stands is its record and mean
    score of the newest season, its place in its division (by wins, then points, then name) and the division's size; a team that did not play
    in it, or has no division, stands nowhere (nulls).  Of games of one period the one with the higher score counts as the newest.
    """
    o = F.col("outcome")
    n = lambda v: F.count_if(o == v)
    met = facts.groupBy("team", "opponent").agg(
        F.count("*").alias("games"), n(1).alias("wins"), n(-1).alias("losses"), n(0).alias("ties"), (n(1) / F.count("*")).alias("win_pct"), F.avg("score").alias("points_for"), F.avg("against").alias("points_against"),
        F.avg(F.col("score") - F.col("against")).alias("margin"), F.max(F.struct(F.col(period).alias("_p"), F.col("score").alias("_s"), F.col("against").alias("_a"))).alias("_newest"))
    last = facts.agg(F.max(season).alias("_now"))  # one row
    now = facts.crossJoin(F.broadcast(last)).where(F.col(season) == F.col("_now"))
    won, points = F.col("won"), F.col("_points")
    stand = now.groupBy("team").agg(n(1).alias("won"), n(-1).alias("lost"), n(0).alias("tied"), F.avg("score").alias("mean"), F.sum("score").alias("_points")).join(divisions, "team", "left")
    w = Window.partitionBy("division")
    placed = F.when(F.col("division").isNotNull(), F.row_number().over(w.orderBy(won.desc(), points.desc(), "team")))
    stand = stand.select("team", "won", "lost", "tied", "mean", placed.alias("place"), F.when(F.col("division").isNotNull(), F.count("*").over(w)).alias("of"))
    theirs = stand.select(F.col("team").alias("opponent"), *(F.col(c).alias(f"opp_{c}") for c in stand.columns[1:]))
    x = met.join(stand, "team", "left").join(theirs, "opponent", "left")
    card = ["games", "wins", "losses", "ties", "win_pct", "points_for", "points_against", "margin"]
    return x.select("team", "opponent", *card, F.col("_newest._p").alias("last_period"), F.col("_newest._s").alias("last_score"), F.col("_newest._a").alias("last_against"), *stand.columns[1:], *theirs.columns[1:])
