"""Queries of the league's reports: nations are teams, months are weeks, and a team's orders of a month are its line-up."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import history, reports, windows
from ..operators.reports import Award, Stat
from .modelling import _GAMES, _facts
from .registry import query

r = lambda c, n=6: F.round(c, n).alias(c)

SLOTS = {"qb": "QB", "rb": "RB", "wr": "WR", "te": "TE", "flex": "RB/WR/TE", "dst": "D/ST", "k": "K"}
STARTERS = {"QB": 1, "RB": 2, "WR": 2, "TE": 1, "RB/WR/TE": 1, "D/ST": 1, "K": 1}
POSITIONS = ["QB", "RB", "RB", "WR", "WR", "TE", "D/ST", "K"]

_PLAYERS = f"""py AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS period, c_nationkey AS team, o_orderkey, o_custkey, ({POSITIONS!r})[o_custkey % 8 + 1] AS pos, round(o_totalprice / 1000, 0) AS pts, round(o_totalprice / 1100, 0) + o_orderkey % 9 AS proj FROM orders JOIN customer ON o_custkey = c_custkey),
pz AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 'BE' WHEN pos IN ('RB', 'WR', 'TE') AND o_orderkey % 7 = 0 THEN 'RB/WR/TE' ELSE pos END AS slot, CASE WHEN o_orderkey % 11 = 0 THEN 'inactive' ELSE 'active' END AS st FROM py),
pa AS (SELECT *, row_number() OVER (PARTITION BY period, team, pos ORDER BY pts DESC, o_orderkey) <= CASE WHEN pos IN ('RB', 'WR') THEN 2 ELSE 1 END AS u1, row_number() OVER (PARTITION BY period, team, slot <> 'BE' ORDER BY pts DESC) AS tr FROM pz),
pb AS (SELECT *, u1 OR (pos IN ('RB', 'WR', 'TE') AND row_number() OVER (PARTITION BY period, team, u1, pos IN ('RB', 'WR', 'TE') ORDER BY pts DESC, o_orderkey) = 1) AS u2 FROM pa),
lm AS (SELECT period, team, sum(CASE WHEN slot <> 'BE' THEN pts ELSE 0 END) AS actual, sum(CASE WHEN slot <> 'BE' THEN pts - proj ELSE 0 END) AS surprise, sum(CASE WHEN slot = 'BE' THEN pts ELSE 0 END) AS bench, sum(CASE WHEN slot <> 'BE' THEN o_custkey % 3 ELSE 0 END) AS touchdowns, -count(*) FILTER (WHERE slot <> 'BE' AND st = 'inactive') AS active, sum(CASE WHEN slot <> 'BE' AND tr <= 3 THEN pts ELSE 0 END) AS trio, sum(CASE WHEN u2 THEN pts ELSE 0 END) AS best, {', '.join(f"round(avg(CASE WHEN slot = '{s}' THEN pts END), 0) AS {c}" for c, s in SLOTS.items())} FROM pb GROUP BY period, team)"""
_EFFICIENCY = "CASE WHEN best > 0 THEN round(1000 * actual / best, 0) END AS efficiency"


def _lineups(t):
    """A line-up's measures per month and team, in whole points."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    flexible = F.col("pos").isin("RB", "WR", "TE")
    x = t.orders.join(t.customer, c == F.col("c_custkey")).select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("period"), F.col("c_nationkey").alias("team"), "o_orderkey", F.element_at(F.array(*map(F.lit, POSITIONS)), (c % 8 + 1).cast("int")).alias("pos"), F.round(F.col("o_totalprice") / 1000, 0).alias("pts"), (F.round(F.col("o_totalprice") / 1100, 0) + k % 9).alias("proj"), (c % 3).alias("td"))
    x = x.withColumns({"slot": F.when(k % 5 == 0, "BE").when(flexible & (k % 7 == 0), "RB/WR/TE").otherwise(F.col("pos")), "st": F.when(k % 11 == 0, "inactive").otherwise("active"), "eligible": F.when(flexible, F.array("pos", F.lit("RB/WR/TE"))).otherwise(F.array("pos"))})
    by = ["period", "team"]
    m = history.lineup_measures(x, by, "slot", "pts", "proj", "st", "td").drop("projected", "byes")
    s = reports.slot_means(x, by, "slot", "pts", SLOTS)
    b = history.best_lineup(x, by, "o_orderkey", "pts", "eligible", STARTERS).drop("used")
    m = m.join(s, by).join(b, by).withColumn("active", -F.col("inactive"))
    return m.select(*by, "actual", "surprise", "bench", "touchdowns", "active", "trio", "best", *(F.round(c, 0).alias(c) for c in SLOTS), F.when(F.col("best") > 0, F.round(1000 * F.col("actual") / F.col("best"), 0)).alias("efficiency"))


_HISTORY = f"""{_GAMES}, {_PLAYERS}, ly AS (SELECT *, {_EFFICIENCY} FROM lm),
ga AS (SELECT *, (period - 1) // 12 AS season FROM (SELECT *, row_number() OVER (PARTITION BY period, team ORDER BY opponent) AS rn FROM facts) WHERE rn = 1),
md AS (SELECT season, median(score) AS m FROM ga GROUP BY 1), fm AS (SELECT season, m / (SELECT m FROM md WHERE season = 1996) AS unit FROM md),
sk AS (SELECT ga.*, row_number() OVER (PARTITION BY team, season ORDER BY period) - row_number() OVER (PARTITION BY team, season, outcome ORDER BY period) AS island FROM ga),
hs AS (SELECT sk.*, score - against AS margin, score / unit AS score_adj, against / unit AS against_adj, CAST(outcome = 1 AS INT) AS win, CAST(outcome = -1 AS INT) AS loss, outcome * row_number() OVER (PARTITION BY team, season, outcome, island ORDER BY period) AS streak, sum(CAST(outcome = 1 AS INT)) OVER (PARTITION BY team, season ORDER BY period) AS season_wins, ly.* EXCLUDE (period, team) FROM sk JOIN fm USING (season) JOIN ly USING (period, team)),
h AS (SELECT * FROM hs WHERE (period - 1) % 12 < 11 OR (score + against) % 2 = 0)"""


def _history(t):
    """A row a team and month: the game, its line-up's measures, streak, wins of the season, scores in units of 1996; games that count."""
    return t.once("history", lambda: _counted(t))


def _counted(t):
    w = Window.partitionBy("period", "team").orderBy("opponent")
    g = _facts(t).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").withColumn("season", F.floor((F.col("period") - 1) / 12))
    g = history.year_adjusted(g, "season", "score", 1996, {"against": "against_adj"}).withColumnRenamed("adjusted", "score_adj")
    g = windows.streaks(g, "outcome", ["team", "season"], "period").withColumns({"margin": F.col("score") - F.col("against"), "win": (F.col("outcome") == 1).cast("int"), "loss": (F.col("outcome") == -1).cast("int")})
    g = g.withColumn("season_wins", windows.running_sum("win", ["team", "season"], "period"))
    return g.join(_lineups(t), ["period", "team"]).where("(period - 1) % 12 < 11 OR (score + against) % 2 = 0")


# The measures that the reports name, at both ends.
BOTH = {"mean_score": ("score", "mean"), "score_game": ("score", "row"), "longest_streak": ("streak", "row"), "mean_margin": ("margin", "mean"), "mean_efficiency": ("efficiency", "mean"), "mean_bench": ("bench", "mean")} | {f"mean_{s}": (s, "mean") for s in SLOTS}
SEASON = BOTH | {"active_streak": ("streak", "newest"), "mean_against": ("against_adj", "mean")}


def _awards(of: dict[str, tuple[str, str]]) -> list[Award]:
    return [Award(f"{'most' if high else 'least'} {n}", m, how, high) for n, (m, how) in of.items() for high in (True, False)]


SEASON_AWARDS = [Award("most wins", "win", "sum"), Award("most losses", "loss", "sum"), *_awards(SEASON)]
ALL_TIME_AWARDS = [Award("most wins", "win", "sum"), Award("most losses", "loss", "sum"), *_awards(BOTH), Award("most mean_against", "against"), Award("least mean_against", "against_adj", high=False)]


def _awards_sql(of: list[Award], by: str) -> str:
    f = lambda a: {"sum": "sum", "mean": "avg"}.get(a.how) or ("max" if a.high else "min")
    each = " UNION ALL ".join(f"SELECT {by}team, '{a.name}' AS award, {a.high} AS high, round(CAST({f(a)}({a.measure}){' FILTER (WHERE period = ends)' if a.how == 'newest' else ''} AS DOUBLE), 6) AS value FROM he GROUP BY {by}team" for a in of)
    over = f"PARTITION BY {by}award"
    return f"""WITH {_HISTORY}, he AS (SELECT *, max(period) OVER ({'PARTITION BY ' + by[:-2] if by else ''}) AS ends FROM h), aw AS ({each}),
ax AS (SELECT *, CASE WHEN high THEN max(value) OVER w ELSE min(value) OVER w END AS best FROM aw WHERE value IS NOT NULL WINDOW w AS ({over}))
SELECT {by}award, best AS value, string_agg(CAST(team AS VARCHAR), ', ' ORDER BY CAST(team AS VARCHAR)) AS leaders FROM ax WHERE value = best GROUP BY {by}award, best"""


@query(_awards_sql(SEASON_AWARDS, "season, "))
def season_awards(t):
    """Every season's bests and worsts, through its newest month."""
    return reports.awards(_history(t), "team", "period", SEASON_AWARDS, ("season",), 6)


@query(_awards_sql(ALL_TIME_AWARDS, ""))
def all_time_awards(t):
    return reports.awards(_history(t), "team", "period", ALL_TIME_AWARDS, digits=6)


# How deep the records of each measure are announced.
STATS = [
    *(Stat(s, 3, 3, 3, 3) for s in ("score", "score_adj", "margin", "streak")), *(Stat(s) for s in ("efficiency", "trio", *SLOTS, "bench")),
    Stat("season_wins", 3, 0, 1, 0), Stat("surprise", 5, 5, 3, 3),
]


def _records_sql() -> str:
    each = " UNION ALL ".join(f"SELECT '{s.name}' AS stat, '{end}' AS \"end\", {a} AS dl, {b} AS df, season, period, team, CAST({s.name} AS DOUBLE) AS value, {k} * CAST({s.name} AS DOUBLE) AS key FROM h WHERE {s.name} IS NOT NULL" for s in STATS for end, k, a, b in (("top", 1, s.top, s.franchise_top), ("low", -1, s.low, s.franchise_low)))
    return f"""WITH {_HISTORY}, lg AS ({each}), kn AS (SELECT team FROM h GROUP BY team HAVING count(DISTINCT season) > 1 AND max(season) = (SELECT max(season) FROM h)),
rl AS (SELECT *, rank() OVER (PARTITION BY stat, "end" ORDER BY key DESC) AS place FROM lg), rf AS (SELECT *, rank() OVER (PARTITION BY stat, "end", team ORDER BY key DESC) AS place FROM lg WHERE team IN (SELECT team FROM kn)),
al AS (SELECT 'league' AS scope, stat, "end", place, team, value, period FROM rl WHERE place <= dl UNION ALL SELECT 'franchise', stat, "end", place, team, value, period FROM rf WHERE place <= df)
SELECT scope, stat, "end", CAST(place AS INTEGER) AS place, team, round(value, 6) AS value FROM al WHERE period >= (SELECT max(period) - 11 FROM h)"""


@query(_records_sql())
def weekly_records(t):
    """Records of the league and of its teams that the newest twelve months have set, against all months."""
    h = _history(t)
    x = h.crossJoin(F.broadcast(h.agg((F.max("period") - 11).alias("_since"))))
    return reports.records_set(x, "team", "season", STATS, F.col("period") >= F.col("_since")).withColumn("value", F.round("value", 6))


MEASURES = ["score", "best", "touchdowns", "trio", "efficiency", "surprise", *SLOTS, "bench", "active"]
_TIDBITS = " UNION ALL ".join(f"SELECT period, '{m}' AS measure, team, CAST({m} AS DOUBLE) AS value FROM h WHERE {m} IS NOT NULL" for m in MEASURES)


@query(f"WITH {_HISTORY}, l AS ({_TIDBITS}), k AS (SELECT *, row_number() OVER (PARTITION BY period, measure ORDER BY value, team) AS up, row_number() OVER (PARTITION BY period, measure ORDER BY value DESC, CASE WHEN measure = 'score' THEN team ELSE -team END) AS down FROM l) SELECT b.period, b.measure, b.team AS best, b.value AS best_value, w.team AS worst, w.value AS worst_value FROM (SELECT * FROM k WHERE down = 1) b JOIN (SELECT * FROM k WHERE up = 1) w ON w.period = b.period AND w.measure = b.measure")
def week_tidbits(t):
    return reports.tidbits(_history(t), ["period"], "team", MEASURES, ("score",))


@query(f"""WITH {_HISTORY}, m AS (SELECT team, opponent, count(*) AS games, count(*) FILTER (WHERE outcome = 1) AS wins, count(*) FILTER (WHERE outcome = -1) AS losses, count(*) FILTER (WHERE outcome = 0) AS ties, round(avg(score), 6) AS points_for, round(avg(against), 6) AS points_against, round(avg(margin), 6) AS margin FROM h GROUP BY ALL),
nw AS (SELECT * FROM (SELECT team, opponent, period, score, against, row_number() OVER (PARTITION BY team, opponent ORDER BY period DESC, score DESC, against DESC) AS rn FROM h) WHERE rn = 1),
st AS (SELECT team, n_regionkey AS division, count(*) FILTER (WHERE outcome = 1) AS won, count(*) FILTER (WHERE outcome = -1) AS lost, count(*) FILTER (WHERE outcome = 0) AS tied, round(avg(score), 6) AS mean, sum(score) AS points FROM h JOIN nation ON n_nationkey = team WHERE season = (SELECT max(season) FROM h) GROUP BY ALL),
sp AS (SELECT *, CAST(row_number() OVER (PARTITION BY division ORDER BY won DESC, points DESC, team) AS INTEGER) AS place, count(*) OVER (PARTITION BY division) AS "of" FROM st)
SELECT m.team, m.opponent, games, wins, losses, ties, round(wins / games, 6) AS win_pct, points_for, points_against, m.margin, nw.period AS last_period, nw.score AS last_score, nw.against AS last_against, a.won, a.lost, a.tied, a.mean, a.place, a."of", b.won AS opp_won, b.lost AS opp_lost, b.tied AS opp_tied, b.mean AS opp_mean, b.place AS opp_place, b."of" AS opp_of
FROM m JOIN nw ON nw.team = m.team AND nw.opponent = m.opponent LEFT JOIN sp a ON a.team = m.team LEFT JOIN sp b ON b.team = m.opponent""")
def game_of_the_week(t):
    """The card of every pair of teams that has met."""
    x = reports.pair_cards(_history(t), "season", "period", t.nation.select(F.col("n_nationkey").alias("team"), F.col("n_regionkey").alias("division")))
    return x.withColumns({c: F.round(c, 6) for c in ("win_pct", "points_for", "points_against", "margin", "mean", "opp_mean")})
