"""Queries that assemble a board, its byes, depth charts of two schemas and a season's staff from several sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import board, handcuff, usage
from .registry import query

r = lambda c, n=6: F.round(c, n).alias(c)

FLEX = {"FLEX": ["ECONOMY", "STANDARD", "SMALL"]}
SLOTS = [("ECONOMY", 2), ("STANDARD", 2), ("FLEX", 1), ("SMALL", 1), ("MEDIUM", 1), ("BE", 6)]
ALIASES = {"T1": "T01", "T2": "T02", "T99": "T98"}
STARTERS = {"A": 1, "N": 3, "R": 2}

# a game is an order of a nation against another, in neither one's month off
_SCHEDULE = "sc AS (SELECT 'T' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS home, 'T' || lpad(CAST((c_nationkey + 1 + o_custkey % 24) % 25 AS VARCHAR), 2, '0') AS away, CAST(month(o_orderdate) AS INTEGER) AS week, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice / 50000, 1) - 4 END AS spread FROM orders JOIN customer ON o_custkey = c_custkey WHERE month(o_orderdate) NOT IN (c_nationkey % 6 + 4, (c_nationkey + 1 + o_custkey % 24) % 25 % 6 + 4))"
_BYES = f"""{_SCHEDULE}, pd AS (SELECT DISTINCT home AS team, week FROM sc UNION SELECT away, week FROM sc), gr AS (SELECT a.team, b.week FROM (SELECT DISTINCT team FROM pd) a CROSS JOIN (SELECT DISTINCT week FROM pd) b),
ms AS (SELECT team, min(week) AS bye FROM (SELECT * FROM gr EXCEPT SELECT * FROM pd) GROUP BY team HAVING count(*) = 1), al(alias, team) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in ALIASES.items())}), sp AS (SELECT alias AS team, bye FROM al JOIN ms USING (team)), bw AS (SELECT * FROM ms WHERE team NOT IN (SELECT team FROM sp) UNION ALL SELECT * FROM sp)"""


def _schedule(t):
    code = lambda c: F.concat(F.lit("T"), F.lpad(c.cast("string"), 2, "0"))
    home, away, week = F.col("c_nationkey"), (F.col("c_nationkey") + 1 + F.col("o_custkey") % 24) % 25, F.month("o_orderdate")
    x = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).where((week != home % 6 + 4) & (week != away % 6 + 4))
    return x.select(code(home).alias("home"), code(away).alias("away"), week.alias("week"), F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") / 50000, 1) - 4).alias("spread"))


def _byes(t):
    return board.bye_periods(t.once("schedule", lambda: _schedule(t)), "home", "away", "week", ALIASES)


@query(f"WITH {_BYES} SELECT team, bye FROM bw")
def bye_weeks(t):
    return _byes(t)


_FULL = f"""{_BYES}, pj AS (SELECT p_partkey AS id, p_type AS pos, CASE WHEN p_partkey % 11 <> 0 THEN round(p_retailprice / 10, 1) END AS points, 'T' || lpad(CAST(p_partkey % 27 AS VARCHAR), 2, '0') AS team, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS a, CASE WHEN p_partkey % 6 <> 0 THEN p_size END AS b FROM part),
mk AS (SELECT p_partkey AS id, CAST(least(p_size * 5 + p_partkey % 13, 170) AS DOUBLE) AS adp, 3000 - p_partkey AS place, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS auction_value, p_size + 1 AS suggested_value FROM part WHERE p_partkey % 10 <> 0),
nd(pos, ded) AS (VALUES ('ECONOMY', 20), ('STANDARD', 20), ('SMALL', 10), ('MEDIUM', 10)), be AS (SELECT pos, points, id, row_number() OVER (PARTITION BY pos ORDER BY points DESC, id) - coalesce(ded, 0) AS k FROM pj LEFT JOIN nd USING (pos) WHERE pos IN ('ECONOMY', 'STANDARD', 'SMALL') AND points IS NOT NULL),
fw AS (SELECT pos, count(*) AS c FROM (SELECT * FROM be WHERE k BETWEEN 1 AND 10 ORDER BY points DESC, id LIMIT 10) z GROUP BY 1), rp AS (SELECT pos, CAST(round_even(sum(s), 0) AS BIGINT) AS need FROM (SELECT pos, ded::DOUBLE AS s FROM nd UNION ALL SELECT pos, c * (10.0::DOUBLE / (SELECT sum(c) FROM fw)) FROM fw) q GROUP BY pos HAVING round_even(sum(s), 0) >= 1),
lv AS (SELECT CAST(round_even(adp, 0) AS BIGINT) AS level, count(*) AS n, (SELECT count(*) FROM mk) AS al FROM mk GROUP BY 1, 3 ORDER BY n DESC, level LIMIT 1), pt AS (SELECT level - 1 AS plateau FROM lv WHERE n >= 2 AND n >= 0.05 * al),
jn AS (SELECT pj.*, adp, place, coalesce(auction_value, suggested_value) AS auction, need, CASE WHEN points IS NOT NULL THEN rank() OVER (PARTITION BY pj.pos ORDER BY points DESC NULLS LAST) END AS pos_rank, (SELECT plateau FROM pt) AS plateau, rank() OVER (PARTITION BY pj.pos ORDER BY place NULLS LAST) AS theirs FROM pj LEFT JOIN mk USING (id) LEFT JOIN rp USING (pos)),
vr AS (SELECT *, points - coalesce(max(CASE WHEN pos_rank >= coalesce(need, 1) THEN points END) OVER w, min(points) OVER w) AS vor, adp IS NOT NULL AND coalesce(adp < plateau, true) AS priced FROM jn WINDOW w AS (PARTITION BY pos)),
vk AS (SELECT *, CASE WHEN vor IS NOT NULL THEN rank() OVER (ORDER BY vor DESC NULLS LAST) END AS vor_rank, CASE WHEN priced THEN rank() OVER (PARTITION BY priced ORDER BY adp) END AS price_rank, CASE WHEN pos = 'ECONOMY' AND points IS NOT NULL THEN row_number() OVER (PARTITION BY team, pos ORDER BY points DESC NULLS LAST, id) END AS backfield_rank FROM vr),
oa AS (SELECT id, rank() OVER (ORDER BY adp) AS a FROM vr WHERE priced AND pos <> 'SMALL'), ov AS (SELECT id, rank() OVER (ORDER BY vor DESC) AS v FROM vr WHERE priced AND pos <> 'SMALL' AND vor IS NOT NULL), cm AS (SELECT id, a - v AS value FROM oa JOIN ov USING (id)),
st AS (SELECT team, avg(s) AS strength FROM (SELECT home AS team, spread AS s FROM sc WHERE spread IS NOT NULL UNION ALL SELECT away, -spread FROM sc WHERE spread IS NOT NULL) GROUP BY 1),
xy AS (SELECT strength AS x, y FROM (SELECT team, sum(points) AS y FROM pj WHERE points IS NOT NULL GROUP BY team) JOIN st USING (team)), ln AS (SELECT regr_intercept(y, x) AS intercept, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2 FROM xy HAVING count(*) >= 10)"""


@query(f"""WITH {_FULL} SELECT id, pos_rank, need AS replacement_rank, need IS NOT NULL AS startable, round(vor, 4) AS vor, vor_rank, plateau, priced, price_rank, pos = 'SMALL' AS is_streamed, value, place - vor_rank AS rank_delta, CASE WHEN place IS NOT NULL THEN theirs - pos_rank END AS pos_rank_delta,
CAST(auction AS BIGINT) AS auction, (a IS NULL AND b IS NULL) OR points IS NULL AS missing, CAST(10 AS INTEGER) AS teams, bye, backfield_rank, round(CASE WHEN backfield_rank = 2 THEN intercept + slope * strength END, 4) AS handcuff_carries, round(CASE WHEN backfield_rank = 2 THEN slope * (strength - (SELECT avg(strength) FROM st)) END, 4) AS handcuff_premium, round(r2, 6) AS handcuff_r2
FROM vk LEFT JOIN cm USING (id) LEFT JOIN bw USING (team) LEFT JOIN st USING (team) CROSS JOIN ln""")
def full_board(t):
    """A whole board in one call; its tiers, which SQL cannot express, are compared in the tests."""
    k = F.col("p_partkey")
    points = F.when(k % 11 != 0, F.round(F.col("p_retailprice") / 10, 1))
    pj = t.part.select(k.alias("id"), F.col("p_type").alias("pos"), points.alias("points"), F.concat(F.lit("T"), F.lpad((k % 27).cast("string"), 2, "0")).alias("team"), F.when(k % 4 != 0, F.col("p_size")).alias("a"), F.when(k % 6 != 0, F.col("p_size")).alias("b"))
    mk = t.part.where("p_partkey % 10 <> 0").select(k.alias("id"), F.least(F.col("p_size") * 5 + k % 13, F.lit(170)).cast("double").alias("adp"), (3000 - k).alias("place"), F.when(k % 3 == 0, F.col("p_size")).alias("auction_value"), (F.col("p_size") + 1).alias("suggested_value"))
    strength = handcuff.team_strength(t.once("schedule", lambda: _schedule(t)), [], "home", "away", "spread")
    sums = pj.where("points IS NOT NULL").groupBy("team").agg(F.sum("points").alias("y")).join(strength, "team")
    x = board.build(pj, mk, t.constants(SLOTS, "slot string, count int").where("slot <> 'BE'"), FLEX, 10, ident="id", group="pos", points="points", team="team", opinions=("a", "b"), streamed=("SMALL",), byes=_byes(t), handcuffs=(strength, handcuff.fit_line(sums, "strength", "y", 10), "ECONOMY"))
    long = ("pos_rank", "replacement_rank", "vor_rank", "plateau", "price_rank", "value", "rank_delta", "pos_rank_delta", "auction", "backfield_rank")
    return x.select("id", *(F.col(c).cast("long").alias(c) for c in long), "startable", r("vor", 4), "priced", "is_streamed", "missing", "teams", "bye", r("handcuff_carries", 4), r("handcuff_premium", 4), r("handcuff_r2"))


_CHARTS = f"""ch AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS season, 'T' || l_suppkey % 25 AS team, CASE WHEN l_partkey % 19 <> 0 THEN l_partkey END AS id, l_returnflag AS position, CASE WHEN year(l_shipdate) < 1996 THEN CASE l_linenumber % 5 WHEN 4 THEN NULL ELSE l_linenumber % 5 + 1 END ELSE greatest(l_linenumber - CASE l_returnflag WHEN 'N' THEN 3 WHEN 'R' THEN 2 ELSE 1 END + 1, 1) END AS raw, CASE WHEN year(l_shipdate) < 1996 THEN lpad(CAST(month(l_shipdate) AS VARCHAR), 2, '0') ELSE strftime(l_shipdate, '%Y-%m-%d') END AS as_of FROM lineitem),
cc AS (SELECT season, team, id, position, CAST(least(raw, 3) AS INTEGER) AS depth_rank, as_of FROM ch WHERE id IS NOT NULL AND raw IS NOT NULL)"""


def _charts(t):
    x = t.lineitem.select(F.year("l_shipdate").alias("season"), F.concat(F.lit("T"), (F.col("l_suppkey") % 25).cast("string")).alias("team"), F.when(F.col("l_partkey") % 19 != 0, F.col("l_partkey")).alias("id"), F.col("l_returnflag").alias("position"), "l_linenumber", "l_shipdate")
    n = F.col("l_linenumber") % 5
    coarse = x.where("season < 1996").select("season", F.col("team").alias("club"), "id", "position", F.when(n == 4, "x").otherwise(F.concat(F.lit(" "), (n + 1).cast("string"))).alias("depth"), F.month("l_shipdate").alias("week"))
    fine = x.where("season >= 1996").select("season", "team", "id", "position", F.col("l_linenumber").alias("place"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("at"))
    return usage.depth_charts(coarse, fine, "id", STARTERS)


@query(f"WITH {_CHARTS} SELECT season, team, id, position, depth_rank, as_of FROM cc")
def depth_schemas(t):
    return _charts(t)


@query(f"WITH {_CHARTS}, la AS (SELECT season, coalesce(max(as_of) FILTER (WHERE as_of < season || '-09-01' OR as_of < '1000'), max(as_of)) AS a FROM cc GROUP BY season), sn AS (SELECT cc.* FROM cc JOIN la ON la.season = cc.season AND as_of = a WHERE position IN ('N', 'R')), bt AS (SELECT *, row_number() OVER (PARTITION BY season, id ORDER BY depth_rank, team, position) AS rn FROM sn) SELECT season, id, depth_rank, depth_rank = 1 AS is_first, CAST(count(*) OVER (PARTITION BY season, team, position) AS INTEGER) AS depth_group, team AS depth_team FROM bt WHERE rn = 1")
def depth_both_schemas(t):
    """The charts before each season, of both schemas."""
    return usage.preseason_depth(_charts(t), "id", "season", "as_of", "team", "position", "depth_rank", usage.before_opening("as_of", "season"), ("N", "R"))


@query("""WITH bg AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, c_nationkey AS team, 'C' || c_custkey % 4 AS coach FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT season, team, coach, count(*) AS n FROM bg GROUP BY ALL),
pl AS (SELECT season, team, coach AS head_coach, n AS games_coached, CAST(sum(n) OVER w AS BIGINT) AS team_games, count(*) OVER w > 1 AS changed_midseason, row_number() OVER (PARTITION BY season, team ORDER BY n DESC, coach) AS rn FROM n WINDOW w AS (PARTITION BY season, team)),
lv AS (SELECT 1998 AS season, n_nationkey AS team, 'L' || n_name AS head_coach, CASE WHEN n_nationkey % 2 = 0 THEN 'O' || n_name END AS offence FROM nation WHERE n_nationkey % 3 <> 0), cr AS (SELECT CAST(1992 + s_suppkey % 7 AS INTEGER) AS season, s_nationkey AS team, min(s_name) AS offence, max(s_name) AS defence FROM supplier GROUP BY ALL),
al AS (SELECT season, team, head_coach, games_coached, team_games, changed_midseason, 'games' AS source, NULL AS offence FROM pl WHERE rn = 1 AND (season, team) NOT IN (SELECT (season, team) FROM lv) UNION ALL SELECT season, team, head_coach, NULL, NULL, NULL, 'articles', offence FROM lv)
SELECT season, team, head_coach, games_coached, team_games, changed_midseason, source, coalesce(al.offence, cr.offence) AS offence, cr.defence FROM al LEFT JOIN cr USING (season, team)""")
def staff_by_season(t):
    """Staff of played seasons, the newest from articles where those resolve a team, coordinators from a crawl."""
    games = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.year("o_orderdate").alias("season"), F.col("c_nationkey").alias("team"), F.concat(F.lit("C"), (F.col("c_custkey") % 4).cast("string")).alias("coach"))
    live = t.nation.where("n_nationkey % 3 <> 0").select(F.lit(1998).alias("season"), F.col("n_nationkey").alias("team"), F.concat(F.lit("L"), "n_name").alias("head_coach"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("O"), "n_name")).alias("offence"), F.lit(None).cast("string").alias("defence"), F.lit("articles").alias("source"))
    crawled = t.supplier.groupBy((F.col("s_suppkey") % 7 + 1992).cast("int").alias("season"), F.col("s_nationkey").alias("team")).agg(F.min("s_name").alias("offence"), F.max("s_name").alias("defence"))
    return usage.merge_staff(usage.season_staff(games, "season", "team", "coach", "games"), live, crawled, "season", "team", ["offence", "defence"])
