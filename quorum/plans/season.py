"""Queries of the season blend, the board around it and its presentation.

A part is a player: its name is shared by others, its type the position, its brand the team, its price the second opinion; its
lines are the model's; the month of its first line is an injury's return; its lines by supplier are the depth charts.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import expr as e
from ..operators import blend, board, handcuff, joins, present, season, windows
from .blending import KEYS, OPINIONS, opinions, rules, weights
from .registry import query

r = lambda c, n=4: F.round(c, n).alias(c)
STARTERS = {"ECONOMY": 24, "PROMO": 36, "LARGE": 12, "SMALL": 12, "STANDARD": 24, "MEDIUM": 12}
_STARTERS = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in STARTERS.items()) + ") st(pos, n)"


@query("SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) = 1 THEN p_name ELSE '__ambiguous_' || p_partkey || '__' END AS join_key FROM part")
def shared_names(t):
    return season.primary_name_keys(t.part, "p_name", "p_partkey", "p_retailprice").select("p_partkey", "join_key")


@query("WITH m AS (SELECT p.*, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p.p_partkey AND l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity > 25)) SELECT p_type, count(*) AS missing, string_agg(CAST(p_partkey AS VARCHAR), ', ' ORDER BY rn) FILTER (WHERE rn <= 5) AS highest FROM m GROUP BY p_type")
def match_audit(t):
    src = t.lineitem.where("l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity > 25").select(F.col("l_partkey").alias("p_partkey"))
    return season.misses(t.part, src, "p_partkey", "p_retailprice", "p_partkey", "p_type", 5)


_USAGE = "us AS (SELECT l_partkey, avg(l_quantity) AS u1, avg(l_discount) AS u2, bool_or(l_returnflag = 'R') AS f FROM lineitem GROUP BY 1)"


def _usage(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_quantity").alias("u1"), F.avg("l_discount").alias("u2"), (~F.bool_or(F.col("l_returnflag") == "R")).alias("flag"))


_INJURED = f"""{_USAGE}, inj AS (SELECT p_partkey, p_type, p_brand, p_retailprice, u1, u2, NOT f AS flag, CASE WHEN p_size % 3 <> 0 THEN p_size * 9 END AS days, p_size % 6 = 0 AS away FROM part JOIN us ON p_partkey = l_partkey),
sh AS (SELECT *, CASE WHEN days IS NOT NULL THEN CASE WHEN days > 365 THEN 0 ELSE greatest(0, least(17, 17 - days / 7)) END / 17 WHEN away THEN 0 ELSE 1 END AS share FROM inj),
ij AS (SELECT p_partkey, p_type, p_brand, p_retailprice, share, CASE WHEN share > 0 THEN u1 * share END AS u1, CASE WHEN share > 0 THEN u2 * share END AS u2, share <= 0 OR flag AS flag FROM sh)"""


def _injured(t):
    x = t.part.join(_usage(t), "p_partkey")
    days = F.when(F.col("p_size") % 3 != 0, F.col("p_size") * 9)
    return season.injury_adjusted(x, ["u1", "u2"], "flag", days, F.col("p_size") % 6 == 0)


@query(f"WITH {_INJURED} SELECT p_partkey, round(share, 6) AS share, round(u1, 6) AS u1, round(u2, 7) AS u2, flag FROM ij")
def injury_adjustment(t):
    return _injured(t).select("p_partkey", r("share", 6), r("u1", 6), r("u2", 7), "flag")


_DEPTH = f"ch AS (SELECT l_partkey, p_type, CAST(year(l_shipdate) AS INTEGER) AS dt, l_linenumber AS place FROM lineitem JOIN part ON p_partkey = l_partkey), dp AS (SELECT l_partkey, min(greatest(1, place - st.n // 12 + 1)) AS depth FROM ch JOIN {_STARTERS} ON st.pos = p_type WHERE dt = (SELECT max(dt) FROM ch) GROUP BY 1)"


def _depth(t):
    ch = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_type", F.year("l_shipdate").alias("dt"), F.col("l_linenumber").alias("place"))
    return season.current_depth(ch, "dt", "p_partkey", "p_type", "place", {k: v // 12 for k, v in STARTERS.items()})


@query(f"WITH {_DEPTH} SELECT l_partkey AS p_partkey, CAST(depth AS INTEGER) AS depth_rank FROM dp")
def depth_ranks(t):
    return _depth(t)


_ROLE = f"""{_DEPTH}, po AS (SELECT *, p_retailprice - 1100 AS pts, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rn FROM ij),
lv AS (SELECT p_type, 0.15 * median(pts) AS floor FROM po JOIN {_STARTERS} ON st.pos = p_type WHERE rn <= st.n GROUP BY p_type HAVING count(*) >= max(st.n)),
wd AS (SELECT po.*, dp.depth, (u1 IS NOT NULL OR u2 IS NOT NULL) AND (coalesce(dp.depth >= 2 AND pts < lv.floor, false) OR dp.depth IS NULL AND pts <= 0) AS gone FROM po LEFT JOIN dp ON dp.l_partkey = po.p_partkey LEFT JOIN lv ON lv.p_type = po.p_type),
rw AS (SELECT p_partkey, p_type, p_brand, pts, CASE WHEN NOT gone THEN u1 END AS u1, CASE WHEN NOT gone THEN u2 END AS u2, gone OR flag AS flag, gone FROM wd)"""


def _withdrawn(t):
    x = _injured(t).withColumn("pts", F.col("p_retailprice") - 1100)
    return season.role_withdrawn(x, _depth(t), "p_partkey", "p_type", "pts", ["u1", "u2"], "flag", STARTERS)


@query(f"WITH {_INJURED}, {_ROLE} SELECT p_partkey, round(u1, 6) AS u1, round(u2, 7) AS u2, flag, gone AS withdrawn FROM rw")
def role_withdrawal(t):
    return _withdrawn(t).select("p_partkey", r("u1", 6), r("u2", 7), "flag", "withdrawn")


@query("WITH d AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS season, CAST(ceil(date_part('dayofyear', o_orderdate) / 7) AS INTEGER) AS week, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT season, min(day) AS opener FROM d WHERE week = 1 GROUP BY season")
def week_one(t):
    d = t.orders.select(F.year("o_orderdate").alias("season"), F.ceil(F.dayofyear("o_orderdate") / 7).cast("int").alias("week"), F.col("o_orderdate").cast("date").alias("day"))
    return season.first_game(d, "season", "week", "day")


@query("WITH rp AS (SELECT c_custkey % 400 AS id, c_mktsegment AS status FROM customer WHERE c_acctbal < 3000), one AS (SELECT id, min(status) AS status FROM rp GROUP BY id HAVING count(*) = 1) SELECT s_suppkey, status FROM supplier LEFT JOIN one ON id = s_suppkey")
def injury_report(t):
    rp = t.customer.where("c_acctbal < 3000").select((F.col("c_custkey") % 400).alias("s_suppkey"), F.col("c_mktsegment").alias("status"))
    return season.attach_report(t.supplier, rp, "s_suppkey").select("s_suppkey", "status")


# a season's blend: the opinions, and the model's line after injury and role, are five sources of qty
_SEASON = f"""{OPINIONS}, {_INJURED}, {_ROLE},
q AS (SELECT p_partkey, source, value, is_imputed FROM o WHERE stat = 'qty' UNION ALL SELECT p_partkey, 'USG', u1, flag FROM rw),
w2 AS (SELECT * FROM wt UNION ALL SELECT 'USG', 0.25),
bl AS (SELECT q.p_partkey, CASE WHEN sum(weight * real) > 0 THEN sum(coalesce(value, 0) * weight * real) / sum(weight * real) ELSE sum(coalesce(value, 0) * weight) END AS v FROM (SELECT q.*, CASE WHEN NOT is_imputed AND value IS NOT NULL THEN 1 ELSE 0 END AS real FROM q) q JOIN w2 USING (source) GROUP BY 1),
sp AS (SELECT p_partkey, CASE WHEN count(*) >= 2 THEN min(value) END AS floor, CASE WHEN count(*) >= 2 THEN max(value) END AS ceiling, count(*) AS n FROM q WHERE value <> 0 AND NOT is_imputed GROUP BY 1),
rc AS (SELECT p.p_partkey, p.p_type, p.p_brand, bl.v, p.p_size AS other, sum(bl.v) OVER (PARTITION BY p_brand) AS a, sum(p.p_size) OVER (PARTITION BY p_brand) AS b FROM part p JOIN bl USING (p_partkey)),
fin AS (SELECT p_partkey, p_type, CASE WHEN a > 0 AND b > 0 THEN v * ((a + b) / 2) / a ELSE v END AS points FROM rc),
usg AS (SELECT p_partkey, rank() OVER (PARTITION BY p_type ORDER BY u1 DESC) AS ur FROM rw WHERE u1 IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY p_type ORDER BY round(points, 6) DESC) AS pr FROM fin)"""


@query(f"WITH {_SEASON} SELECT rk.p_partkey, p_type, round(points, 4) AS points, CAST(pr AS INTEGER) AS pos_rank, round(floor, 4) AS floor, round(ceiling, 4) AS ceiling, coalesce(n, 0) AS n_sources, CAST(pr - ur AS INTEGER) AS usg_delta FROM rk LEFT JOIN sp USING (p_partkey) LEFT JOIN usg USING (p_partkey)")
def season_projections(t):
    model = t.once("withdrawn", lambda: _withdrawn(t)).select("p_partkey", F.lit("qty").alias("stat"), F.lit("USG").alias("source"), F.col("u1").alias("value"), F.col("flag").alias("is_imputed"))
    q = t.once("season_opinions", lambda: opinions(t).where("stat = 'qty'").unionByName(model))
    w = weights(t).union(t.constants([("USG", 0.25)], "source string, weight double"))
    x = t.part.select("p_partkey", "p_type", "p_brand", F.col("p_size").cast("double").alias("other")).join(blend.weighted(q, w, KEYS).drop("stat"), "p_partkey")
    x = blend.reconcile(x, "value", "other", "p_brand").withColumn("shown", F.round("value", 6))
    x = x.withColumn("pos_rank", windows.rank("min", "shown", "p_type")).join(blend.spread(q, KEYS), "p_partkey", "left")
    usg = model.join(t.part, "p_partkey").select("p_partkey", windows.rank("min", "value", "p_type").alias("ur"))
    return x.join(usg, "p_partkey", "left").select("p_partkey", "p_type", F.round("value", 4).alias("points"), "pos_rank", r("floor"), r("ceiling"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"), (F.col("pos_rank") - F.col("ur")).alias("usg_delta"))


# ---------------------------------------------------------------- weekly line-ups

_WEEK = """wk AS (SELECT p_partkey, p_type, p_brand, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS espn, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS fp, sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN l_quantity END) AS book, sum(l_quantity) / 3 AS official, sum(l_tax) * 100 AS actual FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
fx AS (SELECT *, CASE WHEN espn > 1.75 * fp AND espn > 40 THEN espn / 2 ELSE espn END AS e FROM wk),
im AS (SELECT *, coalesce(fp, e) AS f, fp IS NULL AS fi, CASE WHEN coalesce(fp, e) IS NULL THEN e WHEN e IS NULL THEN coalesce(fp, e) ELSE (coalesce(fp, e) + e) / 2 END AS mean FROM fx),
bk AS (SELECT *, coalesce(book, mean) AS b, book IS NULL AS bi FROM im),
bd AS (SELECT *, (e IS NOT NULL)::INT * 0.4 + (f IS NOT NULL AND NOT fi)::INT * 0.4 + (b IS NOT NULL AND NOT bi)::INT * 0.2 AS den, coalesce(e, 0) * (e IS NOT NULL)::INT * 0.4 + coalesce(f, 0) * (f IS NOT NULL AND NOT fi)::INT * 0.4 + coalesce(b, 0) * (b IS NOT NULL AND NOT bi)::INT * 0.2 AS num, coalesce(e, 0) * 0.4 + coalesce(f, 0) * 0.4 + coalesce(b, 0) * 0.2 AS face FROM bk),
sc2 AS (SELECT p_partkey, p_type, p_brand, actual, official, 2 * coalesce(e, 0) + (official - 2 * coalesce(e, 0)) AS espn_points, 2 * coalesce(f, 0) + (official - 2 * coalesce(e, 0)) AS fp_points, 2 * CASE WHEN den > 0 THEN num / den ELSE face END + (official - 2 * coalesce(e, 0)) AS true_points FROM bd),
lp AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 'BE' ELSE p_type END AS slot, CASE WHEN p_partkey % 7 = 0 THEN 'Free Agent' ELSE p_brand END AS owner FROM sc2)"""


def _lineups(t):
    """A week's line-ups: three sources joined, doubled values halved, imputed, blended, scored and shifted to the official projection."""
    q = lambda c: F.sum(F.when(F.expr(c), F.col("l_quantity")))
    w = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(q("l_returnflag = 'A'").alias("espn"), q("l_returnflag = 'N'").alias("fp"), q("l_returnflag = 'R' AND l_linestatus = 'F'").alias("book"), (F.sum("l_quantity") / 3).alias("official"), (F.sum("l_tax") * 100).alias("actual"))
    w = t.part.select("p_partkey", "p_type", "p_brand").join(w, "p_partkey").withColumn("espn", blend.halve_doubled("espn", "fp"))
    w = blend.impute(w, "fp", "espn", "fp_is_imputed").withColumn("mean", e.row_sum(["fp", "espn"]) / F.nullif(e.row_count(["fp", "espn"]), F.lit(0)))
    w = blend.impute(w, "book", "mean", "book_is_imputed").withColumn("espn_is_imputed", F.lit(False))
    long = w.select("p_partkey", F.inline(F.array(*(F.struct(F.lit("qty").alias("stat"), F.lit(s).alias("source"), F.col(s).alias("value"), F.col(f"{s}_is_imputed").alias("is_imputed")) for s in ("espn", "fp", "book")))))
    wt = t.constants([("espn", 0.4), ("fp", 0.4), ("book", 0.2)], "source string, weight double")
    true = blend.weighted(long, wt, KEYS).select("p_partkey", F.col("value").alias("true"))
    shift = F.col("official") - 2 * F.coalesce("espn", F.lit(0.0))
    pts = lambda c: (2 * F.coalesce(F.col(c), F.lit(0.0)) + shift).alias(f"{c}_points")
    x = w.join(true, "p_partkey").select("p_partkey", "p_type", "p_brand", "actual", "official", pts("espn"), pts("fp"), pts("true"))
    return x.withColumns({"slot": F.when(F.col("p_partkey") % 5 == 0, "BE").otherwise(F.col("p_type")), "owner": F.when(F.col("p_partkey") % 7 == 0, "Free Agent").otherwise(F.col("p_brand"))})


@query(f"WITH {_WEEK} SELECT p_partkey, round(espn_points, 4) AS espn_points, round(fp_points, 4) AS fp_points, round(true_points, 4) AS true_points, CAST(dense_rank() OVER (PARTITION BY p_type ORDER BY round(true_points, 6) DESC) AS INTEGER) AS true_rank, CAST(dense_rank() OVER (PARTITION BY p_type ORDER BY round(actual, 6) DESC) AS INTEGER) AS rank FROM lp")
def lineup_blend(t):
    x = _lineups(t).withColumns({"_t": F.round("true_points", 6), "_a": F.round("actual", 6)})
    return x.select("p_partkey", r("espn_points"), r("fp_points"), r("true_points"), windows.rank("dense", "_t", "p_type").alias("true_rank"), windows.rank("dense", "_a", "p_type").alias("rank"))


@query(f"WITH {_WEEK}, tm AS (SELECT CAST(p_partkey AS VARCHAR) AS player, slot, true_points, fp_points FROM lp WHERE owner = 'Brand#13'), al AS (SELECT * FROM tm UNION ALL SELECT 'Total', CASE WHEN slot = 'BE' THEN 'Bench' ELSE 'Starting Lineup' END, sum(true_points), sum(fp_points) FROM tm GROUP BY 2) SELECT player, slot, round(true_points, 4) AS true_points, round(fp_points, 4) AS fp_points, CAST(CASE slot WHEN 'ECONOMY' THEN 1 WHEN 'PROMO' THEN 2 WHEN 'LARGE' THEN 3 WHEN 'Starting Lineup' THEN 4 WHEN 'BE' THEN 5 WHEN 'Bench' THEN 6 ELSE 7 END AS BIGINT) AS place FROM al")
def check_week(t):
    x = _lineups(t).where("owner = 'Brand#13'").select(F.col("p_partkey").cast("string").alias("player"), "owner", "slot", "true_points", "fp_points")
    y = season.with_subtotals(x, ["owner"], "slot", ["true_points", "fp_points"], ("BE",), "player")
    return y.select("player", "slot", r("true_points"), r("fp_points"), season.in_order("slot", ["ECONOMY", "PROMO", "LARGE", "Starting Lineup", "BE", "Bench"]).cast("long").alias("place"))


@query(f"WITH {_WEEK} SELECT owner, round(sum(actual), 4) AS actual, round(sum(official), 4) AS official, round(sum(coalesce(true_points, official)), 4) AS true_points, round(sum(coalesce(true_points, official)) - sum(official), 4) AS diff FROM lp WHERE owner <> 'Free Agent' AND slot <> 'BE' GROUP BY owner")
def league_projections(t):
    x = season.team_projections(_lineups(t), [], "slot", "owner", "Free Agent", ("BE", "IR"), "true_points", "official", "actual")
    return x.select("owner", r("actual"), r("official"), r("true_points"), r("diff"))


@query(f"WITH {_WEEK}, k AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY round(true_points, 6) DESC, p_partkey) AS place FROM lp WHERE p_type IN ('ECONOMY', 'PROMO')) SELECT p_partkey, owner, p_type, CAST(place AS INTEGER) AS place FROM k WHERE owner IN ('Brand#13', 'Free Agent')")
def position_rankings(t):
    x = _lineups(t).withColumn("true_points", F.round("true_points", 6))
    return season.rankings(x, "p_type", ["ECONOMY", "PROMO"], "true_points", "p_partkey", "owner", "Brand#13").select("p_partkey", "owner", "p_type", "place")


@query(f"WITH {OPINIONS}, own AS (SELECT * FROM (VALUES ('AF', 'qty', 1.0::DOUBLE), ('NF', 'ext', 0.5)) v(source, stat, weight)), j AS (SELECT o.*, coalesce(own.weight, wt.weight, 0) AS w FROM o LEFT JOIN own ON own.source = o.source AND own.stat = o.stat LEFT JOIN wt ON wt.source = o.source AND wt.source <> 'RO'), sums AS (SELECT p_partkey, stat, sum(CASE WHEN NOT is_imputed AND value IS NOT NULL THEN w ELSE 0 END) AS d, sum(CASE WHEN NOT is_imputed THEN coalesce(value, 0) * w ELSE 0 END) AS n, sum(coalesce(value, 0) * w) AS f FROM j GROUP BY ALL) SELECT p_partkey, stat, round(CASE WHEN d > 0 THEN n / d ELSE f END / 7, 3) AS value FROM sums")
def blend_stat_weights(t):
    own = t.constants([("AF", "qty", 1.0), ("NF", "ext", 0.5)], "source string, stat string, weight double")
    w = weights(t).where("source <> 'RO'").withColumn("stat", F.lit(None).cast("string")).unionByName(own)
    return blend.weighted(opinions(t), w, KEYS).withColumn("value", F.round(F.col("value") / 7, 3))


@query(f"WITH {OPINIONS} SELECT p_partkey, stat, round(sum(coalesce(value, 0) * weight) / 2.7182, 3) AS value FROM o JOIN wt USING (source) GROUP BY ALL")
def blend_face_value(t):
    return blend.weighted(opinions(t), weights(t), KEYS, renormalise=False).withColumn("value", F.round(F.col("value") / 2.7182, 3))


# ---------------------------------------------------------------- scoring registry

_REGISTRY = "rg AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, o_orderpriority AS league, o_custkey % 50 AS source_id, CASE WHEN o_custkey % 50 < 40 THEN 'stat_' || (o_custkey % 50) END AS col_name, CASE WHEN o_orderstatus = 'F' THEN 0.0::DOUBLE ELSE round(o_totalprice / 1000, 1) END AS points FROM orders)"


def _registry(t):
    sid = F.col("o_custkey") % 50
    return t.orders.select(F.year("o_orderdate").alias("season"), F.col("o_orderpriority").alias("league"), sid.alias("source_id"), F.when(sid < 40, F.concat(F.lit("stat_"), sid.cast("string"))).alias("col_name"), F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(F.round(F.col("o_totalprice") / 1000, 1)).alias("points"))


@query(f"WITH {_REGISTRY} SELECT DISTINCT season, league, source_id FROM rg WHERE col_name IS NULL AND points <> 0")
def coverage_gaps(t):
    return blend.coverage_gaps(_registry(t), ["season", "league", "source_id"], "col_name", "points")


@query(f"WITH {_REGISTRY}, u AS (SELECT season, league, count(*) FILTER (WHERE col_name IS NULL AND points <> 0) AS unmapped, count(*) AS rules FROM rg GROUP BY ALL) SELECT season, league, rules, unmapped, unmapped = 0 AS covered FROM u")
def scoring_coverage(t):
    return blend.scoring_coverage(_registry(t), ["season", "league"], "col_name", "points")


_RULES = "rr AS (SELECT CAST(p_size AS INTEGER) AS id, max(p_retailprice) AS points FROM part GROUP BY 1), ov AS (SELECT CAST(s_suppkey % 60 AS INTEGER) AS id, s_nationkey % 3 AS slot, min(CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END) AS points FROM supplier GROUP BY ALL)"


@query(f"WITH {_RULES}, sl AS (SELECT DISTINCT slot FROM ov), x AS (SELECT sl.slot, CASE rr.id WHEN 7 THEN 8 ELSE rr.id END AS id, coalesce(ov.points, rr.points) AS points FROM rr CROSS JOIN sl LEFT JOIN ov ON ov.id = rr.id AND ov.slot = sl.slot WHERE rr.id NOT IN (3, 4)) SELECT slot, id, round(sum(points), 4) AS points, 'size ' || id AS label FROM x GROUP BY slot, id")
def rule_table(t):
    base = t.part.groupBy(F.col("p_size").cast("int").alias("id")).agg(F.max("p_retailprice").alias("points"))
    over = t.supplier.groupBy((F.col("s_suppkey") % 60).cast("int").alias("id"), (F.col("s_nationkey") % 3).alias("slot")).agg(F.min(F.when(F.col("s_acctbal") < 0, 0.0).otherwise(F.col("s_acctbal"))).alias("points"))
    names = t.part.select(F.col("p_size").cast("int").alias("id")).distinct().withColumn("label", F.concat(F.lit("size "), F.col("id").cast("string")))
    return blend.rule_table(base, over, names, "id", "slot", rewrites={7: 8}, ignored=[3, 4]).select("slot", "id", r("points"), "label")


# ---------------------------------------------------------------- board

_SLOTS = "(VALUES ('ECONOMY', 1), ('PROMO', 2), ('LARGE', 1), ('FLEX', 2), ('BE', 5)) sl(slot, n)"


def _slots(t):
    return board.starting_slots(t.constants([("ECONOMY", 1), ("PROMO", 2), ("LARGE", 1), ("FLEX", 2), ("BE", 5)], "slot string, count int"))


FLEX = {"FLEX": ["PROMO", "LARGE", "SMALL"]}
_RANKS = "ded AS (SELECT * FROM (VALUES ('ECONOMY', 10), ('PROMO', 20), ('LARGE', 10)) v(pos, d)), be AS (SELECT p_type, p_retailprice, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) - coalesce(d, 0) AS k FROM part LEFT JOIN ded ON pos = p_type WHERE p_type IN ('PROMO', 'LARGE', 'SMALL')), fw AS (SELECT p_type, count(*) AS c FROM (SELECT * FROM be WHERE k >= 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 20) z GROUP BY 1), rp AS (SELECT pos, CAST(round_even(sum(s), 0) AS BIGINT) AS rank FROM (SELECT pos, d::DOUBLE AS s FROM ded UNION ALL SELECT p_type, c * (20.0::DOUBLE / (SELECT sum(c) FROM fw)) FROM fw) q GROUP BY pos HAVING round_even(sum(s), 0) >= 1)"


def _ranks(t):
    return board.replacement_ranks(t.part, "p_type", "p_retailprice", "p_partkey", _slots(t), FLEX, 10)


@query(f"WITH {_RANKS} SELECT pos AS p_type, rank FROM rp")
def replacement_ranks(t):
    return _ranks(t)


_BOARD = f"""{_RANKS}, vb AS (SELECT p.*, rank() OVER (PARTITION BY p.p_type ORDER BY p_retailprice DESC) AS pos_rank, rp.rank AS need, p_size * 5 + p_partkey % 13 AS adp, 3000 - p_partkey AS espn_rank FROM part p LEFT JOIN rp ON rp.pos = p.p_type),
vr AS (SELECT *, p_retailprice - coalesce(max(CASE WHEN pos_rank >= coalesce(need, 1) THEN p_retailprice END) OVER w, min(p_retailprice) OVER w) AS vor FROM vb WINDOW w AS (PARTITION BY p_type)),
vk AS (SELECT *, rank() OVER (ORDER BY round(vor, 6) DESC) AS vor_rank, rank() OVER (PARTITION BY p_type ORDER BY espn_rank) AS espn_pos FROM vr),
cm AS (SELECT p_partkey, rank() OVER (ORDER BY adp) - rank() OVER (ORDER BY round(vor, 6) DESC) AS value FROM vr WHERE adp < 200 AND p_type <> 'SMALL')"""


def _board(t):
    x = board.value_over_replacement(t.part, "p_type", "p_retailprice", _ranks(t))
    x = x.withColumns({"vor": F.round("vor", 6), "adp": F.col("p_size") * 5 + F.col("p_partkey") % 13, "espn_rank": 3000 - F.col("p_partkey")})
    return board.market_comparison(x, "vor", "adp", "espn_rank", "p_type", "pos_rank", "p_partkey", (F.col("adp") < 200), F.col("p_type") == "SMALL")


@query(f"WITH {_BOARD} SELECT vk.p_partkey, round(vor, 4) AS vor, CAST(vor_rank AS BIGINT) AS vor_rank, CAST(value AS BIGINT) AS value, CAST(espn_rank - vor_rank AS BIGINT) AS rank_delta, CAST(espn_pos - pos_rank AS BIGINT) AS pos_rank_delta, need IS NOT NULL AS startable FROM vk LEFT JOIN cm USING (p_partkey)")
def draft_board(t):
    return _board(t).select("p_partkey", r("vor"), F.col("vor_rank").cast("long").alias("vor_rank"), F.col("value").cast("long").alias("value"), F.col("rank_delta").cast("long").alias("rank_delta"), F.col("pos_rank_delta").cast("long").alias("pos_rank_delta"), F.col("rank").isNotNull().alias("startable"))


# ---------------------------------------------------------------- handcuffs: an order is a game of its customer's nation against another

_GAMES = "gm AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, c_nationkey AS home, (c_nationkey + 1 + o_custkey % 24) % 25 AS away, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice / 50000, 1) - 4 END AS spread FROM orders JOIN customer ON o_custkey = c_custkey), ts AS (SELECT season, team, avg(s) AS strength FROM (SELECT season, home AS team, spread AS s FROM gm WHERE spread IS NOT NULL UNION ALL SELECT season, away, -spread FROM gm WHERE spread IS NOT NULL) GROUP BY ALL)"
_SECOND = "tot AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, c_nationkey AS team, c_custkey, sum(o_totalprice) / 1000 AS carries FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), sec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season, team ORDER BY round(carries, 6) DESC, c_custkey) AS rn FROM tot) WHERE rn = 2), ln AS (SELECT count(*) AS n, regr_intercept(carries, strength) AS intercept, regr_slope(carries, strength) AS slope, regr_r2(carries, strength) AS r2, sqrt(var_pop(carries) * (1 - regr_r2(carries, strength))) AS sd FROM sec JOIN ts USING (season, team))"


def _strength(t):
    g = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.year("o_orderdate").alias("season"), F.col("c_nationkey").alias("home"), ((F.col("c_nationkey") + 1 + F.col("o_custkey") % 24) % 25).cast("int").alias("away"), F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") / 50000, 1) - 4).alias("spread"))
    return handcuff.team_strength(g, ["season"], "home", "away", "spread")


def _totals(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.year("o_orderdate").alias("season"), F.col("c_nationkey").alias("team"), "c_custkey").agg((F.sum("o_totalprice") / 1000).alias("carries"))


def _line(t):
    x = _totals(t).withColumn("_v", F.round("carries", 6))
    return handcuff.fit_line(handcuff.seconds(x, ["season", "team"], "_v", "c_custkey").join(_strength(t), ["season", "team"]), "strength", "carries")


@query(f"WITH {_GAMES} SELECT season, CAST(team AS INTEGER) AS team, round(strength / 7, 6) AS strength FROM ts")
def team_strength(t):
    return _strength(t).select("season", "team", F.round(F.col("strength") / 7, 6).alias("strength"))


@query(f"WITH {_GAMES}, {_SECOND} SELECT n, round(intercept, 4) AS intercept, round(slope, 4) AS slope, round(r2, 8) AS r2, round(sd, 4) AS sd FROM ln")
def second_line_fit(t):
    return _line(t).select("n", r("intercept"), r("slope"), r("r2", 8), r("sd"))


@query(f"WITH {_GAMES}, {_SECOND}, s98 AS (SELECT team, strength FROM ts WHERE season = 1998), bd AS (SELECT tot.*, row_number() OVER (PARTITION BY team ORDER BY round(carries, 6) DESC, c_custkey) AS place FROM tot WHERE season = 1998) SELECT c_custkey, CAST(place AS INTEGER) AS backfield_rank, round(CASE WHEN place = 2 THEN intercept + slope * strength END, 4) AS handcuff_carries, round(CASE WHEN place = 2 THEN slope * (strength - (SELECT avg(strength) FROM s98)) END, 4) AS handcuff_premium FROM bd LEFT JOIN s98 USING (team) CROSS JOIN ln")
def handcuffs(t):
    s = _strength(t).where("season = 1998").select("team", "strength")
    b = _totals(t).where("season = 1998").withColumn("_v", F.round("carries", 6))
    return handcuff.attach_handcuff(b, s, _line(t), "team", "_v", "c_custkey", F.lit(True)).select("c_custkey", "backfield_rank", r("handcuff_carries"), r("handcuff_premium"))


# ---------------------------------------------------------------- presentation


@query("SELECT p_partkey, round(p_retailprice / 20 / 200.0, 8) AS share, round(p_retailprice / 20 / 200.0 * 150, 6) AS dollars FROM part")
def at_budget(t):
    return present.at_budget(t.part.withColumn("price", F.col("p_retailprice") / 20), "price", 150.0).select("p_partkey", r("share", 8), r("dollars", 6))


@query("WITH h AS (SELECT c_nationkey AS team, count(*) AS held FROM customer WHERE c_nationkey <> 0 AND c_acctbal > 0 GROUP BY 1) SELECT team, held FROM h")
def rostered_counts(t):
    return present.rostered_counts(t.customer.where("c_acctbal > 0").withColumnRenamed("c_nationkey", "team"), "team")


@query("WITH h AS (SELECT c_nationkey AS team, count(*) AS held FROM customer WHERE c_nationkey <> 0 GROUP BY 1) SELECT bool_or(held > 40) AS pending, max(held) AS most FROM h")
def keepers_pending(t):
    return present.keepers_pending(t.customer, "c_nationkey", 40)


@query("SELECT CAST(sum(n) * 25 AS BIGINT) AS spots FROM (SELECT c_mktsegment AS slot, count(*) // 100 AS n FROM customer GROUP BY 1) WHERE slot <> 'MACHINERY'")
def draftable_spots(t):
    s = t.customer.groupBy(F.col("c_mktsegment").alias("slot")).agg(F.floor(F.count("*") / 100).alias("count"))
    return present.draftable_spots(s, 25, ("MACHINERY",))


SEATS, WIDE = {"BUILDING": 12, "MACHINERY": 10, "FLEX": 6, "OP": 30}, {"FLEX": ["BUILDING", "MACHINERY", "HOUSEHOLD"], "OP": ["AUTOMOBILE", "BUILDING", "HOUSEHOLD"]}
_NEEDS = """h AS (SELECT c_nationkey AS team, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS b, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS m, count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') AS o, count(*) FILTER (WHERE c_mktsegment = 'AUTOMOBILE') AS a FROM customer GROUP BY 1),
h2 AS (SELECT *, greatest(0, 12 - b) AS ob, greatest(0, 10 - m) AS om, greatest(0, b - 12) AS xb, greatest(0, m - 10) AS xm FROM h),
h3 AS (SELECT *, least(xb, 6) AS fb FROM h2), h4 AS (SELECT *, least(o, 6 - fb) AS fo FROM h3), h5 AS (SELECT *, least(xm, 6 - fb - fo) AS fm FROM h4),
h6 AS (SELECT *, 6 - fb - fo - fm AS of, greatest(0, 30 - least(a, 30) - least(xb - fb, 30 - least(a, 30)) - least(o - fo, 30 - least(a, 30) - least(xb - fb, 30 - least(a, 30)))) AS oo FROM h5),
nd AS (SELECT team, 'BUILDING' AS slot, ob AS open FROM h6 UNION ALL SELECT team, 'MACHINERY', om FROM h6 UNION ALL SELECT team, 'FLEX', of FROM h6 UNION ALL SELECT team, 'OP', oo FROM h6)"""


@query(f"WITH {_NEEDS} SELECT team, slot, CAST(open AS BIGINT) AS open FROM nd WHERE open > 0")
def open_slots(t):
    return present.roster_needs(t.customer.withColumnRenamed("c_nationkey", "team"), "team", "c_mktsegment", SEATS, WIDE)


@query(f"WITH {_NEEDS}, ps AS (SELECT team, unnest(CASE slot WHEN 'FLEX' THEN ['BUILDING', 'MACHINERY', 'HOUSEHOLD'] WHEN 'OP' THEN ['AUTOMOBILE', 'BUILDING', 'HOUSEHOLD'] ELSE [slot] END) AS p FROM nd WHERE open > 0) SELECT team, string_agg(DISTINCT p, ',' ORDER BY p) AS positions FROM ps GROUP BY team")
def positions_needed(t):
    needs = present.roster_needs(t.customer.withColumnRenamed("c_nationkey", "team"), "team", "c_mktsegment", SEATS, WIDE)
    return present.positions_needed(needs, "team", WIDE)


_AGREE = "ag AS (SELECT p_partkey, p_type, p_size, p_retailprice / 40 - p_size AS d FROM part), az AS (SELECT ag.*, CASE WHEN count(*) OVER w >= 8 AND stddev_samp(d) OVER w >= 0.5 THEN round((d - avg(d) OVER w) / stddev_samp(d) OVER w, 7) END AS z FROM ag WINDOW w AS (PARTITION BY p_type))"


def _agreement(t):
    x = t.part.withColumn("d", F.col("p_retailprice") / 40 - F.col("p_size"))
    return board.agreement(x, "d", "p_type").withColumn("z", F.round("z", 7))


@query(f"WITH {_AGREE} SELECT p_partkey, z, row_number() OVER (ORDER BY abs(z) DESC, p_partkey)::INTEGER AS outlier_rank FROM az WHERE z IS NOT NULL ORDER BY abs(z) DESC, p_partkey LIMIT 12")
def agreement_outliers(t):
    return present.outliers(_agreement(t), "z", "p_partkey", 12).where("outlier").select("p_partkey", "z", "outlier_rank")


@query(f"WITH {_AGREE}, f AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY abs(z) DESC, p_partkey) <= 5 AS outlier FROM az) SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS INTEGER) AS label_slot FROM f WHERE outlier")
def label_slots(t):
    x = present.outliers(_agreement(t), "z", "p_partkey", 5, by="p_type")
    return present.label_slots(x, "p_type", "p_size", "p_partkey").where("outlier").select("p_partkey", "label_slot")


@query(f"WITH {_AGREE} SELECT p_type, count(*) AS rows, round(avg(d), 6) AS mean_delta, round(stddev_samp(d), 6) AS sd_delta, round(100 * avg(CASE WHEN d > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_above, bool_or(z IS NOT NULL) AS scored FROM az GROUP BY p_type")
def agreement_summary(t):
    x = present.agreement_summary(_agreement(t), "p_type", "d", "z")
    return x.select("p_type", "rows", r("mean_delta", 6), r("sd_delta", 6), r("share_above", 6), "scored")


@query(f"WITH {_BOARD} SELECT p_partkey, CAST(value AS BIGINT) AS value FROM cm JOIN vk USING (p_partkey) WHERE need IS NOT NULL AND p_size > 3 ORDER BY value DESC, p_partkey LIMIT 12")
def value_targets(t):
    x = _board(t)
    return present.value_targets(x, "value", F.col("rank").isNotNull() & (F.col("p_size") > 3), "p_partkey", 12).select("p_partkey", F.col("value").cast("long").alias("value"))


_ACQ = """ln AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS season, l_suppkey % 50 AS team, l_partkey AS item, l_extendedprice AS points, l_linenumber < 6 AS starts, 'Supplier ' || (l_suppkey % 3) AS owner FROM lineitem),
pk AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS season, l_suppkey % 50 AS team, l_partkey AS item FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey % 50 <> 7),
j AS (SELECT ln.*, pk.item IS NOT NULL AS drafted, (season, team) IN (SELECT (season, team) FROM pk) AS known FROM ln LEFT JOIN pk USING (season, team, item)),
mv AS (SELECT season, team, count(DISTINCT item) AS moves FROM j WHERE NOT drafted GROUP BY ALL), ow AS (SELECT season, team, arg_min(owner, (-n, owner)) AS owner FROM (SELECT season, team, owner, count(*) AS n FROM j WHERE starts GROUP BY ALL) GROUP BY ALL),
ac AS (SELECT season, team, owner, coalesce(moves, 0) AS moves, total, CASE WHEN known THEN d END AS drafted, CASE WHEN known THEN a END AS added, CASE WHEN total > 0 AND known THEN 100 * d / total END AS share_drafted, CASE WHEN moves > 0 AND known THEN a / moves END AS points_per_move FROM (SELECT season, team, bool_or(known) AS known, sum(points) AS total, coalesce(sum(CASE WHEN drafted THEN points END), 0) AS d, coalesce(sum(CASE WHEN NOT drafted THEN points END), 0) AS a FROM j WHERE starts GROUP BY ALL) LEFT JOIN mv USING (season, team) JOIN ow USING (season, team))"""


def _acquisitions(t):
    k = [F.year("l_shipdate").alias("season"), (F.col("l_suppkey") % 50).alias("team"), F.col("l_partkey").alias("item")]
    ln = t.lineitem.select(*k, F.col("l_extendedprice").alias("points"), (F.col("l_linenumber") < 6).alias("starts"), F.concat(F.lit("Supplier "), (F.col("l_suppkey") % 3).cast("string")).alias("owner"))
    pk = t.lineitem.where("l_returnflag = 'A' AND l_suppkey % 50 <> 7").select(*k)
    return present.acquisitions(ln, pk, ["season", "team"], "item", "points", F.col("starts"), "owner")


@query(f"WITH {_ACQ} SELECT season, team, owner, moves, round(total, 2) AS total, round(drafted, 2) AS drafted, round(share_drafted, 6) AS share_drafted, round(points_per_move, 4) AS points_per_move FROM ac")
def drafted_versus_added(t):
    return _acquisitions(t).select("season", "team", "owner", "moves", r("total", 2), r("drafted", 2), r("share_drafted", 6), r("points_per_move", 4))


@query(f"WITH {_ACQ} SELECT team, count(DISTINCT season) AS seasons, arg_max(owner, season) AS owner, round(avg(drafted), 2) AS drafted, round(avg(added), 2) AS added, round(avg(moves), 6) AS moves FROM ac GROUP BY team")
def acquisition_averages(t):
    x = present.acquisition_averages(_acquisitions(t), "team", "season", ["drafted", "added", "moves"])
    return x.select("team", "seasons", "owner", r("drafted", 2), r("added", 2), r("moves", 6))


@query("WITH td AS (SELECT s_suppkey, 'name ' || (s_suppkey % 9) AS favourite, ['likes name ' || (s_suppkey % 9), 'waits for value', 'spends early'][1:1 + s_suppkey % 3] AS traits, s_nationkey AS seasons FROM supplier), bd AS (SELECT DISTINCT 'name ' || (p_size % 6) AS favourite FROM part WHERE p_size < 40), x AS (SELECT td.*, bd.favourite IS NOT NULL AS on_board, CASE WHEN bd.favourite IS NOT NULL THEN traits ELSE list_filter(traits, lambda z: NOT contains(z, td.favourite)) END AS kept FROM td LEFT JOIN bd USING (favourite)) SELECT s_suppkey, on_board, CASE WHEN len(kept) > 0 THEN array_to_string(list_transform(kept, lambda z: upper(z[1]) || z[2:] || '.'), ' ') ELSE 'No tendency about this board.' END || ' (' || seasons || ' drafts)' AS description FROM x")
def board_notes(t):
    name = F.concat(F.lit("name "), (F.col("s_suppkey") % 9).cast("string"))
    td = t.supplier.select("s_suppkey", name.alias("favourite"), F.slice(F.array(F.concat(F.lit("likes "), name), F.lit("waits for value"), F.lit("spends early")), F.lit(1), (1 + F.col("s_suppkey") % 3).cast("int")).alias("traits"), F.col("s_nationkey").alias("seasons"))
    bd = t.part.where("p_size < 40").select(F.concat(F.lit("name "), (F.col("p_size") % 6).cast("string")).alias("name"))
    return present.notes(td, bd, "name").select("s_suppkey", "on_board", "description")


@query(f"WITH {_INJURED}, {_ROLE}, a AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 11 = 1 THEN 'abstain' ELSE 'veteran' END AS arm, u1, CASE WHEN gone THEN 'withdrawn: backup' WHEN p_partkey % 4 = 0 THEN 'changed teams' ELSE '' END AS said FROM rw) SELECT p_partkey, CASE WHEN arm IS NULL THEN 'not modelled' WHEN arm = 'abstain' THEN 'withdrawn: availability' WHEN u1 IS NULL AND said = 'withdrawn: backup' THEN said WHEN u1 IS NULL THEN 'withdrawn: injury' WHEN said <> '' THEN said ELSE 'clear' END AS evidence FROM a")
def model_evidence(t):
    k = F.col("p_partkey")
    x = _withdrawn(t).withColumns({"arm": F.when(k % 11 == 0, None).when(k % 11 == 1, "abstain").otherwise("veteran"), "said": F.when(F.col("withdrawn"), "withdrawn: backup").when(k % 4 == 0, "changed teams").otherwise("")})
    return x.select("p_partkey", present.evidence("arm", "u1", "said").alias("evidence"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'U' WHEN '2-HIGH' THEN 'H' ELSE o_orderpriority END AS code, CASE WHEN CAST(o_orderdate AS DATE) > DATE '2000-12-31' THEN 'season' ELSE strftime(o_orderdate, '%b %d') END AS back FROM orders")
def injury_codes(t):
    x = t.orders.withColumn("day", F.col("o_orderdate").cast("date"))
    return x.select("o_orderkey", present.injury_code("o_orderpriority", {"1-URGENT": "U", "2-HIGH": "H"}).alias("code"), present.return_label("day", "2000-12-31").alias("back"))
