"""Queries of the remaining expressions, filters, joins, windows, landed sources and league reports."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import expr as e
from ..operators import evaluate, history, joins, model, shape, tendencies, windows, wording
from ..sources import landed
from .modelling import _GAMES, _PICKS, _facts, _picks
from .registry import query

r = lambda c, n=4: F.round(c, n).alias(c)


@query("SELECT l_orderkey, l_linenumber, l_discount AS x_discount, l_tax AS x_tax FROM lineitem")
def regex_columns(t):
    x = shape.matching(t.lineitem, r"^l_(discount|tax)$", ["l_orderkey", "l_linenumber"])
    return shape.prefixed(x.withColumnsRenamed({"l_discount": "discount", "l_tax": "tax"}), "x_", ["l_orderkey", "l_linenumber"])


@query("SELECT event_id, CASE WHEN value > 5 THEN user_id / value END AS ratio, greatest(value, user_id::DOUBLE) AS hi, least(value, user_id::DOUBLE) AS lo, value > 50 OR event_type = 'error' AS any_flag, TRY_CAST(event_type AS DOUBLE) AS parsed, TRY_CAST(props[7:7] AS INTEGER) AS digit, contains(event_type, 'er') OR contains(event_type, 'ck') AS has, replace(replace(event_type, 'e', '3'), 'c', 'k') AS leet, concat_ws('; ', CASE WHEN value > 50 THEN 'high' END, CASE WHEN user_id % 2 = 0 THEN 'even' END) AS notes FROM events")
def scalar_helpers(t):
    v, u = F.col("value"), F.col("user_id")
    return t.events.select("event_id", F.when(v > 5, e.safe_ratio(u, v)).alias("ratio"), e.row_max([v, u.cast("double")]).alias("hi"), e.row_min([v, u.cast("double")]).alias("lo"), e.row_any([v > 50, F.col("event_type") == "error"]).alias("any_flag"), e.lenient("event_type", "double").alias("parsed"), e.lenient(F.substring("props", 7, 1), "int").alias("digit"), e.contains_any("event_type", ["er", "ck"]).alias("has"), e.multi_replace("event_type", {"e": "3", "c": "k"}).alias("leet"), F.concat_ws("; ", F.when(v > 50, "high"), F.when(u % 2 == 0, "even")).alias("notes"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE WHEN w = lower(w) THEN upper(w[1]) || w[2:] ELSE w END), ' ') AS title, lpad(CAST(p_size AS VARCHAR), 5, '0') AS padded, CASE WHEN p_size > 10 THEN p_retailprice / p_size END AS per FROM part")
def text_helpers(t):
    nan = F.when(F.col("p_size") > 10, F.col("p_retailprice") / F.col("p_size")).otherwise(F.lit(float("nan")))
    return t.part.select("p_partkey", e.capitalised("p_name").alias("title"), F.lpad(F.col("p_size").cast("string"), 5, "0").alias("padded"), e.nan_to_null(nan).alias("per"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 17.0::DOUBLE WHEN c_acctbal > 3000 THEN 0 ELSE greatest(0, least(17, 17 - (c_acctbal / 10) / 7)) END AS games FROM customer")
def games_available(t):
    x = t.customer.withColumn("days", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") / 10))
    return x.select("c_custkey", e.games_available("days", 17, 300).alias("games"))


@query("SELECT o_orderkey FROM orders WHERE NOT (year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) AND month(o_orderdate) = (SELECT max(month(o_orderdate)) FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)))")
def without_latest_week(t):
    x = t.orders.select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("w"))
    return joins.without_latest(x, ["y", "w"]).select("o_orderkey")


@query("SELECT l_partkey, greatest(max(l_discount) - min(l_discount), max(l_tax) - min(l_tax)) AS worst FROM lineitem GROUP BY l_partkey")
def worst_spread(t):
    return evaluate.worst_spread(t.lineitem, ["l_partkey"], ["l_discount", "l_tax"])


@query("SELECT l_returnflag, round(sum(l_orderkey), 2) AS l_orderkey, round(sum(l_partkey), 2) AS l_partkey, round(sum(l_suppkey), 2) AS l_suppkey, round(sum(l_linenumber), 2) AS l_linenumber, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 1) AS l_extendedprice, round(sum(l_discount), 2) AS l_discount, round(sum(l_tax), 2) AS l_tax FROM (SELECT l_returnflag, l_orderkey::DOUBLE AS l_orderkey, l_partkey::DOUBLE AS l_partkey, l_suppkey::DOUBLE AS l_suppkey, l_linenumber::DOUBLE AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) GROUP BY l_returnflag")
def sum_all_numeric(t):
    x = shape.sum_numeric(t.lineitem, ["l_returnflag"])
    return x.select("l_returnflag", *(F.round(F.col(c).cast("double"), 1 if c == "l_extendedprice" else 2).alias(c) for c in x.columns if c != "l_returnflag"))


@query("SELECT event_id, CAST(ntile(4) OVER w AS INTEGER) AS quarter, first_value(event_type) OVER w AS first_type, round(percent_rank() OVER w, 9) AS pr, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS day_events FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_extras(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    day = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)
    return t.events.select("event_id", F.ntile(4).over(w).alias("quarter"), F.first("event_type").over(w).alias("first_type"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.count("*").over(day).alias("day_events"))


@query("SELECT o_custkey, string_agg(s, '>' ORDER BY k) AS statuses FROM (SELECT DISTINCT o_custkey, o_orderpriority AS s, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END AS k FROM orders WHERE o_orderpriority IN ('5-LOW', '1-URGENT', '3-MEDIUM')) GROUP BY o_custkey")
def custom_order(t):
    order = ["5-LOW", "1-URGENT", "3-MEDIUM"]
    k = F.array_position(F.array(*map(F.lit, order)), F.col("o_orderpriority"))
    x = t.orders.where(F.col("o_orderpriority").isin(*order)).select("o_custkey", k.alias("k"), F.col("o_orderpriority").alias("s")).distinct()
    return x.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda v: v["s"]), ">").alias("statuses"))


@query("SELECT s.s_suppkey, s.s_acctbal, n.n_name, c.n AS s_acctbal_customers FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c.c_nationkey = s.s_nationkey")
def suffix_join(t):
    c = t.customer.groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count("*").alias("s_acctbal"))
    n = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return joins.left_suffixed(t.supplier.join(n, "s_nationkey", "left"), c, ["s_nationkey"], "_customers").select("s_suppkey", "s_acctbal", "n_name", "s_acctbal_customers")


@query("WITH te AS (SELECT DISTINCT o_custkey, year(o_orderdate)::INTEGER AS season, c_nationkey AS team FROM orders JOIN customer ON c_custkey = o_custkey), sc AS (SELECT DISTINCT year(o_orderdate)::INTEGER AS season, month(o_orderdate)::INTEGER AS week, c_nationkey AS team FROM orders JOIN customer ON c_custkey = o_custkey) SELECT te.o_custkey, te.season, sc.week FROM te JOIN sc ON sc.season = te.season AND sc.team = te.team")
def calendar_expansion(t):
    g = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select("o_custkey", F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), F.col("c_nationkey").alias("team"))
    return joins.calendar_expansion(g.select("o_custkey", "season", "team").distinct(), g.select("season", "week", "team").distinct(), ["season", "team"]).select("o_custkey", "season", "week")


@query("SELECT p_partkey, round(quantile_cont(CASE WHEN p_size > 20 THEN p_retailprice END, 0.25) OVER (PARTITION BY p_type), 6) AS cut FROM part")
def conditional_quantile(t):
    return t.part.select("p_partkey", F.round(F.percentile(F.when(F.col("p_size") > 20, F.col("p_retailprice")), 0.25).over(Window.partitionBy("p_type")), 6).alias("cut"))


@query("WITH a AS (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE year(o_orderdate) < 1999 GROUP BY 1), b AS (SELECT o_custkey, max(o_totalprice) AS v FROM orders GROUP BY 1) SELECT count(*) FILTER (WHERE a.v IS DISTINCT FROM b.v) AS moved, count(*) AS keys, count(*) FILTER (WHERE a.v IS DISTINCT FROM b.v) > 0 AS fresh FROM a FULL JOIN b USING (o_custkey)")
def data_moved(t):
    f = lambda x: x.groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    return joins.data_moved(f(t.orders.where("year(o_orderdate) < 1999")), f(t.orders), ["o_custkey"], ["v"])


# ---------------------------------------------------------------- landed sources, written as they land and read back


@query("SELECT o_orderkey AS home, o_custkey AS away, CAST(month(o_orderdate) AS BIGINT) AS period, l_suppkey AS team, l_partkey AS player, l_returnflag AS slot, l_quantity AS points, l_tax AS projected FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def box_score_rows(t):
    line = F.struct(F.col("l_suppkey").alias("team"), F.col("l_partkey").alias("player"), F.col("l_returnflag").alias("slot"), F.col("l_quantity").alias("points"), F.col("l_tax").alias("projected"), F.array("l_linestatus").alias("eligible"))
    g = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderkey").alias("home"), F.col("o_custkey").alias("away"), F.month("o_orderdate").cast("long").alias("period")).agg(F.collect_list(line).alias("lineups"))
    return landed.box_scores(g.select(F.to_json(F.struct("*")).alias("j")), "j").drop("eligible")


@query("SELECT n_nationkey AS page, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS row, c_name AS name, c_mktsegment AS segment FROM customer JOIN nation ON n_nationkey = c_nationkey")
def html_tables(t):
    row = F.concat(F.lit("<tr class='x'><td>"), F.col("c_name"), F.lit("</td><td><b>"), F.col("c_mktsegment"), F.lit("</b></td></tr>"))
    g = t.customer.groupBy(F.col("c_nationkey").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("r")))), lambda v: v["r"]), "").alias("rows"))
    x = landed.html_rows(g.withColumn("html", F.concat(F.lit("<html><table>"), "rows", F.lit("</table></html>"))), "html", ["page"])
    return x.select("page", "row", F.element_at("cells", 1).alias("name"), F.element_at("cells", 2).alias("segment"))


@query("SELECT o_orderkey AS event, 'main' AS market, l_returnflag || l_linenumber AS side, l_quantity AS line, l_tax AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def odds_rows(t):
    out = F.struct(F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("side"), F.col("l_quantity").alias("line"), F.col("l_tax").alias("price"))
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("event")).agg(F.collect_list(out).alias("outcomes"))
    return landed.odds(g.select(F.to_json(F.struct("event", F.array(F.struct(F.lit("main").alias("name"), "outcomes")).alias("markets"))).alias("j")), "j")


# ---------------------------------------------------------------- odds


@query("WITH b AS (SELECT l_suppkey, CAST(l_quantity AS INTEGER) // 10 AS line, max(l_discount) - min(l_discount) AS spread, count(*) AS bets FROM lineitem GROUP BY ALL HAVING count(*) > 3) SELECT l_suppkey, line FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(spread, 6), bets DESC, line) AS rn FROM b) WHERE rn = 1")
def primary_line_many(t):
    b = t.lineitem.groupBy("l_suppkey", F.floor(F.col("l_quantity") / 10).cast("int").alias("line")).agg(F.round(F.max("l_discount") - F.min("l_discount"), 6).alias("spread"), F.count("*").alias("bets")).where("bets > 3")
    return windows.top_per(b, "l_suppkey", 1, F.col("spread"), F.col("bets").desc(), F.col("line")).select("l_suppkey", "line")


@query("SELECT p_partkey, c, round(p_size + (p_retailprice / 2111 - 0.45) * p_size * c, 6) AS adjusted FROM part CROSS JOIN (VALUES (0.25::DOUBLE), (0.5)) v(c)")
def juice_adjusted(t):
    x = t.part.withColumns({"under": F.col("p_retailprice") / 2111, "over": F.lit(0.45), "c": F.explode(F.array(F.lit(0.25), F.lit(0.5)))})
    return x.select("p_partkey", "c", F.round(e.juice_adjusted("p_size", "under", "over", F.col("c")), 6).alias("adjusted"))


# ---------------------------------------------------------------- league reports

_MEASURES = "me AS (SELECT period, CAST(team AS VARCHAR) AS team, score, against, score - against AS margin FROM facts), ml AS (SELECT period, team, 'score' AS metric, score AS value FROM me UNION ALL SELECT period, team, 'against', against FROM me UNION ALL SELECT period, team, 'margin', margin FROM me)"


@query(f"WITH {_GAMES}, {_MEASURES}, x AS (SELECT *, max(value) OVER w AS hi, min(value) OVER w AS lo FROM ml WINDOW w AS (PARTITION BY period, metric)) SELECT period, metric, max(hi) AS best, string_agg(DISTINCT CASE WHEN value = hi THEN team END, ', ' ORDER BY CASE WHEN value = hi THEN team END) AS best_names, min(lo) AS worst, string_agg(DISTINCT CASE WHEN value = lo THEN team END, ', ' ORDER BY CASE WHEN value = lo THEN team END) AS worst_names FROM x GROUP BY period, metric")
def weekly_report(t):
    m = _facts(t).withColumns({"margin": F.col("score") - F.col("against"), "team": F.col("team").cast("string")})
    return history.extremes(m, ["period"], "team", ["score", "against", "margin"])


@query(f"WITH {_GAMES}, {_MEASURES}, sm AS (SELECT period // 12 AS season, team, metric, avg(value) AS value FROM ml GROUP BY ALL), x AS (SELECT *, max(value) OVER w AS hi, min(value) OVER w AS lo FROM sm WINDOW w AS (PARTITION BY season, metric)) SELECT season, metric, round(max(hi), 6) AS best, string_agg(DISTINCT CASE WHEN value = hi THEN team END, ', ' ORDER BY CASE WHEN value = hi THEN team END) AS best_names, round(min(lo), 6) AS worst, string_agg(DISTINCT CASE WHEN value = lo THEN team END, ', ' ORDER BY CASE WHEN value = lo THEN team END) AS worst_names FROM x GROUP BY season, metric")
def season_report(t):
    m = _facts(t).withColumns({"margin": F.col("score") - F.col("against"), "team": F.col("team").cast("string"), "season": F.floor(F.col("period") / 12)})
    g = m.groupBy("season", "team").agg(*(F.avg(c).alias(c) for c in ("score", "against", "margin")))
    return history.extremes(g, ["season"], "team", ["score", "against", "margin"]).withColumns({"best": F.round("best", 6), "worst": F.round("worst", 6)})


@query(f"WITH {_GAMES}, {_MEASURES}, k AS (SELECT metric, team, period, value, rank() OVER (PARTITION BY metric ORDER BY value DESC) AS place FROM ml) SELECT metric, team, period, value, CAST(place AS INTEGER) AS place FROM k WHERE place <= 10")
def all_time_report(t):
    m = _facts(t).withColumns({"margin": F.col("score") - F.col("against"), "team": F.col("team").cast("string")})
    x = m.unpivot(["period", "team"], ["score", "against", "margin"], "metric", "value")
    return history.records(x, ["metric"], "value", 10).select("metric", "team", "period", "value", "place")


@query(f"WITH {_GAMES}, g AS (SELECT n_regionkey AS division, team, count(*) FILTER (WHERE outcome = 1) AS wins, sum(score) AS points FROM facts JOIN nation ON n_nationkey = team GROUP BY ALL) SELECT division, team, wins, points, CAST(row_number() OVER (PARTITION BY division ORDER BY wins DESC, points DESC, team) AS INTEGER) AS place FROM g")
def division_standings(t):
    f = _facts(t).join(t.nation.select(F.col("n_nationkey").alias("team"), F.col("n_regionkey").alias("division")), "team")
    return history.division_standings(f, "division")


@query(f"WITH {_GAMES} SELECT period, team, opponent, CAST(rank() OVER (PARTITION BY period ORDER BY score DESC) AS INTEGER) AS finish FROM facts")
def weekly_finish(t):
    return _facts(t).withColumn("finish", history.weekly_finish("period", "score")).select("period", "team", "opponent", "finish")


@query("WITH g AS (SELECT o_orderkey AS game, CAST(month(o_orderdate) AS INTEGER) AS week, o_custkey % 14 + 1 AS home_standing, CASE WHEN o_custkey % 17 <> 0 THEN o_custkey % 12 END AS away, o_custkey % 3 AS away_losses, round(o_totalprice / 4000, 0) AS away_last, round(o_totalprice / 5000, 0) + 20 AS away_last_against, o_orderkey % 50 AS away_points_for, o_orderkey % 47 AS last_points_for FROM orders) SELECT game, coalesce(week > 9 AND away IS NOT NULL AND home_standing <= 8 AND (week = 10 OR away_losses = 0 AND (away_last > away_last_against OR away_last = away_last_against AND away_points_for > last_points_for)), false) AS is_playoff FROM g")
def playoff_games(t):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    g = t.orders.select(k.alias("game"), F.month("o_orderdate").alias("week"), (c % 14 + 1).alias("home_standing"), F.when(c % 17 != 0, c % 12).alias("away"), (c % 3).alias("away_losses"), F.round(F.col("o_totalprice") / 4000, 0).alias("away_last"), (F.round(F.col("o_totalprice") / 5000, 0) + 20).alias("away_last_against"), (k % 50).alias("away_points_for"), (k % 47).alias("last_points_for"))
    return history.is_playoff(g, [], "week", 9, 8).select("game", "is_playoff")


@query("WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'BE' ELSE l_linestatus END AS slot, l_quantity AS p, l_quantity * 0.5 + l_tax * 100 AS q, CASE WHEN l_tax > 0.06 THEN 'bye' WHEN l_tax < 0.01 THEN 'inactive' ELSE 'active' END AS st, l_linenumber % 3 AS td FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, slot <> 'BE' ORDER BY p DESC) AS rn FROM x) SELECT l_orderkey, sum(CASE WHEN slot <> 'BE' THEN p ELSE 0 END) AS actual, round(sum(CASE WHEN slot <> 'BE' THEN q ELSE 0 END), 6) AS projected, sum(CASE WHEN slot = 'BE' THEN p ELSE 0 END) AS bench, CAST(sum(CASE WHEN slot <> 'BE' THEN td ELSE 0 END) AS DOUBLE) AS touchdowns, count(*) FILTER (WHERE slot <> 'BE' AND st = 'bye') AS byes, count(*) FILTER (WHERE slot <> 'BE' AND st = 'inactive') AS inactive, sum(CASE WHEN slot <> 'BE' AND rn <= 3 THEN p ELSE 0 END) AS trio FROM k GROUP BY l_orderkey")
def lineup_measures(t):
    x = t.lineitem.select("l_orderkey", F.when(F.col("l_returnflag") == "R", "BE").otherwise(F.col("l_linestatus")).alias("slot"), F.col("l_quantity").alias("p"), (F.col("l_quantity") * 0.5 + F.col("l_tax") * 100).alias("q"), F.when(F.col("l_tax") > 0.06, "bye").when(F.col("l_tax") < 0.01, "inactive").otherwise("active").alias("st"), (F.col("l_linenumber") % 3).alias("td"))
    m = history.lineup_measures(x, ["l_orderkey"], "slot", "p", "q", "st", "td")
    return m.select("l_orderkey", "actual", r("projected", 6), "bench", "touchdowns", "byes", "inactive", "trio")


@query("SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.25), 6) AS q1, round(median(c_acctbal), 6) AS q2, round(quantile_cont(c_acctbal, 0.75), 6) AS q3, round(corr(c_acctbal, c_nationkey) ** 2, 10) AS r2 FROM customer GROUP BY c_mktsegment")
def box_quartiles(t):
    q = lambda p: F.round(F.percentile("c_acctbal", p), 6)
    return t.customer.groupBy("c_mktsegment").agg(q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.round(F.corr("c_acctbal", "c_nationkey") ** 2, 10).alias("r2"))


@query(f"WITH {_GAMES} SELECT team, round(avg(score), 6) AS score, round(avg(against), 6) AS against, count(*) FILTER (WHERE outcome = 1) AS wins, count(*) FILTER (WHERE outcome = 0) AS ties, count(*) FILTER (WHERE outcome = -1) AS losses, round(stddev_samp(score), 6) AS sd, max(score) AS best, min(score) AS worst, round(median(score), 6) AS median, round(avg(score - against), 6) AS margin, round(avg(abs(score - against)), 6) AS closeness, count(*) FILTER (WHERE abs(score - against) < 50) AS close_games, count(*) FILTER (WHERE score > 600) AS big_games, sum(score) AS total, count(DISTINCT opponent) AS opponents FROM facts GROUP BY team")
def team_measures(t):
    s, a, o = F.col("score"), F.col("against"), F.col("outcome")
    m = lambda x: F.round(F.avg(x), 6)
    return _facts(t).groupBy("team").agg(m(s).alias("score"), m(a).alias("against"), F.count_if(o == 1).alias("wins"), F.count_if(o == 0).alias("ties"), F.count_if(o == -1).alias("losses"), F.round(F.stddev_samp(s), 6).alias("sd"), F.max(s).alias("best"), F.min(s).alias("worst"), F.round(F.median(s), 6).alias("median"), m(s - a).alias("margin"), m(F.abs(s - a)).alias("closeness"), F.count_if(F.abs(s - a) < 50).alias("close_games"), F.count_if(s > 600).alias("big_games"), F.sum(s).alias("total"), F.count_distinct("opponent").alias("opponents"))


def _pair(a, b):
    """Least squares of two regressors by Cramer's rule on their covariances."""
    return f"SELECT l_returnflag, '{a}+{b}' AS sources, n, unnest(['intercept', '{a}', '{b}']) AS term, unnest([my - p * m{a} - q * m{b}, p, q]) AS value, (p * c{a}y + q * c{b}y) / cyy AS r2 FROM (SELECT *, (c{a}y * c{b}{b} - c{b}y * c{a}{b}) / (c{a}{a} * c{b}{b} - c{a}{b} * c{a}{b}) AS p, (c{b}y * c{a}{a} - c{a}y * c{a}{b}) / (c{a}{a} * c{b}{b} - c{a}{b} * c{a}{b}) AS q FROM (SELECT l_returnflag, count(*) AS n, avg(y) AS my, avg({a}) AS m{a}, avg({b}) AS m{b}, var_pop({a}) AS c{a}{a}, var_pop({b}) AS c{b}{b}, covar_pop({a}, {b}) AS c{a}{b}, covar_pop({a}, y) AS c{a}y, covar_pop({b}, y) AS c{b}y, var_pop(y) AS cyy FROM d GROUP BY 1))"


def _single(a):
    return f"SELECT l_returnflag, '{a}' AS sources, count(*) AS n, unnest(['intercept', '{a}']) AS term, unnest([regr_intercept(y, {a}), regr_slope(y, {a})]) AS value, regr_r2(y, {a}) AS r2 FROM d GROUP BY 1"


_SOURCES = ("q", "d", "s")
_D = "WITH d AS (SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS d, CAST(l_suppkey % 17 AS DOUBLE) AS s FROM lineitem)"


@query(f"{_D} SELECT l_returnflag, sources, n, term, round(value, 4) AS value, round(r2, 9) AS r2 FROM ({' UNION ALL '.join([*(_single(a) for a in _SOURCES), *(_pair(a, b) for a, b in (('q', 'd'), ('q', 's'), ('d', 's')))])})")
def weight_finder(t):
    """Every single source and pair; all three are in the operator's tests."""
    x = t.lineitem.select("l_returnflag", F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), (F.col("l_suppkey") % 17).alias("s"))
    return model.weight_finder(x, "l_returnflag", list(_SOURCES), "y", most=2).withColumns({"value": F.round("value", 4), "r2": F.round("r2", 9)})


_TYPED = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(left(p_name, k), substring(p_name, k + 2)) WHEN 2 THEN concat(left(p_name, k), 'x', substring(p_name, k + 1)) ELSE concat(substring(p_name, 2), 'e') END"


@query(f"WITH d AS (SELECT p_partkey, {_TYPED} AS typed FROM (SELECT *, CAST(p_partkey % length(p_name) AS INTEGER) AS k FROM part)), n AS (SELECT DISTINCT p_name FROM part), m AS (SELECT typed, p_name, levenshtein(typed, p_name) AS e FROM (SELECT DISTINCT typed FROM d) CROSS JOIN n), w AS (SELECT typed, min(e) AS e FROM m WHERE e <= CASE WHEN length(typed) <= 3 THEN 0 WHEN length(typed) <= 6 THEN 1 ELSE 2 END GROUP BY 1), b AS (SELECT w.typed, w.e, count(*) AS c, min(p_name) AS name FROM w JOIN m ON m.typed = w.typed AND m.e = w.e GROUP BY ALL) SELECT d.p_partkey, d.typed, CASE WHEN c = 1 THEN name END AS name, CAST(CASE WHEN c = 1 THEN e END AS INTEGER) AS edits FROM d LEFT JOIN b ON b.typed = d.typed")
def name_recovery(t):
    """Part names with a letter lost, added or moved, against the dictionary of all part names."""
    d = t.part.withColumn("k", (F.col("p_partkey") % F.length("p_name")).cast("int")).select("p_partkey", F.expr(_TYPED).alias("typed"))
    return d.join(wording.nearest_names(d, "typed", t.part, "p_name").withColumnRenamed("p_name", "name"), "typed", "left").select("p_partkey", "typed", "name", "edits")


# ---------------------------------------------------------------- more tendencies


@query(f"WITH {_PICKS}, e AS (SELECT * FROM pk WHERE round <= 3), n AS (SELECT season, owner, kind, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT a.season, a.owner, k.kind FROM (SELECT DISTINCT season, owner FROM e) a CROSS JOIN (SELECT DISTINCT kind FROM e) k), x AS (SELECT g.*, coalesce(n.n, 0) AS n FROM g LEFT JOIN n ON n.season = g.season AND n.owner = g.owner AND n.kind = g.kind), s AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY season, owner) AS share FROM x), d AS (SELECT *, share - (sum(share) OVER w - share) / nullif(count(*) OVER w - 1, 0) AS delta FROM s WINDOW w AS (PARTITION BY season, kind)) SELECT owner, kind, round(avg(share), 7) AS share, round(avg(delta), 7) AS delta FROM d GROUP BY owner, kind")
def early_build(t):
    return tendencies.early_build(_picks(t), "owner", "kind", "season", "round", 3).select("owner", "kind", r("share", 7), r("delta", 7))


@query(f"WITH {_PICKS}, n AS (SELECT season, owner, kind, sum(price) AS n FROM pk GROUP BY ALL), g AS (SELECT a.season, a.owner, k.kind FROM (SELECT DISTINCT season, owner FROM pk) a CROSS JOIN (SELECT DISTINCT kind FROM pk) k), x AS (SELECT g.*, coalesce(n.n, 0) AS n FROM g LEFT JOIN n ON n.season = g.season AND n.owner = g.owner AND n.kind = g.kind), s AS (SELECT *, n / sum(n) OVER (PARTITION BY season, owner) AS share FROM x), d AS (SELECT *, share - (sum(share) OVER w - share) / nullif(count(*) OVER w - 1, 0) AS delta FROM s WINDOW w AS (PARTITION BY season, kind)), f AS (SELECT owner, kind, avg(share) AS share, avg(delta) AS delta FROM d GROUP BY owner, kind), k AS (SELECT *, row_number() OVER (PARTITION BY season, owner ORDER BY price DESC) AS rn FROM pk), c AS (SELECT season, owner, sum(CASE WHEN rn <= 3 THEN price END) / sum(price) AS ts FROM k GROUP BY ALL), o AS (SELECT *, CASE WHEN count(ts) OVER w > 1 THEN (sum(ts) OVER w - ts) / (count(ts) OVER w - 1) END AS room FROM c WINDOW w AS (PARTITION BY season)) SELECT f.owner, f.kind, round(share, 7) AS share, round(delta, 7) AS delta, round(ts, 7) AS top_share, round(room, 7) AS room_top_share FROM f JOIN (SELECT owner, avg(ts) AS ts, avg(room) AS room FROM o GROUP BY owner) q ON q.owner = f.owner")
def auction_spend(t):
    x = tendencies.auction_spend(_picks(t), "owner", "kind", "season", "price")
    return x.select("owner", "kind", r("share", 7), r("delta", 7), r("top_share", 7), r("room_top_share", 7))


@query(f"WITH {_PICKS}, h AS (SELECT season, owner, CASE WHEN kind <> '5-LOW' THEN kind = '1-URGENT' END AS rookie, price > 200000 AS auto, o_orderkey % 5 = 0 AS keeper FROM pk), q AS (SELECT season, owner, avg(CASE WHEN rookie THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM h WHERE rookie IS NOT NULL GROUP BY ALL), x AS (SELECT *, CASE WHEN count(*) OVER w > 1 THEN (sum(rate) OVER w - rate) / (count(*) OVER w - 1) END AS room FROM q WINDOW w AS (PARTITION BY season)), a AS (SELECT owner, avg(rate) AS rr, avg(room) AS ro FROM x WHERE room IS NOT NULL GROUP BY owner), b AS (SELECT owner, avg(CASE WHEN auto THEN 1.0::DOUBLE ELSE 0 END) AS ar, avg(CASE WHEN keeper THEN 1.0::DOUBLE ELSE 0 END) AS kr, count(*) FILTER (WHERE auto) AS an FROM h GROUP BY owner) SELECT coalesce(a.owner, b.owner) AS owner, round(rr, 7) AS rookie_rate, round(rr - ro, 7) AS rookie_delta, round(ar, 7) AS auto_rate, an AS auto_n, round(kr, 7) AS keeper_rate FROM a FULL JOIN b ON a.owner = b.owner")
def all_habits(t):
    x = _picks(t).withColumns({"rookie": F.when(F.col("kind") != "5-LOW", F.col("kind") == "1-URGENT"), "auto": F.col("price") > 200000, "keeper": F.col("o_orderkey") % 5 == 0})
    h = tendencies.all_habits(x, "owner", "season", "rookie", ["auto", "keeper"])
    return h.select("owner", r("rookie_rate", 7), r("rookie_delta", 7), r("auto_rate", 7), "auto_n", r("keeper_rate", 7))


@query("SELECT l_orderkey, l_linestatus AS slot, round(avg(l_quantity), 7) AS mean_points FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL")
def slot_averages(t):
    x = t.lineitem.where("l_returnflag <> 'R'").groupBy("l_orderkey", F.col("l_linestatus").alias("slot"))
    return x.agg(F.round(F.avg("l_quantity"), 7).alias("mean_points"))
