"""Queries of the usage model: a customer is a player, its nation the team, its segment the position, a year a season, an order a game."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import distributions, expr as e
from ..operators import evaluate, features, model, shape, usage
from .registry import query

r = lambda c, n=4: F.round(c, n).alias(c)

_BASE = "ga AS (SELECT o_custkey AS id, CAST(year(o_orderdate) AS INTEGER) AS season, c_nationkey AS team, c_mktsegment AS pos, o_orderkey, o_totalprice / 970 AS price, month(o_orderdate) AS week, o_orderpriority AS pri, o_orderstatus AS st FROM orders JOIN customer ON o_custkey = c_custkey), se AS (SELECT id, season, team, pos, count(*) AS games, sum(price) AS total, avg(price) AS pg FROM ga GROUP BY ALL)"


def _games(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("season"), F.col("c_nationkey").alias("team"), F.col("c_mktsegment").alias("pos"), "o_orderkey", (F.col("o_totalprice") / 970).alias("price"), F.month("o_orderdate").alias("week"), F.col("o_orderpriority").alias("pri"), F.col("o_orderstatus").alias("st"))


def _seasons(t):
    return t.once("seasons", lambda: _season_totals(t))


def _season_totals(t):
    return _games(t).groupBy("id", "season", "team", "pos").agg(F.count("*").alias("games"), F.sum("price").alias("total"), F.avg("price").alias("pg"))


@query(f"WITH {_BASE}, a AS (SELECT id, season, sum(price) AS routes, count(*) AS route_games FROM ga WHERE pri < '3' GROUP BY ALL), b AS (SELECT id, season, avg(price) AS ngs FROM ga WHERE st = 'O' GROUP BY ALL), c AS (SELECT id, season, sum(CASE WHEN price > 300 THEN 1 ELSE 0 END) AS rz, count(*) AS team_rz FROM ga WHERE pri > '3' GROUP BY ALL) SELECT id, season, round(routes, 4) AS routes, route_games, round(ngs, 4) AS ngs, round(CASE WHEN team_rz > 0 THEN rz / team_rz WHEN team_rz IS NOT NULL THEN 0 END, 8) AS rz_share FROM a FULL JOIN b USING (id, season) FULL JOIN c USING (id, season)")
def advanced_totals(t):
    g, k = _games(t), ["id", "season"]
    a = g.where("pri < '3'").groupBy(*k).agg(F.sum("price").alias("routes"), F.count("*").alias("route_games"))
    b = g.where("st = 'O'").groupBy(*k).agg(F.avg("price").alias("ngs"))
    c = g.where("pri > '3'").groupBy(*k).agg(F.count_if(F.col("price") > 300).alias("rz"), F.count("*").alias("team_rz"))
    return usage.outer_totals([a, b, c], k).select(*k, r("routes"), "route_games", r("ngs"), F.round(usage.share_or_zero("rz", "team_rz"), 8).alias("rz_share"))


@query(f"WITH {_BASE} SELECT id, season, count(*) AS games, round(avg(price), 4) AS price_pg, round(avg(week * 20.0::DOUBLE), 4) AS guess_pg FROM ga GROUP BY ALL")
def expected_production(t):
    return usage.mean_production(_games(t).withColumn("guess", F.col("week") * 20.0), ["id", "season"], {"price": "guess"}).select("id", "season", "games", r("price_pg"), r("guess_pg"))


@query(f"WITH {_BASE} SELECT id, season, round(avg(price / 517), 6) AS mean_share, count(*) AS games FROM ga WHERE week > 3 GROUP BY ALL")
def snap_share(t):
    return usage.filtered_mean(_games(t).withColumns({"share": F.col("price") / 517, "snaps": F.col("week") - 3}), ["id", "season"], "share", "snaps").select("id", "season", r("mean_share", 6), "games")


_LINES = "li AS (SELECT l_suppkey AS id, l_returnflag AS pos, sum(l_discount * l_extendedprice) AS num, sum(l_extendedprice) AS den, avg(l_quantity) AS depth FROM lineitem GROUP BY ALL), ba AS (SELECT pos, sum(num) / sum(den) AS base_rate FROM li GROUP BY pos), mw AS (SELECT li.*, num / den AS rate, sum(den * depth) OVER w / sum(den) OVER w AS mx, sum(num) OVER w / sum(den) OVER w AS my FROM li WINDOW w AS (PARTITION BY pos)), wl AS (SELECT pos, count(*) AS n, sum(den * (depth - mx) * (rate - my)) / sum(den * (depth - mx) ** 2) AS slope, max(my) AS my, max(mx) AS mx FROM mw GROUP BY pos HAVING count(*) >= 60)"


def _lines(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("pos")).agg(F.sum(F.col("l_discount") * F.col("l_extendedprice")).alias("num"), F.sum("l_extendedprice").alias("den"), F.avg("l_quantity").alias("depth")).withColumn("own", F.col("num") / F.col("den"))


@query(f"WITH {_LINES} SELECT pos, round(my - slope * mx, 8) AS intercept, round(slope, 9) AS slope, n FROM wl")
def rate_baselines(t):
    return usage.weighted_line(_lines(t), ["pos"], "depth", "own", "den", 60).select("pos", r("intercept", 8), r("slope", 9), "n")


@query(f"WITH {_LINES}, x AS (SELECT mw.id, mw.pos, rate, den, CASE WHEN slope IS NULL THEN base_rate ELSE greatest(0, least(wl.my - slope * wl.mx + slope * depth, 3 * base_rate)) END AS prior FROM mw JOIN ba USING (pos) LEFT JOIN wl USING (pos)) SELECT id, pos, round(prior, 8) AS prior, round((den * rate + 500000 * prior) / (den + 500000), 8) AS rate FROM x")
def efficiency(t):
    x = _lines(t)
    base = features.pooled_rate(x, ["pos"], "num", "den")
    line = usage.weighted_line(x, ["pos"], "depth", "own", "den", 60)
    return usage.fitted_prior(x, base, line, ["pos"], "depth", "own", "den", 500_000.0).select("id", "pos", r("prior", 8), r("rate", 8))


_PROFILE = f"{_BASE}, pf AS (SELECT team, season, avg(price) AS pace, avg(CASE WHEN st = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS pass_share FROM ga GROUP BY ALL), sf AS (SELECT *, CASE WHEN (team + season) % 3 <> 0 THEN 'OC' || (team * 7 + season) % 11 END AS oc, 'HC' || (team + season) % 9 AS hc FROM pf), sl AS (SELECT *, coalesce(oc, hc) AS lead FROM sf WHERE season < 2000), mn AS (SELECT avg(pace) AS pace, avg(pass_share) AS pass_share FROM pf WHERE season < 2000), cp AS (SELECT lead, CAST(count(*) AS INTEGER) AS coach_seasons, (count(*) * avg(sl.pace) + 3 * max(mn.pace)) / (count(*) + 3) AS coach_pace, (count(*) * avg(sl.pass_share) + 3 * max(mn.pass_share)) / (count(*) + 3) AS coach_pass_share FROM sl CROSS JOIN mn GROUP BY lead), tp AS (SELECT team, CAST(count(*) AS INTEGER) AS team_seasons, avg(pace) AS team_pace, avg(pass_share) AS team_pass_share FROM pf WHERE season IN (1998, 1999) GROUP BY team)"
METRICS = ["pace", "pass_share"]


def _staff(t):
    pf = _games(t).groupBy("team", "season").agg(F.avg("price").alias("pace"), F.avg((F.col("st") == "F").cast("double")).alias("pass_share"))
    k = F.col("team") + F.col("season")
    x = pf.withColumns({"oc": F.when(k % 3 != 0, F.concat(F.lit("OC"), ((F.col("team") * 7 + F.col("season")) % 11).cast("string"))), "hc": F.concat(F.lit("HC"), (k % 9).cast("string"))})
    return usage.lead(x, "oc", "hc", "lead")


@query(f"WITH {_PROFILE} SELECT lead, coach_seasons, round(coach_pace, 5) AS coach_pace, round(coach_pass_share, 8) AS coach_pass_share FROM cp")
def coach_prior(t):
    return usage.shrunk_means(_staff(t).where("season < 2000"), "lead", METRICS, "coach_", 3.0).select("lead", "coach_seasons", r("coach_pace", 5), r("coach_pass_share", 8))


@query(f"WITH {_PROFILE}, nw AS (SELECT team, coalesce(oc, hc) AS lead FROM sf WHERE season = 2000) SELECT team, round(coalesce(coach_pace, mn.pace), 5) AS coach_pace, round(coalesce(team_pace, mn.pace), 5) AS team_pace, team_seasons FROM nw LEFT JOIN cp USING (lead) LEFT JOIN tp USING (team) CROSS JOIN mn")
def scheme_priors(t):
    staff = _staff(t)
    past = staff.where("season < 2000")
    coach = usage.shrunk_means(past, "lead", METRICS, "coach_", 3.0)
    team = usage.recent_means(staff, "team", "season", 2000, 2, METRICS, "team_")
    means = past.agg(*(F.avg(m).alias(m) for m in METRICS))
    x = usage.attach_priors(staff.where("season = 2000").select("team", "lead"), [(coach, "lead"), (team, "team")], METRICS, ["coach_", "team_"], means)
    return x.select("team", r("coach_pace", 5), r("team_pace", 5), "team_seasons")


_ROSTER = f"{_BASE}, ro AS (SELECT id, season, week, min((team + season * (id % 5) + id) % 25) AS team, min(1994 + id % 4) AS entry, min(DATE '1970-01-01' + CAST(id % 3000 AS INTEGER)) AS born FROM ga GROUP BY ALL)"


def _rosters(t):
    team = ((F.col("team") + F.col("season") * (F.col("id") % 5) + F.col("id")) % 25).alias("team")
    return _games(t).groupBy("id", "season", "week").agg(F.min(team).alias("team"), F.min(1994 + F.col("id") % 4).alias("entry"), F.min(F.date_add(F.lit("1970-01-01").cast("date"), (F.col("id") % 3000).cast("int"))).alias("born"))


@query(f"WITH {_ROSTER}, f AS (SELECT * FROM ro QUALIFY week = min(week) OVER (PARTITION BY season)), l AS (SELECT id, season, max_by(team, week) AS team FROM ro GROUP BY ALL) SELECT f.id, f.season, f.team <> l.team AS team_changed, entry >= f.season AS is_rookie, round(date_diff('day', born, make_date(f.season, 9, 1)) / 365.25, 6) AS age FROM f LEFT JOIN l ON l.id = f.id AND l.season = f.season - 1")
def roster_context(t):
    ro = _rosters(t)
    prior = ro.groupBy("id", "season").agg(F.max_by("team", "week").alias("team"))
    return usage.roster_context(ro, prior, "id", "season", "week", "team", "entry", "born").select("id", "season", "team_changed", "is_rookie", r("age", 6))


@query(f"WITH {_BASE}, la AS (SELECT season, coalesce(max(CASE WHEN week < 6 THEN week END), max(week)) AS w FROM ga GROUP BY season), x AS (SELECT ga.*, CAST(o_orderkey % 4 + 1 AS INTEGER) AS place FROM ga JOIN la ON la.season = ga.season AND ga.week = la.w), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season, id ORDER BY place, team, pos) AS rn FROM x) WHERE rn = 1) SELECT season, id, place AS depth_rank, place = 1 AS is_first, CAST(count(*) OVER (PARTITION BY season, team, pos) AS INTEGER) AS depth_group, team AS depth_team FROM b")
def depth_features(t):
    x = _games(t).withColumn("place", (F.col("o_orderkey") % 4 + 1).cast("int"))
    return usage.preseason_depth(x, "id", "season", "week", "team", "pos", "place", F.col("week") < 6)


@query(f"WITH {_BASE} SELECT o_orderkey, CAST(CASE pri WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END AS INTEGER) AS report_rank, CAST(CASE st WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS INTEGER) AS practice_rank FROM ga")
def injury_severity(t):
    return _games(t).select("o_orderkey", usage.severity("pri", {"1-URGENT": 3, "2-HIGH": 2, "3-MEDIUM": 1}).alias("report_rank"), usage.severity("st", {"F": 2, "P": 1}).alias("practice_rank"))


@query("WITH p AS (SELECT DISTINCT s_suppkey % 80 AS pfr, s_suppkey AS gsis FROM supplier WHERE s_suppkey % 10 <> 0), o AS (SELECT pfr, min(gsis) AS gsis FROM p GROUP BY pfr HAVING count(*) = 1), x AS (SELECT l_orderkey % 100 AS wk, l_suppkey % 80 AS pfr, l_orderkey * 10 + l_linenumber AS seq, l_tax FROM lineitem) SELECT wk, gsis, seq, l_tax FROM (SELECT *, row_number() OVER (PARTITION BY wk, gsis ORDER BY seq) AS rn FROM x JOIN o USING (pfr)) WHERE rn = 1")
def snap_counts_hop(t):
    p = t.supplier.where("s_suppkey % 10 <> 0").select((F.col("s_suppkey") % 80).alias("pfr"), F.col("s_suppkey").alias("gsis"))
    x = t.lineitem.select((F.col("l_orderkey") % 100).alias("wk"), (F.col("l_suppkey") % 80).alias("pfr"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_tax")
    return usage.hop(x, p, "pfr", "gsis", ["wk"], "seq").select("wk", "gsis", "seq", "l_tax")


# ---------------------------------------------------------------- fits and predictions

_FRAME = f"{_BASE}, fr AS (SELECT a.*, b.pg AS p1_pg, b.games AS p1_games, c.pg AS p2_pg, a.id % 7 = a.season % 7 AS changed, CASE WHEN a.id % 9 = 0 THEN a.id % 40 + 1 END AS pick FROM se a LEFT JOIN se b ON b.id = a.id AND b.season = a.season - 1 LEFT JOIN se c ON c.id = a.id AND c.season = a.season - 2)"


def _frame(t):
    x = features.lags(_seasons(t), "id", "season", ["pg", "games"])
    return x.withColumns({"changed": F.col("id") % 7 == F.col("season") % 7, "pick": F.when(F.col("id") % 9 == 0, F.col("id") % 40 + 1)}).drop("p2_games")


_VOLUME = f"{_FRAME}, vm AS (SELECT pos, regr_slope(pg, p1_pg) AS b, regr_intercept(pg, p1_pg) AS a, count(*) AS n FROM fr WHERE p1_pg > 0 GROUP BY pos HAVING count(*) >= 40), gm AS (SELECT pos, regr_slope(games / 20.0::DOUBLE, p1_games) AS b, regr_intercept(games / 20.0::DOUBLE, p1_games) AS a FROM fr WHERE p1_games IS NOT NULL GROUP BY pos), bn AS (SELECT *, CASE WHEN pick IS NULL THEN 'none' WHEN pick BETWEEN 1 AND 10 THEN '1-10' WHEN pick BETWEEN 11 AND 40 THEN '11-40' ELSE 'none' END AS bin FROM fr), rb AS (SELECT bin, avg(games / 20.0::DOUBLE) AS rate, avg(pg) AS volume, count(*) AS n FROM bn WHERE season = 1995 GROUP BY bin HAVING count(*) >= 5)"
BINS = [(1, 10), (11, 40)]


def _models(t):
    fr = _frame(t).withColumns({"share": F.col("games") / 20.0, "bin": usage.pick_bin(F.col("pick"), BINS), "twenty": F.lit(20.0)})
    volume = model.fit(fr.where("p1_pg > 0"), "pos", ["p1_pg"], "pg", least=40)
    games = model.fit(fr.where("p1_games IS NOT NULL"), "pos", ["p1_games"], "share")
    first = fr.where("season = 1995")
    rookies = usage.bin_rates(first, ["bin"], "games", "twenty").join(first.groupBy("bin").agg(F.avg("pg").alias("volume")), "bin")
    return fr, volume, games, rookies


@query(f"WITH {_VOLUME} SELECT pos, 'intercept' AS term, round(a, 5) AS value FROM vm UNION ALL SELECT pos, 'p1_pg', round(b, 7) FROM vm")
def volume_fit(t):
    _, volume, _, _ = _models(t)
    return volume.withColumn("value", F.when(F.col("term") == "intercept", F.round("value", 5)).otherwise(F.round("value", 7)))


@query(f"WITH {_VOLUME} SELECT bin, round(rate, 8) AS rate, n, round(volume, 5) AS volume FROM rb")
def rookie_bins(t):
    return _models(t)[3].select("bin", r("rate", 8), "n", r("volume", 5))


@query(f"WITH {_BASE} SELECT pos, round(sum(total) / sum(games), 6) AS per_game, CASE WHEN sum(total) >= 1e9 THEN 1.0::DOUBLE END AS thin FROM se WHERE season = 1995 GROUP BY pos")
def rookie_efficiency(t):
    x = _seasons(t).where("season = 1995")
    a = usage.pooled_rates(x, ["pos"], {"per_game": ("total", "games")}, 1.0)
    return a.join(usage.pooled_rates(x, ["pos"], {"thin": ("games", "total")}, 1e9), "pos").select("pos", r("per_game", 6), "thin")


_ARMS = f"{_VOLUME}, ar AS (SELECT bn.*, CASE WHEN id % 13 = 0 THEN 'abstain' WHEN season = 1995 THEN 'rookie' WHEN p1_pg IS NULL THEN 'abstain' ELSE 'veteran' END AS usg_arm FROM bn), pr AS (SELECT ar.*, CASE usg_arm WHEN 'veteran' THEN 20 * least(1, greatest(0, greatest(0, gm.a + gm.b * p1_games))) WHEN 'rookie' THEN 20 * rb.rate END AS eg, CASE usg_arm WHEN 'veteran' THEN greatest(0, vm.a + vm.b * p1_pg) WHEN 'rookie' THEN rb.volume END AS vol FROM ar LEFT JOIN vm USING (pos) LEFT JOIN gm USING (pos) LEFT JOIN rb USING (bin))"


def _predicted(t):
    fr, volume, games, rookies = _models(t)
    x = fr.withColumns({"out": F.col("id") % 13 == 0, "rookie": F.col("season") == 1995, "rate": F.lit(1.1)}).withColumn("usg_arm", usage.arm("p1_pg", "rookie", "out"))
    return usage.predicted(x, "pos", volume, ["p1_pg"], games, ["p1_games"], rookies, "bin", "rate", 20.0)


@query(f"WITH {_ARMS} SELECT id, season, usg_arm, round(eg, 4) AS expected_games, round(vol, 3) AS volume, round(eg * vol * 1.1, 2) AS usg FROM pr")
def usage_predictions(t):
    return _predicted(t).select("id", "season", "usg_arm", r("expected_games"), r("volume", 3), r("usg", 2))


@query(f"WITH {_ARMS} SELECT id, season, round(CASE WHEN eg > 0 THEN eg * vol * 1.1 * 17 / eg END, 2) AS usg FROM pr")
def full_slate(t):
    return _predicted(t).withColumns(usage.to_slate(["usg"], "expected_games", 17.0)).select("id", "season", r("usg", 2))


@query(f"WITH {_ARMS}, v AS (SELECT *, coalesce(p1_pg, 0) AS vv FROM pr), q AS (SELECT pos, vv AS cut FROM (SELECT pos, vv, row_number() OVER (PARTITION BY pos ORDER BY vv) AS k, count(*) OVER (PARTITION BY pos) AS n FROM v WHERE usg_arm = 'veteran') WHERE k = CAST(round_even((n - 1) * 0.25, 0) AS INTEGER) + 1), z AS (SELECT v.id, v.season, concat_ws('; ', CASE WHEN usg_arm = 'veteran' AND coalesce(p1_games, 99) < 2 THEN 'thin prior season' END, CASE WHEN usg_arm = 'veteran' AND changed THEN 'changed teams' END, CASE WHEN usg_arm = 'veteran' AND vv < cut THEN 'low prior volume' END) AS usg_evidence FROM v LEFT JOIN q USING (pos)) SELECT *, usg_evidence <> '' AS usg_thin FROM z")
def thin_evidence(t):
    x = _predicted(t).withColumn("vv", F.coalesce("p1_pg", F.lit(0.0)))
    return usage.evidence(x, "pos", "usg_arm", "vv", "p1_games", "changed", 2).select("id", "season", "usg_evidence", "usg_thin")


@query()
def games_intervals(t):
    x = _predicted(t).where("expected_games IS NOT NULL")
    return x.select("id", "season", distributions.games_interval("expected_games", 20, 0.05, 0.1).alias("low"), distributions.games_interval("expected_games", 20, 0.05, 0.9).alias("high"))


@query()
def games_calibration(t):
    return usage.calibration(_predicted(t), ["usg_arm"], "expected_games", "games", 20, 0.05)


_HELD = f"{_FRAME}, m AS (SELECT pos, regr_slope(games, p1_games) AS b, regr_intercept(games, p1_games) AS a FROM fr WHERE season <= (SELECT max(season) FROM fr) - 2 AND p1_games IS NOT NULL GROUP BY pos), ho AS (SELECT fr.*, greatest(0, a + b * p1_games) AS guess FROM fr JOIN m USING (pos) WHERE season > (SELECT max(season) FROM fr) - 2 AND p1_games IS NOT NULL)"


def _held(t):
    return usage.holdout(_frame(t), "season", "pos", ["p1_games"], "games", 2)


@query(f"WITH {_HELD}, s AS (SELECT pos, count(*) AS n, sum((games - guess) ** 2) AS ss, sum(20 * (guess / 20) * (1 - guess / 20)) AS v FROM ho WHERE guess IS NOT NULL GROUP BY pos) SELECT pos, n, round(least(0.95, greatest(0, (ss / v - 1) / 19)), 7) AS rho FROM s")
def games_dispersion(t):
    return usage.dispersion(_held(t), "pos", "prediction", "games", 20.0).select("pos", "n", r("rho", 7))


@query(f"WITH {_HELD}, s AS (SELECT pos, count(*) AS n, sum((games - guess) ** 2) AS sse, var_pop(games) AS v FROM ho WHERE guess IS NOT NULL GROUP BY pos) SELECT pos, n, round(1 - sse / (v * n), 7) AS r2 FROM s")
def holdout_r2(t):
    return evaluate.holdout_r2(_held(t), ["pos"], "prediction", "games").select("pos", "n", r("r2", 7))


@query(f"WITH {_BASE} SELECT a.id, a.season, b.games AS y_games, round(b.total, 4) AS y_total FROM se a LEFT JOIN se b ON b.id = a.id AND b.season = a.season + 1")
def training_frame(t):
    s = _seasons(t)
    out = s.withColumn("season", F.col("season") - 1)
    return usage.training_frame(s.select("id", "season"), out, ["id", "season"], ["games", "total"]).select("id", "season", "y_games", r("y_total"))


# ---------------------------------------------------------------- evaluation

_EV = "ev AS (SELECT l_partkey AS k, p_type AS pos, p_brand AS season, avg(l_quantity) AS a, avg(CASE WHEN l_returnflag <> 'A' THEN l_quantity END) AS b, avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS y FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"


def _ev(t):
    q = F.col("l_quantity")
    return t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_partkey").alias("k"), F.col("p_type").alias("pos"), F.col("p_brand").alias("season")).agg(F.avg(q).alias("a"), F.avg(F.when(F.col("l_returnflag") != "A", q)).alias("b"), F.avg(F.when(F.col("l_linestatus") == "O", q)).alias("y"))


@query(f"WITH {_EV}, c AS (SELECT season, pos, CASE WHEN stddev_pop(CASE WHEN y IS NOT NULL THEN a END) > 0 AND stddev_pop(y) > 0 THEN corr(a, y) END AS r, count(*) FILTER (WHERE y IS NOT NULL) AS n FROM ev GROUP BY ALL) SELECT pos, round(sum(r * n) / sum(CASE WHEN r IS NOT NULL THEN n END), 8) AS mean_r, CAST(sum(CASE WHEN r IS NOT NULL THEN n END) AS BIGINT) AS n FROM c GROUP BY pos")
def weighted_correlation(t):
    c = _ev(t).groupBy("season", "pos").agg(evaluate.correlation("a", "y").alias("r"), F.count("y").alias("n"))
    return evaluate.weighted_mean(c, ["pos"], "r", "n").select("pos", r("mean_r", 8), "n")


@query(f"WITH {_EV} SELECT pos, w AS weight, count(*) AS n, round(avg(abs((1 - w) * a + w * b - y)), 7) AS mae FROM ev CROSS JOIN (VALUES (0.0::DOUBLE), (0.25), (0.5)) v(w) WHERE b IS NOT NULL AND y IS NOT NULL GROUP BY ALL")
def blend_mae(t):
    return evaluate.blend_mae(_ev(t), ["pos"], "a", "b", "y", [0.0, 0.25, 0.5]).select("pos", "weight", "n", r("mae", 7))


@query(f"WITH {_EV}, d AS (SELECT pos, round(a, 9) AS a, round(b, 9) AS b, round(y, 9) AS y FROM ev WHERE b IS NOT NULL AND y IS NOT NULL), k AS (SELECT pos, rank() OVER (PARTITION BY pos ORDER BY a DESC) + (count(*) OVER (PARTITION BY pos, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY pos ORDER BY b DESC) + (count(*) OVER (PARTITION BY pos, b) - 1) / 2.0::DOUBLE AS rb, rank() OVER (PARTITION BY pos ORDER BY y DESC) + (count(*) OVER (PARTITION BY pos, y) - 1) / 2.0::DOUBLE AS ry FROM d) SELECT pos, count(*) AS n, round(corr(ra, ry), 8) AS rho_with, round(corr(rb, ry), 8) AS rho_without FROM k GROUP BY pos")
def spearman_without(t):
    x = _ev(t).withColumns({c: F.round(c, 9) for c in ("a", "b", "y")})
    return evaluate.spearman_without(x, "pos", "a", "b", "y").select("pos", "n", r("rho_with", 8), r("rho_without", 8))


@query(f"WITH {_EV}, m AS (SELECT CAST(k % 2 AS INTEGER) AS half, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM ev WHERE b IS NOT NULL AND y IS NOT NULL GROUP BY 1), s AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS p, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS q, greatest(0, ay / aa) AS wa, greatest(0, by_ / bb) AS wb FROM m) SELECT half, n, round(CASE WHEN p >= 0 AND q >= 0 THEN p WHEN wa * ay - wa * wa * aa / 2 >= wb * by_ - wb * wb * bb / 2 THEN wa ELSE 0 END, 6) AS weight_a, round(CASE WHEN p >= 0 AND q >= 0 THEN q WHEN wa * ay - wa * wa * aa / 2 >= wb * by_ - wb * wb * bb / 2 THEN 0 ELSE wb END, 6) AS weight_b FROM s")
def split_half_weights(t):
    x = _ev(t).withColumn("half", (F.col("k") % 2).cast("int"))
    return model.nnls_weights(x, ["half"], ["a", "b"], "y").select("half", "n", F.round(F.col("weights")["a"], 6).alias("weight_a"), F.round(F.col("weights")["b"], 6).alias("weight_b"))


@query(f"WITH {_BASE}, p AS (SELECT pos, quantile_cont(games, 0.95) AS n FROM se GROUP BY pos) SELECT pos, n, round(6 / (n + 6), 8) AS prior_weight FROM p")
def prior_weight(t):
    return evaluate.prior_weight(_seasons(t), ["pos"], "games", 6.0).select("pos", "n", r("prior_weight", 8))


@query("SELECT n_name, count(*) AS n, count(o.k) AS matched, round(100.0::DOUBLE * count(o.k) / count(*), 1) AS matched_pct FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') o ON o.k = c_custkey GROUP BY n_name")
def match_share(t):
    c = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).withColumnRenamed("c_custkey", "k")
    return evaluate.match_share(c, t.orders.where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "k"), "k", ["n_name"])


_PLAYED = f"{_BASE}, us AS (SELECT DISTINCT season, week, id, team FROM ga WHERE price > 300), gr AS (SELECT ga.*, EXISTS (SELECT 1 FROM us WHERE us.season = ga.season AND us.week = ga.week AND us.id = ga.id) AS played, EXISTS (SELECT 1 FROM us WHERE us.season = ga.season AND us.week = ga.week AND us.team = ga.team) AS team_played FROM ga)"


@query(f"WITH {_PLAYED} SELECT pop, count(*) AS n, round(avg(abs(price - 250)), 5) AS mae FROM (SELECT 'all' AS pop, price FROM gr UNION ALL SELECT 'team', price FROM gr WHERE team_played UNION ALL SELECT 'played', price FROM gr WHERE played) GROUP BY pop")
def populations(t):
    g = _games(t)
    x = evaluate.attach_played(g, g.where("price > 300"), ["season", "week"], "id", "team")
    pops = F.array(*(F.when(evaluate.common_mask("played", p), p) for p in ("all", "team", "played")))
    return x.select("price", F.explode(F.array_compact(pops)).alias("pop")).groupBy("pop").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("price") - 250)), 5).alias("mae"))


@query(f"WITH {_EV}, x AS (SELECT season, pos, row_number() OVER (PARTITION BY season, pos ORDER BY round(a, 9) DESC, k) AS p, row_number() OVER (PARTITION BY season, pos ORDER BY round(b, 9) DESC NULLS LAST, k) AS q FROM ev), h AS (SELECT season, pos, sum(CASE WHEN p <= 5 AND q <= 5 THEN 1 ELSE 0 END) / least(5, count(*)) AS h FROM x GROUP BY ALL) SELECT pos, round(avg(h), 8) AS hit_rate, count(*) AS seasons FROM h GROUP BY pos")
def topn_by_season(t):
    x = _ev(t).withColumns({"a": F.round("a", 9), "b": F.round("b", 9)})
    return evaluate.top_n_hits_by_season(x, "season", "pos", "k", "a", "b", 5).select("pos", r("hit_rate", 8), "seasons")


@query(f"WITH {_EV}, u AS (SELECT 'with' AS variant, pos, (a + coalesce(b, a)) / 2 AS v, y FROM ev UNION ALL SELECT 'without', pos, a, y FROM ev) SELECT variant, pos, count(*) AS n, round(avg(abs(v - y)), 7) AS mae FROM u WHERE y IS NOT NULL GROUP BY ALL")
def counterfactual_variants(t):
    x = _ev(t)
    v = F.array(F.struct(F.lit("with").alias("variant"), ((F.col("a") + F.coalesce("b", "a")) / 2).alias("v")), F.struct(F.lit("without").alias("variant"), F.col("a").alias("v")))
    return x.where("y IS NOT NULL").select("pos", "y", F.inline(v)).groupBy("variant", "pos").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("v") - F.col("y"))), 7).alias("mae"))


# ---------------------------------------------------------------- stickiness, bands, statuses


@query(f"WITH {_BASE} SELECT a.pos, count(*) AS n, round(corr(a.pg, b.pg), 8) AS r FROM se a JOIN se b ON b.id = a.id AND b.season = a.season - 1 GROUP BY a.pos")
def stickiness(t):
    x = features.lags(_seasons(t), "id", "season", ["pg"], by=(1,)).where("p1_pg IS NOT NULL")
    return x.groupBy("pos").agg(F.count("*").alias("n"), F.round(evaluate.correlation("pg", "p1_pg"), 8).alias("r"))


@query(f"WITH {_BASE}, b AS (SELECT id, team, season, CASE WHEN week <= 5 THEN 'rz5' WHEN week <= 10 THEN 'rz10' ELSE 'rz20' END AS band, count(*) AS own FROM ga WHERE week <= 20 GROUP BY ALL) SELECT id, season, band, own, CAST(sum(own) OVER (PARTITION BY team, season, band) AS BIGINT) AS team_total, round(own / sum(own) OVER (PARTITION BY team, season, band), 8) AS share FROM b")
def red_zone_bands(t):
    band = F.when(F.col("week") <= 5, "rz5").when(F.col("week") <= 10, "rz10").when(F.col("week") <= 20, "rz20")
    b = _games(t).withColumn("band", band).where("band IS NOT NULL").groupBy("id", "team", "season", "band").agg(F.count("*").alias("own"))
    whole = F.sum("own").over(Window.partitionBy("team", "season", "band"))
    return b.select("id", "season", "band", "own", whole.alias("team_total"), F.round(F.col("own") / whole, 8).alias("share"))


@query(f"WITH {_BASE} SELECT st, pri, count(*) AS n, round(avg(CASE WHEN price > 250 THEN 1.0::DOUBLE ELSE 0 END), 8) AS played FROM ga GROUP BY ALL")
def availability_by_status(t):
    return _games(t).groupBy("st", "pri").agg(F.count("*").alias("n"), F.round(F.avg((F.col("price") > 250).cast("double")), 8).alias("played"))


@query(f"WITH {_BASE}, pr AS (SELECT team, season, id, sum(CASE WHEN week <= 6 THEN price END) AS rush, sum(CASE WHEN week > 6 THEN price END) AS rec, count(*) AS tds FROM ga GROUP BY ALL) SELECT id, season, round(CASE WHEN coalesce(rush, 0) + coalesce(rec, 0) > 0 THEN tds * coalesce(rush, 0) / (coalesce(rush, 0) + coalesce(rec, 0)) END, 7) AS rush_tds, round(CASE WHEN coalesce(rush, 0) + coalesce(rec, 0) > 0 THEN tds * coalesce(rec, 0) / (coalesce(rush, 0) + coalesce(rec, 0)) END, 7) AS rec_tds FROM pr")
def anytime_split(t):
    s = lambda c: F.coalesce(F.sum(F.when(F.expr(c), F.col("price"))), F.lit(0.0))
    x = _games(t).groupBy("team", "season", "id").agg(s("week <= 6").alias("rush"), s("week > 6").alias("rec"), F.count("*").alias("tds")).withColumn("both", F.col("rush") + F.col("rec"))
    part = lambda c: F.round(F.col("tds") * e.safe_ratio(c, "both"), 7)
    return x.select("id", "season", part("rush").alias("rush_tds"), part("rec").alias("rec_tds"))


@query("WITH g AS (SELECT l_orderkey AS game, l_linenumber % 2 AS side, avg(l_quantity) AS spread, avg(l_discount) AS total FROM lineitem GROUP BY ALL), u AS (SELECT game, side, 'spread' AS market, spread AS line FROM g UNION ALL SELECT game, side, 'total', total FROM g) SELECT game, market, round(max(CASE WHEN side = 0 THEN line END), 6) AS away, round(max(CASE WHEN side = 1 THEN line END), 6) AS home FROM u GROUP BY game, market")
def game_lines(t):
    """A game has but a few lines, so its rows are dealt first: sums before the shuffle would hold nearly as many groups as rows."""
    side = F.col("l_linenumber") % 2
    mean = lambda c, k: F.avg(F.when(side == k, F.col(c)))
    lines = t.lineitem.select(F.col("l_orderkey").alias("game"), "l_linenumber", "l_quantity", "l_discount").repartition("game")
    g = lines.groupBy("game").agg(*(F.struct(mean(c, 0).alias("away"), mean(c, 1).alias("home")).alias(m) for m, c in (("spread", "l_quantity"), ("total", "l_discount"))))
    p = shape.melt(g, ["game"], ["spread", "total"], "market", "line")
    return p.select("game", "market", F.round("line.away", 6).alias("away"), F.round("line.home", 6).alias("home"))
