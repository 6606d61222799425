"""Queries of the tendency, model, evaluation, history, simulation and odds families."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import distributions, expr as e
from ..operators import evaluate, history, model, simulate, tendencies
from ..sources.scratch import written
from .registry import query

# actor: nation of the customer, kind: order priority, season: year, time: month
_PICKS = "pk AS (SELECT year(o_orderdate) AS season, c_nationkey AS owner, o_orderpriority AS kind, month(o_orderdate) AS round, o_totalprice AS price, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)"


def _picks(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.year("o_orderdate").alias("season"), F.col("c_nationkey").alias("owner"), F.col("o_orderpriority").alias("kind"), F.month("o_orderdate").alias("round"), F.col("o_totalprice").alias("price"), "o_orderkey")


@query(f"WITH {_PICKS}, f AS (SELECT season, owner, kind, min(round)::DOUBLE AS first FROM pk GROUP BY ALL), g AS (SELECT a.season, a.owner, k.kind FROM (SELECT DISTINCT season, owner FROM pk) a CROSS JOIN (SELECT DISTINCT kind FROM pk) k), x AS (SELECT g.*, coalesce(f.first, 13) AS first FROM g LEFT JOIN f ON f.season = g.season AND f.owner = g.owner AND f.kind = g.kind), d AS (SELECT season, owner, kind, first - (sum(first) OVER w - first) / (count(*) OVER w - 1) AS dev, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY season, kind)), m AS (SELECT *, avg(dev) OVER (PARTITION BY owner, kind) AS mean FROM d WHERE n > 1) SELECT owner, kind, round(avg(dev), 6) AS mean_dev, round(avg(CASE WHEN sign(dev) = sign(mean) THEN 1.0 ELSE 0 END), 6) AS consistency, count(*) AS seasons FROM m GROUP BY owner, kind")
def timing_grid_censored(t):
    return tendencies.timing(_picks(t), "owner", "kind", "season", "round", 12).select("owner", "kind", F.round("mean_dev", 6).alias("mean_dev"), F.round("consistency", 6).alias("consistency"), "seasons")


@query(f"WITH {_PICKS}, n AS (SELECT season, owner, kind, count(*) AS n FROM pk GROUP BY ALL), g AS (SELECT a.season, a.owner, k.kind FROM (SELECT DISTINCT season, owner FROM pk) a CROSS JOIN (SELECT DISTINCT kind FROM pk) k), x AS (SELECT g.*, coalesce(n.n, 0) AS n FROM g LEFT JOIN n ON n.season = g.season AND n.owner = g.owner AND n.kind = g.kind), s AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY season, owner) AS share FROM x), d AS (SELECT *, share - (sum(share) OVER w - share) / nullif(count(*) OVER w - 1, 0) AS delta FROM s WINDOW w AS (PARTITION BY season, kind)) SELECT owner, kind, round(avg(share), 7) AS share, round(avg(delta), 7) AS delta FROM d GROUP BY owner, kind")
def share_vs_room(t):
    return tendencies.share_against_room(_picks(t), "owner", "kind", "season").select("owner", "kind", F.round("share", 7).alias("share"), F.round("delta", 7).alias("delta"))


@query(f"WITH {_PICKS}, n AS (SELECT season, owner, count(*) AS n FROM pk GROUP BY ALL), p AS (SELECT season, kind, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY season) AS p FROM pk GROUP BY season, kind), g AS (SELECT season, owner, kind, count(*) AS got FROM pk GROUP BY ALL), x AS (SELECT n.owner, p.kind, coalesce(got, 0) AS got, n * p AS e, n * p * (1 - p) AS v FROM n JOIN p ON p.season = n.season LEFT JOIN g ON g.season = n.season AND g.owner = n.owner AND g.kind = p.kind), a AS (SELECT owner, kind, sum(got) AS observed, sum(e) AS expected, sum(v) AS var FROM x GROUP BY ALL) SELECT owner, kind, CAST(observed AS BIGINT) AS observed, round(expected, 6) AS expected, round(observed / expected, 6) AS lift, round(CASE WHEN var > 0 THEN (observed - expected) / sqrt(var) END, 6) AS z FROM a WHERE observed > 0")
def lift_z(t):
    r = lambda c: F.round(c, 6).alias(c)
    return tendencies.lean(_picks(t), "owner", "kind", "season").select("owner", "kind", "observed", r("expected"), r("lift"), r("z"))


@query("WITH pk AS (SELECT DISTINCT year(o_orderdate) AS season, o_custkey % 40 AS owner, l_suppkey AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey), t AS (SELECT owner, item, count(DISTINCT season) AS times FROM pk GROUP BY ALL HAVING count(DISTINCT season) >= 3), c AS (SELECT t.owner, t.item, count(*) AS chances FROM t JOIN (SELECT DISTINCT owner, season FROM pk) a ON a.owner = t.owner JOIN (SELECT DISTINCT item, season FROM pk) i ON i.item = t.item AND i.season = a.season GROUP BY ALL) SELECT t.owner, t.item, t.times, CAST(c.chances AS INTEGER) AS chances, round(times / chances, 9) AS loyalty FROM t JOIN c ON c.owner = t.owner AND c.item = t.item")
def loyalty_intersection(t):
    x = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.year("o_orderdate").alias("season"), (F.col("o_custkey") % 40).alias("owner"), F.col("l_suppkey").alias("item"))
    return tendencies.loyalty(x, "owner", "item", "season", 3).withColumn("loyalty", F.round("loyalty", 9))


@query(f"WITH {_PICKS}, r AS (SELECT *, row_number() OVER (PARTITION BY season, owner ORDER BY price DESC, o_orderkey) AS rn FROM pk), s AS (SELECT season, owner, sum(CASE WHEN rn <= 3 THEN price END) / sum(price) AS c FROM r GROUP BY ALL) SELECT owner, round(avg(c), 7) AS concentration FROM s GROUP BY owner")
def auction_concentration(t):
    return tendencies.top_share(_picks(t), "owner", "season", "price", 3).withColumn("concentration", F.round("concentration", 7))


@query(f"WITH {_PICKS}, r AS (SELECT season, owner, avg(CASE WHEN kind = '5-LOW' THEN NULL WHEN kind = '1-URGENT' THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM pk GROUP BY ALL), x AS (SELECT *, CASE WHEN count(rate) OVER w > 1 THEN (sum(rate) OVER w - rate) / (count(rate) OVER w - 1) END AS room FROM r WINDOW w AS (PARTITION BY season)) SELECT owner, round(avg(rate), 7) AS rate, round(avg(room), 7) AS room FROM x GROUP BY owner")
def habits(t):
    x = _picks(t).withColumn("urgent", F.when(F.col("kind") != "5-LOW", F.col("kind") == "1-URGENT"))
    return tendencies.habits(x, "owner", "urgent", "season").select("owner", F.round("rate", 7).alias("rate"), F.round("room", 7).alias("room"))


@query(f"WITH {_PICKS}, n AS (SELECT season, owner, count(*) AS n FROM pk GROUP BY ALL), p AS (SELECT season, kind, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY season) AS p FROM pk GROUP BY season, kind), g AS (SELECT season, owner, kind, count(*) AS got FROM pk GROUP BY ALL), x AS (SELECT n.owner, p.kind, coalesce(got, 0) AS got, n * p AS e, n * p * (1 - p) AS v FROM n JOIN p ON p.season = n.season LEFT JOIN g ON g.season = n.season AND g.owner = n.owner AND g.kind = p.kind), a AS (SELECT owner, kind, sum(got) AS observed, sum(e) AS expected, sum(v) AS var FROM x GROUP BY ALL), z AS (SELECT owner, kind, (observed - expected) / sqrt(var) AS z, CAST(round_even(100 * (observed / expected - 1), 0) AS BIGINT) AS pct FROM a WHERE observed > 0 AND var > 0), s AS (SELECT owner, z, 'takes ' || kind || ' ' || CASE WHEN pct >= 0 THEN '+' ELSE '' END || pct || '% against the room' AS text FROM z WHERE abs(z) >= 1), r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY abs(z) DESC, text) AS rn FROM s) SELECT owner, string_agg(text, '; ' ORDER BY rn) AS traits FROM r WHERE rn <= 3 GROUP BY owner")
def trait_sentences(t):
    x = tendencies.lean(_picks(t), "owner", "kind", "season").where("abs(z) >= 1")
    text = F.concat(F.lit("takes "), "kind", F.lit(" "), e.signed_percent(F.col("lift") - 1), F.lit(" against the room"))
    return tendencies.traits(x, "owner", "kind", "z", text)


_COMPOSED = """
ti AS (WITH f AS (SELECT season, owner, kind, min(round)::DOUBLE AS first FROM pk GROUP BY ALL), g AS (SELECT a.season, a.owner, k.kind FROM (SELECT DISTINCT season, owner FROM pk) a CROSS JOIN (SELECT DISTINCT kind FROM pk) k), x AS (SELECT g.*, coalesce(f.first, 13) AS first FROM g LEFT JOIN f ON f.season = g.season AND f.owner = g.owner AND f.kind = g.kind), d AS (SELECT season, owner, kind, first - (sum(first) OVER w - first) / (count(*) OVER w - 1) AS dev, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY season, kind)), m AS (SELECT *, avg(dev) OVER (PARTITION BY owner, kind) AS mean FROM d WHERE n > 1) SELECT owner, kind, avg(dev) AS mean_dev, avg(CASE WHEN sign(dev) = sign(mean) THEN 1.0 ELSE 0 END) AS consistency, count(*) AS seasons FROM m GROUP BY owner, kind),
bu AS (WITH n AS (SELECT season, owner, kind, count(*) AS n FROM pk WHERE round <= 3 GROUP BY ALL), g AS (SELECT a.season, a.owner, k.kind FROM (SELECT DISTINCT season, owner FROM pk WHERE round <= 3) a CROSS JOIN (SELECT DISTINCT kind FROM pk WHERE round <= 3) k), x AS (SELECT g.*, coalesce(n.n, 0) AS n FROM g LEFT JOIN n ON n.season = g.season AND n.owner = g.owner AND n.kind = g.kind), s AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY season, owner) AS share FROM x), d AS (SELECT *, share - (sum(share) OVER w - share) / nullif(count(*) OVER w - 1, 0) AS delta FROM s WINDOW w AS (PARTITION BY season, kind)) SELECT owner, kind, avg(delta) AS delta FROM d GROUP BY owner, kind),
le AS (WITH n AS (SELECT season, owner, count(*) AS n FROM pk GROUP BY ALL), p AS (SELECT season, kind, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY season) AS p FROM pk GROUP BY season, kind), g AS (SELECT season, owner, kind, count(*) AS got FROM pk GROUP BY ALL), x AS (SELECT n.owner, p.kind, coalesce(got, 0) AS got, n * p AS e, n * p * (1 - p) AS v FROM n JOIN p ON p.season = n.season LEFT JOIN g ON g.season = n.season AND g.owner = n.owner AND g.kind = p.kind), a AS (SELECT owner, kind, sum(got) AS observed, sum(e) AS expected, sum(v) AS var FROM x GROUP BY ALL) SELECT owner, kind, CAST(observed AS BIGINT) AS observed, CASE WHEN var > 0 THEN (observed - expected) / sqrt(var) END AS z FROM a WHERE observed > 0),
ca AS (SELECT owner, 'timing' AS kind, abs(mean_dev) / 0.25 AS score, CASE WHEN mean_dev < 0 THEN 'Takes ' || kind || ' early.' ELSE 'Waits on ' || kind || '.' END AS text FROM ti WHERE abs(mean_dev) >= 0.25 AND seasons >= 2 AND consistency >= 0.6
 UNION ALL SELECT owner, 'build', abs(delta) / 0.01, CASE WHEN delta > 0 THEN 'Leans on ' ELSE 'Skips ' END || kind || ' early.' FROM bu WHERE abs(delta) >= 0.01 UNION ALL SELECT owner, 'team', z / 1.0, 'Has ' || observed || ' ' || kind || ' picks.' FROM le WHERE z >= 1),
ok AS (SELECT *, row_number() OVER (PARTITION BY owner, kind ORDER BY round(score, 6) DESC, text) AS k FROM ca),
oc AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY round(score, 6) DESC, kind, text) AS rn FROM ok WHERE k <= CASE kind WHEN 'timing' THEN 2 ELSE 1 END),
ag AS (SELECT owner, string_agg(text, ' ' ORDER BY rn) AS said, min_by(kind, rn) AS headline FROM oc WHERE rn <= 3 GROUP BY owner),
sn AS (SELECT owner, count(DISTINCT season) AS seasons FROM pk GROUP BY owner)"""


@query(f"WITH {_PICKS}, {_COMPOSED} SELECT sn.owner, seasons, CASE WHEN seasons < 2 THEN 'One draft on record: nothing here is a tendency yet.' WHEN said IS NULL THEN 'Drafts near consensus over ' || seasons || ' drafts.' ELSE said || ' (' || seasons || ' drafts)' END AS traits, CASE WHEN seasons >= 2 THEN headline END AS headline FROM sn LEFT JOIN ag ON ag.owner = sn.owner")
def trait_composition(t):
    """Three kinds of tendency, each with its own threshold, made one description per owner."""
    pk = t.once("picks", lambda: _picks(t))
    parts = [
        tendencies.timing_traits(tendencies.timing(pk, "owner", "kind", "season", "round", 12), "owner", "kind", 0.25),
        tendencies.build_traits(tendencies.early_build(pk, "owner", "kind", "season", "round", 3), "owner", "kind", 0.01),
        tendencies.team_traits(tendencies.lean(pk, "owner", "kind", "season"), "owner", "kind", 1.0),
    ]
    seasons = pk.groupBy("owner").agg(F.count_distinct("season").alias("seasons"))
    return tendencies.compose(parts[0].unionByName(parts[1]).unionByName(parts[2]), seasons, "owner")


# ---------------------------------------------------------------- models and evaluation


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2 FROM lineitem GROUP BY l_returnflag")
def regr_single(t):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 5).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 9).alias("r2"))


_LS = "m AS (SELECT l_returnflag AS g, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_sxx(l_extendedprice, l_discount) AS szz, regr_sxy(l_extendedprice, l_quantity) AS sxy, regr_sxy(l_extendedprice, l_discount) AS szy, regr_sxy(l_discount, l_quantity) AS sxz, avg(l_quantity) AS mx, avg(l_discount) AS mz, avg(l_extendedprice) AS my FROM lineitem GROUP BY 1), b AS (SELECT g, (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) AS b1, (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) AS b2, mx, mz, my FROM m)"


@query(f"WITH {_LS} SELECT g AS l_returnflag, 'intercept' AS term, round(my - b1 * mx - b2 * mz, 3) AS value FROM b UNION ALL SELECT g, 'l_quantity', round(b1, 3) FROM b UNION ALL SELECT g, 'l_discount', round(b2, 3) FROM b")
def ols_two_term(t):
    return model.fit(t.lineitem, "l_returnflag", ["l_quantity", "l_discount"], "l_extendedprice").withColumn("value", F.round("value", 3))


@query("WITH m AS (SELECT l_returnflag AS g, count(*) AS n, stddev_pop(l_quantity) AS s1, stddev_pop(l_discount) AS s2, corr(l_quantity, l_discount) AS r, covar_pop(l_quantity, l_extendedprice) / stddev_pop(l_quantity) AS r1, covar_pop(l_discount, l_extendedprice) / stddev_pop(l_discount) AS r2, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my FROM lineitem GROUP BY 1), b AS (SELECT *, 1 + 500.0 / n AS a FROM m), c AS (SELECT *, (r1 * a - r2 * r) / (a * a - r * r) / s1 AS b1, (r2 * a - r1 * r) / (a * a - r * r) / s2 AS b2 FROM b) SELECT g AS l_returnflag, 'intercept' AS term, round(my - b1 * m1 - b2 * m2, 3) AS value FROM c UNION ALL SELECT g, 'l_quantity', round(b1, 3) FROM c UNION ALL SELECT g, 'l_discount', round(b2, 3) FROM c")
def ridge(t):
    return model.fit(t.lineitem, "l_returnflag", ["l_quantity", "l_discount"], "l_extendedprice", ridge=500.0, least=30).withColumn("value", F.round("value", 3))


@query(f"WITH {_LS} SELECT l_returnflag, round(avg(abs(l_extendedprice - greatest(0, my - b1 * mx - b2 * mz + b1 * l_quantity + b2 * l_discount))), 3) AS mae, count(*) AS n FROM lineitem JOIN b ON g = l_returnflag GROUP BY l_returnflag")
def predict_and_mae(t):
    xs = ["l_quantity", "l_discount"]
    p = model.predict(t.lineitem, model.fit(t.lineitem, "l_returnflag", xs, "l_extendedprice"), "l_returnflag", xs)
    return evaluate.mae(p, "l_returnflag", "l_extendedprice", ["prediction"]).select("l_returnflag", F.round("mae_prediction", 3).alias("mae"), "n")


@query("WITH x AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS season, l_extendedprice AS y, l_quantity AS q FROM lineitem), f AS (SELECT s.season, regr_slope(y, q) AS b, regr_intercept(y, q) AS a FROM (SELECT DISTINCT season FROM x) s JOIN x ON x.season < s.season GROUP BY 1) SELECT x.season, round(avg(abs(y - greatest(0, a + b * q))), 3) AS mae, count(*) AS n FROM x JOIN f ON x.season = f.season GROUP BY 1")
def walk_forward(t):
    x = t.lineitem.withColumn("season", F.year("l_shipdate"))
    p = model.predict(x, model.fit_before(x, "season", ["l_quantity"], "l_extendedprice"), "season", ["l_quantity"])
    return evaluate.mae(p, "season", "l_extendedprice", ["prediction"]).select("season", F.round("mae_prediction", 3).alias("mae"), "n")


# a customer's year against its year before: a veteran has one, a rookie is known by its account alone
_CAREERS = "ca AS (SELECT o_custkey AS id, CAST(year(o_orderdate) AS INTEGER) AS season, sum(o_totalprice) / 1000 AS y, CAST(max(c_acctbal) AS DOUBLE) AS known FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), cf AS (SELECT c.*, p.y AS last, CASE WHEN p.y IS NULL THEN 'rookie' ELSE 'veteran' END AS arm FROM ca c LEFT JOIN ca p ON p.id = c.id AND p.season = c.season - 1)"


def _careers(t):
    x = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("season")).agg((F.sum("o_totalprice") / 1000).alias("y"), F.max("c_acctbal").cast("double").alias("known"))
    w = Window.partitionBy("id").orderBy("season").rangeBetween(-1, -1)
    x = x.withColumn("last", F.max("y").over(w))
    return written(x.withColumn("arm", F.when(F.col("last").isNull(), "rookie").otherwise("veteran")))


@query(f"WITH {_CAREERS}, x AS (SELECT *, CASE arm WHEN 'veteran' THEN last ELSE known END AS q FROM cf), m AS (SELECT s.season, s.arm, count(*) AS n, regr_slope(x.y, x.q) AS b, regr_intercept(x.y, x.q) AS a, regr_syy(x.y, x.q) - regr_slope(x.y, x.q) * regr_sxy(x.y, x.q) AS rest FROM (SELECT DISTINCT season, arm FROM x) s JOIN x ON x.arm = s.arm AND x.season < s.season GROUP BY ALL HAVING count(*) >= 3), p AS (SELECT x.*, CASE WHEN a IS NOT NULL THEN greatest(0, a + b * q) END AS g, sqrt(rest / (m.n - 2)) AS sd FROM x LEFT JOIN m ON m.season = x.season AND m.arm = x.arm) SELECT season, arm, count(*) AS n, count(g) AS spoke, count(*) FILTER (WHERE y >= greatest(0, g - 1.2815515655446004::DOUBLE * sd) AND y <= g + 1.2815515655446004::DOUBLE * sd) AS covered, count(*) FILTER (WHERE y < greatest(0, g - 1.2815515655446004::DOUBLE * sd)) AS below, count(*) FILTER (WHERE y > g + 1.2815515655446004::DOUBLE * sd) AS above, round(avg(abs(y - g)), 5) AS mae, round(max(sd), 5) AS sigma FROM p GROUP BY ALL")
def walk_forward_coverage(t):
    x = model.walk_forward(_careers(t), "season", "arm", {"veteran": ["last"], "rookie": ["known"]}, "y", 1.2815515655446004)
    return x.select("season", "arm", "n", "spoke", "covered", "below", "above", F.round("mae", 5).alias("mae"), F.round("sigma", 5).alias("sigma"))


@query("WITH r AS (SELECT p_type, rank() OVER (PARTITION BY p_type ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2.0 AS x, rank() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC) + (count(*) OVER (PARTITION BY p_type, p_retailprice) - 1) / 2.0 AS y FROM part) SELECT p_type, count(*) AS n, round(corr(x::DOUBLE, y::DOUBLE), 9) AS rho FROM r GROUP BY p_type")
def spearman_in_group(t):
    return evaluate.spearman(t.part, "p_type", "p_size", "p_retailprice").withColumn("rho", F.round("rho", 9))


@query("WITH c AS (SELECT l_returnflag, corr(l_extendedprice, l_quantity) AS xy, corr(l_extendedprice, l_tax) AS xz, corr(l_quantity, l_tax) AS yz FROM lineitem GROUP BY 1) SELECT l_returnflag, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 9) AS r FROM c")
def partial_corr(t):
    c = F.corr
    return t.lineitem.groupBy("l_returnflag").agg(c("l_extendedprice", "l_quantity").alias("xy"), c("l_extendedprice", "l_tax").alias("xz"), c("l_quantity", "l_tax").alias("yz")).select("l_returnflag", F.round(evaluate.partial_corr(F.col("xy"), F.col("xz"), F.col("yz")), 9).alias("r"))


@query("WITH x AS (SELECT p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS a, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS b FROM part) SELECT p_type, round(sum(CASE WHEN a <= 50 AND b <= 50 THEN 1 ELSE 0 END) / least(50, count(*)), 9) AS hit_rate FROM x GROUP BY p_type")
def topn_hit(t):
    return evaluate.top_n_hits(t.part, "p_type", "p_partkey", "p_size", "p_retailprice", 50).withColumn("hit_rate", F.round("hit_rate", 9))


@query("WITH s AS (SELECT l_partkey, l_returnflag AS s, avg(l_quantity) - 25 AS r FROM lineitem GROUP BY ALL) SELECT a.s AS a, b.s AS b, count(*) AS n, round(corr(a.r, b.r), 9) AS r FROM s a JOIN s b ON a.l_partkey = b.l_partkey AND a.s < b.s GROUP BY ALL")
def residual_correlations(t):
    x = t.lineitem.groupBy("l_partkey", F.col("l_returnflag").alias("s")).agg((F.avg("l_quantity") - 25).alias("r"))
    return evaluate.residual_correlations(x, ["l_partkey"], "s", "r").withColumn("r", F.round("r", 9))


@query("WITH p AS (SELECT l_partkey AS k, l_returnflag AS pool, sum(CASE WHEN l_quantity > 40 THEN l_quantity END) AS v FROM lineitem GROUP BY ALL) SELECT k, arg_min(v, CASE WHEN v IS NOT NULL THEN pool END) AS v, max(v) - min(v) AS disagreement, count(v) AS pools FROM p GROUP BY k")
def evalset_collapse(t):
    p = t.lineitem.groupBy(F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("pool")).agg(F.sum(F.when(F.col("l_quantity") > 40, F.col("l_quantity"))).alias("v"))
    return evaluate.collapse(p, ["k"], "v", "pool")


@query("SELECT 'p_size' AS \"column\", count(*) AS cells, CAST(sum(CASE WHEN p_partkey % 100 = 7 OR p_partkey % 50 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS differing, 1.0::DOUBLE AS max_diff FROM part UNION ALL SELECT 'p_retailprice', count(*), CAST(sum(CASE WHEN p_partkey % 50 = 3 THEN 1 ELSE 0 END) AS BIGINT), 0.0 FROM part")
def frame_diff_tolerance(t):
    new = t.part.where("p_partkey % 50 <> 3").withColumn("p_size", F.col("p_size") + (F.col("p_partkey") % 100 == 7).cast("int")).withColumn("p_retailprice", F.col("p_retailprice") + 1e-12)
    d = evaluate.frame_diff(t.part, new, ["p_partkey"], ["p_size", "p_retailprice"])
    return d.withColumn("max_diff", F.round("max_diff", 6))


@query("WITH b AS (SELECT * FROM (VALUES ('a', 0, 10), ('b', 10, 30), ('c', 30, 50)) v(band, low, high)), e AS (SELECT band, l_extendedprice - 1500 * l_quantity AS e FROM lineitem JOIN b ON l_quantity > low AND l_quantity <= high) SELECT band, count(*) AS n, round(avg(-e), 4) AS bias, round(stddev_samp(e), 4) AS sd, round(avg(CASE WHEN -e > 0 THEN 1.0 ELSE 0 END), 7) AS share_over, round(median(-e), 4) AS median FROM e GROUP BY band")
def calibration_bands(t):
    b = t.constants([("a", 0, 10), ("b", 10, 30), ("c", 30, 50)], "band string, low int, high int")
    r = lambda c, n=4: F.round(c, n).alias(c)
    x = t.lineitem.withColumn("guess", 1500 * F.col("l_quantity"))
    return evaluate.calibration(x, b, "l_quantity", "guess", "l_extendedprice").select("band", "n", r("bias"), r("sd"), r("share_over", 7), r("median"))


_RANKS = "rk AS (SELECT p_brand, p_type, CASE WHEN stddev_pop(p_size) > 0 AND stddev_pop(p_retailprice) > 0 THEN corr(p_size, p_retailprice) END AS base_rho, CASE WHEN stddev_pop(p_size + p_partkey % 7 * 0.5) > 0 AND stddev_pop(p_retailprice) > 0 THEN corr(p_size + p_partkey % 7 * 0.5, p_retailprice) END AS rho, avg(CASE WHEN p_size > 25 THEN 1.0::DOUBLE ELSE 0 END) AS base_top, avg(CASE WHEN p_size + p_partkey % 7 * 0.5 > 26.5 THEN 1.0::DOUBLE ELSE 0 END) AS top FROM part GROUP BY ALL), er AS (SELECT p_brand, l_returnflag AS stat, avg(abs(l_extendedprice - 1500 * l_quantity)) AS base_mae, avg(abs(l_extendedprice - 1490 * l_quantity)) AS mae FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


@query(f"WITH {_RANKS}, r AS (SELECT p_brand, avg(rho - base_rho) AS mean_gain, min(rho - base_rho) AS worst_gain, sum(CASE WHEN top < base_top THEN 1 ELSE 0 END) AS regressions FROM rk GROUP BY 1), e AS (SELECT p_brand, avg(100 * (mae - base_mae) / base_mae) AS mean_mae, max(100 * (mae - base_mae) / base_mae) AS worst_mae FROM er GROUP BY 1), x AS (SELECT r.*, e.mean_mae, e.worst_mae, CASE WHEN mean_gain IS NULL THEN 'nothing comparable' WHEN mean_gain < 0.005 THEN 'mean gain' WHEN worst_gain < -0.005 THEN 'group loss' WHEN regressions > 1 THEN 'hit rates' WHEN mean_mae > 0.5 THEN 'mean error' WHEN worst_mae > 2 THEN 'stat error' ELSE 'passed' END AS clause FROM r LEFT JOIN e ON e.p_brand = r.p_brand) SELECT p_brand, round(mean_gain, 9) AS mean_gain, round(worst_mae, 7) AS worst_mae, CAST(regressions AS BIGINT) AS regressions, clause, CASE WHEN clause = 'passed' THEN 'merge' ELSE 'reject' END AS verdict FROM x")
def decision_rule(t):
    s = F.col("p_size") + F.col("p_partkey") % 7 * 0.5
    share = lambda c: F.avg(c.cast("double"))
    ranks = t.part.groupBy("p_brand", "p_type").agg(evaluate.correlation("p_size", "p_retailprice").alias("base_rho"), evaluate.correlation(s, "p_retailprice").alias("rho"), share(F.col("p_size") > 25).alias("base_top"), share(s > 26.5).alias("top"))
    off = lambda k: F.avg(F.abs(F.col("l_extendedprice") - k * F.col("l_quantity")))
    errors = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", F.col("l_returnflag").alias("stat")).agg(off(1500).alias("base_mae"), off(1490).alias("mae"))
    return evaluate.verdict(ranks, errors, ["p_brand"]).select("p_brand", F.round("mean_gain", 9).alias("mean_gain"), F.round("worst_mae", 7).alias("worst_mae"), "regressions", "clause", "verdict")


@query()
def stat_intervals(t):
    x = t.lineitem.groupBy("l_partkey").agg(F.avg("l_quantity").alias("m"), F.var_samp("l_quantity").alias("v"), F.avg((F.col("l_quantity") < 3).cast("double")).alias("bust"))
    return x.select("l_partkey", distributions.interval("m", "v", 0.1).alias("low"), distributions.interval("m", "v", 0.9).alias("high"), distributions.interval("m", "v", 0.9, "negative binomial").alias("high_count"), distributions.interval("m", "v", 0.1, bust="bust").alias("low_with_bust"), distributions.interval("m", "v", 0.9, bust="bust").alias("high_with_bust"))


# ---------------------------------------------------------------- history: nations meet in pairs every month, by their order values

_GAMES = "sc AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS period, c_nationkey AS team, round(sum(o_totalprice) / 1000, 0) AS score FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), gm AS (SELECT h.period, h.team AS home, a.team AS away, h.score AS hs, a.score AS aws FROM sc h JOIN sc a ON a.period = h.period AND a.team = (h.team + 1 + h.period % 11) % 25 AND h.team % 2 = 0), fx AS (SELECT period, home AS team, away AS opponent, hs AS score, aws AS against FROM gm UNION ALL SELECT period, away, home, aws, hs FROM gm), facts AS (SELECT *, CAST(sign(score - against) AS INTEGER) AS outcome FROM fx)"


def _facts(t):
    """Games from one scan: a period's scores are one small row, in which its pairs are looked up."""
    sc = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("period"), F.col("c_nationkey").alias("team")).agg(F.round(F.sum("o_totalprice") / 1000, 0).alias("score"))
    g = sc.groupBy("period").agg(F.map_from_entries(F.collect_list(F.struct("team", "score"))).alias("by"))  # at most 25 teams a period
    g = g.select("period", "by", F.explode("by").alias("home", "hs")).where("home % 2 = 0").withColumn("away", (F.col("home") + 1 + F.col("period") % 11) % 25)
    g = g.withColumn("as", F.try_element_at("by", F.col("away"))).where(F.col("as").isNotNull())
    return history.team_facts(g, "period", "home", "away", "hs", "as")


@query(f"WITH {_GAMES} SELECT period, team, opponent, score, against, outcome FROM facts")
def team_week_facts(t):
    return _facts(t)


@query(f"WITH {_GAMES} SELECT period, team, opponent, CAST(sum((outcome = 1)::INT) OVER w AS BIGINT) AS wins, CAST(sum((outcome = 0)::INT) OVER w AS BIGINT) AS ties, CAST(sum((outcome = -1)::INT) OVER w AS BIGINT) AS losses, round(CASE WHEN sum(abs(outcome)) OVER b > 0 THEN sum((outcome = 1)::INT) OVER b / sum(abs(outcome)) OVER b END, 9) AS entering_pct FROM facts WINDOW w AS (PARTITION BY team ORDER BY period, opponent ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY team ORDER BY period, opponent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def cumulative_record(t):
    return history.cumulative(_facts(t), "team", ["period", "opponent"]).select("period", "team", "opponent", "wins", "ties", "losses", F.round("entering_pct", 9).alias("entering_pct"))


@query(f"WITH {_GAMES}, x AS (SELECT team, count(*) FILTER (WHERE outcome = 1) AS now, count(*) FILTER (WHERE outcome = 1 AND period < (SELECT max(period) FROM facts)) AS before FROM facts GROUP BY team) SELECT team, now, before, CAST(row_number() OVER (ORDER BY now DESC, team) AS INTEGER) AS place, CAST(row_number() OVER (ORDER BY before DESC, team) - row_number() OVER (ORDER BY now DESC, team) AS INTEGER) AS change FROM x")
def leaderboard_change(t):
    return history.leaderboard(_facts(t), "team", "period")


@query(f"WITH {_GAMES} SELECT team, period, opponent, score, CAST(place AS INTEGER) AS place FROM (SELECT *, rank() OVER (PARTITION BY team ORDER BY score DESC) AS place FROM facts) WHERE place <= 3")
def records_topn(t):
    return history.records(_facts(t), ["team"], "score", 3).select("team", "period", "opponent", "score", "place")


@query(f"WITH {_GAMES}, x AS (SELECT period, team, score, max(score) OVER (PARTITION BY period) AS best FROM facts) SELECT period, best, string_agg(CAST(team AS VARCHAR), ', ' ORDER BY CAST(team AS VARCHAR)) AS leaders FROM (SELECT DISTINCT period, team, best FROM x WHERE score = best) GROUP BY period, best")
def leader_strings(t):
    return history.leaders(_facts(t).withColumn("name", F.col("team").cast("string")), ["period"], "score", "name")


@query(f"WITH {_GAMES} SELECT team, opponent, count(*) FILTER (WHERE outcome = 1) AS wins, count(*) FILTER (WHERE outcome = -1) AS losses, count(*) FILTER (WHERE outcome = 0) AS ties, round(avg(score), 6) AS mean_score FROM facts GROUP BY ALL")
def h2h(t):
    return history.head_to_head(_facts(t)).withColumn("mean_score", F.round("mean_score", 6))


@query(f"WITH {_GAMES}, x AS (SELECT f.team, f.outcome, (SELECT count(*) FROM facts g WHERE g.period = f.period AND g.score < f.score)::DOUBLE / nullif((SELECT count(*) FROM facts g WHERE g.period = f.period) - 1, 0) AS ap FROM facts f) SELECT team, CAST(count(*) FILTER (WHERE outcome = 1) AS DOUBLE) AS won, round(sum(ap), 6) AS deserved FROM x GROUP BY team")
def expected_standings(t):
    return history.expected_standings(_facts(t), "period").select("team", "won", F.round("deserved", 6).alias("deserved"))


_LINEUPS = "lu AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS period, c_nationkey AS team, round(sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice ELSE 0 END) / 1000, 0) AS projected, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS idle, count(*) AS places, round((sum(o_totalprice) + max(o_totalprice)) / 1000, 0) AS optimal FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), pl AS (SELECT facts.*, period % 12 + 1 AS week, projected, idle, places, optimal FROM facts JOIN lu USING (period, team))"
_ONCE = "op AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period, team ORDER BY opponent) AS rn, count(*) OVER (PARTITION BY period, team) AS k FROM pl) WHERE rn = 1)"


def _lineup_facts(t):
    return t.once("lineup_facts", lambda: _lineups_played(t))


def _lineups_played(t):
    """Facts with line-up measures, one game a team and period (a team drawn twice keeps its first)."""
    k = [(F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("period"), F.col("c_nationkey").alias("team")]
    p = F.col("o_totalprice")
    lu = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(*k).agg(F.round(F.sum(F.when(F.col("o_orderstatus") != "P", p).otherwise(0.0)) / 1000, 0).alias("projected"), F.count_if(F.col("o_orderstatus") == "P").alias("idle"), F.count("*").alias("places"), F.round((F.sum(p) + F.max(p)) / 1000, 0).alias("optimal"))
    x = _facts(t).join(lu, ["period", "team"]).withColumn("week", F.col("period") % 12 + 1)
    return x.withColumn("rn", F.row_number().over(Window.partitionBy("period", "team").orderBy("opponent"))).where("rn = 1").drop("rn")


_LUCK_SQL = f"""WITH {_GAMES}, {_LINEUPS}, {_ONCE},
a AS (SELECT *, rank() OVER (PARTITION BY period ORDER BY score DESC) AS rk, count(*) OVER (PARTITION BY period) AS n, avg(score) OVER (PARTITION BY team) AS mn, stddev_pop(score) OVER (PARTITION BY team) AS sd FROM op),
b AS (SELECT a.*, o.rk AS ork, o.mn AS omn, o.sd AS osd, o.score AS osc, o.idle AS oidle, o.places AS opl, o.optimal AS oopt, greatest(-0.2, least(0.2, (a.score - a.against) / least(a.score, a.against))) / 0.2 AS gap,
  ([{', '.join(map(repr, history.IDLE_SHIFTS))}])[a.week] AS shift FROM a JOIN a o ON o.period = a.period AND o.team = a.opponent),
c AS (SELECT *, CASE WHEN rk < ork THEN (rk - 1) / (n - 1) WHEN rk > ork THEN -(n - rk) / (n - 1) WHEN rk < n / 2 THEN -(n - rk - 1) / (n - 1) / 2 ELSE (rk - 1) / (n - 1) / 2 END AS t1,
  CASE WHEN sd > 0 THEN greatest(-1, least(1, (score - mn) / sd / 2)) ELSE 0 END AS t2, CASE WHEN osd > 0 THEN greatest(-1, least(1, (osc - omn) / osd / 2)) ELSE 0 END AS t3,
  CASE WHEN score <> 0 AND against <> 0 THEN sign(gap) - gap ELSE 0 END AS t4, CASE WHEN projected <> 0 THEN greatest(-0.25, least(0.25, (score - projected) / projected)) / 0.25 ELSE 0 END + 0.014 AS t5,
  -idle / places - shift AS t6, -oidle / opl - shift AS t7,
  CASE WHEN outcome = -1 AND optimal > osc THEN -1 WHEN outcome = -1 AND optimal = osc THEN -0.5 WHEN outcome = 0 AND optimal > osc THEN -0.5 ELSE 0 END + 0.1872 AS t8,
  CASE WHEN outcome = -1 AND oopt > score THEN -1 WHEN outcome = -1 AND oopt = score THEN -0.5 WHEN outcome = 0 AND oopt > score THEN -0.5 ELSE 0 END + 0.4970 AS t9,
  CASE outcome WHEN 1 THEN CASE WHEN optimal < oopt THEN 1 WHEN optimal = oopt THEN 0.5 ELSE 0 END WHEN -1 THEN CASE WHEN optimal > oopt THEN -1 WHEN optimal = oopt THEN -0.5 ELSE 0 END ELSE CASE WHEN optimal > oopt THEN -0.5 WHEN optimal < oopt THEN 0.5 ELSE 0 END END AS t10 FROM b)
"""


@query(_LUCK_SQL + "SELECT team, count(*) AS weeks, round(sum(t1), 6) AS scheduling, round(sum(0.3 * t1 + 0.2 / 3 * t2 + 0.1 / 3 * t3 + 0.05 * t4 + 0.1 * t5 + 0.5 / 3 * t6 + 0.25 / 3 * t7 + 0.2 / 3 * t8 + 0.1 / 3 * t9 + 0.1 * t10), 6) AS luck FROM c GROUP BY team")
def luck_index(t):
    x = history.luck(_lineup_facts(t), "period", "week")
    return x.groupBy("team").agg(F.count("*").alias("weeks"), F.round(F.sum("luck_scheduling"), 6).alias("scheduling"), F.round(F.sum("luck"), 6).alias("luck"))


@query(f"WITH {_GAMES}, y AS (SELECT *, period // 12 AS yr FROM facts), m AS (SELECT yr, median(score) AS m FROM y GROUP BY yr) SELECT period, team, opponent, round(score / (m.m / (SELECT m FROM m WHERE yr = 1996)), 6) AS adjusted FROM y JOIN m ON m.yr = y.yr")
def year_adjusted_score(t):
    x = _facts(t).withColumn("yr", F.floor(F.col("period") / 12))
    return history.year_adjusted(x, "yr", "score", 1996).select("period", "team", "opponent", F.round("adjusted", 6).alias("adjusted"))


def _power(when="true"):
    return f"won AS (SELECT team, opponent, count(*) AS n FROM facts WHERE outcome = 1 AND {when} GROUP BY ALL), tw AS (SELECT team, sum(n) AS w FROM won GROUP BY 1), dm AS (SELECT won.team, sum(n * (1 + coalesce(w, 0))) AS d FROM won LEFT JOIN tw ON tw.team = won.opponent GROUP BY 1), pw AS (SELECT f.team, round(0.8::DOUBLE * coalesce(max(d), 0) + 0.15::DOUBLE * trunc(avg(score)) + 0.05::DOUBLE * trunc(avg(score - against)), 2) AS power FROM (SELECT * FROM facts WHERE {when}) f LEFT JOIN dm ON dm.team = f.team GROUP BY f.team)"


@query(f"WITH {_GAMES}, {_power()} SELECT team, power FROM pw")
def power_ranking(t):
    return history.power_ranking(t.once("facts", lambda: _facts(t)))


_SCALED = "CASE WHEN max({0}) OVER () > min({0}) OVER () THEN b.l_{0} + ({0} - min({0}) OVER ()) / (max({0}) OVER () - min({0}) OVER ()) * (b.h_{0} - b.l_{0}) ELSE b.l_{0} END"


@query(f"WITH {_GAMES}, {_power('period < 24000')}, s AS (SELECT f.team AS opponent, count(*) AS n, sum(score) AS points, count(*) FILTER (WHERE outcome = 1) AS won, count(*) FILTER (WHERE outcome <> 0) AS decided, max(power) AS power FROM facts f JOIN pw ON pw.team = f.team WHERE period < 24000 GROUP BY 1), b AS (SELECT min(points / n) AS l_ppg, max(points / n) AS h_ppg, min(CASE WHEN decided > 0 THEN won / decided ELSE 0 END) AS l_pct, max(CASE WHEN decided > 0 THEN won / decided ELSE 0 END) AS h_pct, min(power) AS l_power, max(power) AS h_power FROM s), a AS (SELECT team, sum(points) / sum(n) AS ppg, CASE WHEN sum(decided) > 0 THEN sum(won) / sum(decided) ELSE 0 END AS pct, avg(power) AS power FROM facts JOIN s ON s.opponent = facts.opponent WHERE period >= 24000 GROUP BY team) SELECT team, round(ppg, 6) AS opp_points_for, round(pct, 6) AS opp_win_pct, round(power, 6) AS opp_power_rank, round(({_SCALED.format('ppg')} + {_SCALED.format('pct')} + {_SCALED.format('power')}) / 3, 6) AS difficulty FROM a CROSS JOIN b")
def schedule_difficulty(t):
    f = t.once("facts", lambda: _facts(t))
    past = f.where("period < 24000")
    x = history.remaining_difficulty(f.where("period >= 24000").select("team", "opponent"), past, history.power_ranking(past))
    return x.select("team", *(F.round(c, 6).alias(c) for c in ("opp_points_for", "opp_win_pct", "opp_power_rank", "difficulty")))


@query("WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice AS p, CASE o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'B' ELSE '' END AS s FROM orders), a AS (SELECT *, s <> '' AND row_number() OVER (PARTITION BY o_custkey, s ORDER BY p DESC, o_orderkey) = 1 AS used FROM o), b AS (SELECT *, used OR row_number() OVER (PARTITION BY o_custkey, used ORDER BY p DESC, o_orderkey) <= 2 AS in_line FROM a) SELECT o_custkey, round(sum(CASE WHEN in_line THEN p ELSE 0 END), 2) AS best, CAST(sum(CASE WHEN in_line THEN 1 ELSE 0 END) AS INTEGER) AS used FROM b GROUP BY o_custkey")
def best_lineup_greedy(t):
    x = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("A"), F.lit("FLEX"))).when(F.col("o_orderpriority") == "2-HIGH", F.array(F.lit("B"), F.lit("FLEX"))).otherwise(F.array(F.lit("FLEX"))).alias("eligible"))
    return history.best_lineup(x, ["o_custkey"], "o_orderkey", "o_totalprice", "eligible", {"A": 1, "B": 1, "FLEX": 2}).withColumn("best", F.round("best", 2))


# ---------------------------------------------------------------- simulation and odds

_U = "(((12345::BIGINT * 48271 + {a} * 69621 + 7) % 2147483647) * 16807 + 11) % 2147483647"


@query(f"WITH g AS (SELECT n_nationkey::BIGINT AS a, r.range AS b FROM nation CROSS JOIN range(200) r), x AS (SELECT a, b, {_U.format(a='a')} AS x1 FROM g), y AS (SELECT a, b, (((x1 * 48271 + b * 69621 + 7) % 2147483647) * 16807 + 11) % 2147483647 AS x2 FROM x) SELECT a, b, round((x2 + 1) / 2147483649.0::DOUBLE, 12) AS u FROM y")
def simulate_uniform(t):
    g = t.nation.select(F.col("n_nationkey").cast("long").alias("a")).crossJoin(t.spark.range(200).withColumnRenamed("id", "b"))
    return g.select("a", "b", F.round(e.hash_uniform("a", "b"), 12).alias("u"))


TRIALS = 1000


_DRAW = "greatest(0, {m} + {s} * sqrt(-2 * ln({u})) * cos(2 * 3.141592653589793 * {v}))"
_MIX = lambda x, k: f"((({x} * 48271 + {k} * 69621 + 7) % 2147483647) * 16807 + 11) % 2147483647"
_TRIALS = f"""{_GAMES}, lk AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY period DESC, opponent) AS back FROM facts WHERE score > 0), st AS (SELECT team, avg(CASE WHEN back <= 6 THEN score END) AS m, 2 * stddev_pop(score) AS s FROM lk GROUP BY team),
pr AS (SELECT h.team AS home, a.team AS away, h.m AS hm, h.s AS hs, a.m AS am, a.s AS ass, (h.team * 100 + a.team)::BIGINT AS game, r.range AS trial FROM st h JOIN st a ON h.team < a.team CROSS JOIN range({TRIALS}) r),
x1 AS (SELECT *, {_MIX('12345::BIGINT', 'trial')} AS z1 FROM pr), x2 AS (SELECT *, {_MIX('z1', 'game')} AS z2 FROM x1), x3 AS (SELECT *, {_MIX('z2', '0')} AS h0, {_MIX('z2', '1')} AS a0 FROM x2),
x4 AS (SELECT *, ({_MIX('h0', '1')} + 1) / 2147483649.0::DOUBLE AS hu, ({_MIX('h0', '2')} + 1) / 2147483649.0::DOUBLE AS hv, ({_MIX('a0', '1')} + 1) / 2147483649.0::DOUBLE AS au, ({_MIX('a0', '2')} + 1) / 2147483649.0::DOUBLE AS av FROM x3),
dr AS (SELECT trial, game, home, away, {_DRAW.format(m='hm', s='hs', u='hu', v='hv')} AS hsc, {_DRAW.format(m='am', s='ass', u='au', v='av')} AS asc_ FROM x4),
sd AS (SELECT trial, home AS team, hsc AS p, (hsc > asc_)::INT AS w FROM dr UNION ALL SELECT trial, away, asc_, (asc_ > hsc)::INT FROM dr), tt AS (SELECT trial, team, sum(w) AS wins, sum(p) AS points FROM sd GROUP BY ALL),
pc AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY wins DESC, points DESC, team) AS place FROM tt)"""


def _season(t):
    """Drawn games of every pair of teams, and the teams' strengths, computed once."""
    strength = written(simulate.strength(_facts(t), "period"))  # a row a team
    pairs = strength.select(F.col("team").alias("home")).crossJoin(strength.select(F.col("team").alias("away"))).where("home < away").withColumn("game", F.col("home") * 100 + F.col("away"))
    return simulate.trials(pairs, strength, TRIALS), strength


@query(f"WITH {_TRIALS} SELECT team, avg(CASE WHEN place <= 4 THEN 1.0::DOUBLE ELSE 0 END) AS playoff_odds, avg(wins) AS mean_wins FROM pc GROUP BY team")
def simulate_season(t):
    drawn, _ = _season(t)
    return simulate.odds(simulate.standings(drawn), 4)


@query(f"WITH {_TRIALS} SELECT team, {', '.join(f'100 * count(*) FILTER (WHERE place = {i}) / count(*) AS place_{i}' for i in range(1, 26))} FROM pc GROUP BY team")
def simulate_places(t):
    drawn, strength = _season(t)
    return simulate.place_distribution(simulate.standings(drawn), strength.count())


@query(f"WITH {_TRIALS}, g AS (SELECT trial, hsc > asc_ AS hw FROM dr WHERE game = 1), o AS (SELECT team, avg(CASE WHEN hw THEN CASE WHEN place <= 4 THEN 1.0::DOUBLE ELSE 0 END END) AS if_home, avg(CASE WHEN NOT hw THEN CASE WHEN place <= 4 THEN 1.0::DOUBLE ELSE 0 END END) AS if_away FROM pc JOIN g ON g.trial = pc.trial GROUP BY team) SELECT team, if_home, if_away, abs(if_home - if_away) AS swing FROM o")
def playoff_swing(t):
    drawn, _ = _season(t)
    drawn = written(drawn)
    return simulate.swing(simulate.standings(drawn), drawn, 1, 4)


@query(f"WITH {_TRIALS}, x AS (SELECT * FROM pc WHERE team = 3) SELECT CAST(wins AS BIGINT) AS wins, CAST(place AS INTEGER) AS place, count(*) AS trials, round(avg(points), 4) AS mean_points, count(*) / (SELECT count(*) FROM x) AS share FROM x GROUP BY wins, place")
def seeding_outcomes(t):
    drawn, _ = _season(t)
    return simulate.seeding_outcomes(simulate.standings(drawn), 3).withColumn("mean_points", F.round("mean_points", 4))


@query(f"WITH {_TRIALS}, known AS (SELECT (home * 100 + away)::BIGINT AS game, 1000000.0::DOUBLE AS h, 0.0::DOUBLE AS a FROM (SELECT DISTINCT home, away FROM pr) WHERE home = 0), dk AS (SELECT dr.trial, dr.game, home, away, coalesce(known.h, hsc) AS hsc, coalesce(known.a, asc_) AS asc_ FROM dr LEFT JOIN known ON known.game = dr.game), sk AS (SELECT trial, home AS team, hsc AS p, (hsc > asc_)::INT AS w FROM dk UNION ALL SELECT trial, away, asc_, (asc_ > hsc)::INT FROM dk), tk AS (SELECT trial, team, sum(w) AS wins, sum(p) AS points FROM sk GROUP BY ALL), pk AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY wins DESC, points DESC, team) AS place FROM tk) SELECT team, avg(CASE WHEN place <= 4 THEN 1.0::DOUBLE ELSE 0 END) AS playoff_odds, avg(wins) AS mean_wins FROM pk GROUP BY team")
def input_outcomes(t):
    drawn, strength = _season(t)
    known = strength.where("team > 0").select(F.col("team").cast("long").alias("game"), F.lit(1e6).alias("home_score"), F.lit(0.0).alias("away_score"))
    return simulate.odds(simulate.standings(simulate.with_results(drawn, known)), 4)


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN o < 0 THEN -o / (-o + 100) WHEN o > 0 THEN 100 / (o + 100) END, 9) AS p FROM (SELECT *, (l_quantity - 25) * 10 AS o FROM lineitem)")
def american_odds(t):
    return t.lineitem.withColumn("o", (F.col("l_quantity") - 25) * 10).select("l_orderkey", "l_linenumber", "l_partkey", F.round(e.american_to_probability("o"), 9).alias("p"))


_MK = "mk AS (SELECT l_partkey, l_returnflag AS side, avg(l_extendedprice) AS odds FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY ALL), pr AS (SELECT *, 1 / odds AS ip FROM mk), nv AS (SELECT *, ip / sum(ip) OVER (PARTITION BY l_partkey) AS p FROM pr)"


def _market(t):
    m = t.lineitem.where("l_returnflag IN ('A', 'N')").groupBy("l_partkey", F.col("l_returnflag").alias("side")).agg((1 / F.avg("l_extendedprice")).alias("ip"))
    return m.withColumn("p", F.col("ip") / F.sum("ip").over(Window.partitionBy("l_partkey")))


@query(f"WITH {_MK}, w AS (SELECT l_partkey, max(CASE WHEN side = 'A' THEN p END) AS o, max(CASE WHEN side = 'N' THEN p END) AS u FROM nv GROUP BY 1) SELECT l_partkey, round(o, 9) AS p_over, round(p_size + (u - o) * p_size * 0.25, 6) AS adjusted FROM w JOIN part ON p_partkey = l_partkey")
def devig_props(t):
    w = _market(t).groupBy("l_partkey").pivot("side", ["A", "N"]).agg(F.max("p"))
    return w.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_partkey", F.round("A", 9).alias("p_over"), F.round(F.col("p_size") + (F.col("N") - F.col("A")) * F.col("p_size") * 0.25, 6).alias("adjusted"))


@query("WITH h AS (SELECT l_suppkey, k, count(*) FILTER (WHERE l_quantity >= k * 10)::DOUBLE / count(*) AS p FROM lineitem CROSS JOIN (VALUES (1), (2), (3), (4), (5)) v(k) GROUP BY ALL), d AS (SELECT l_suppkey, k, p - coalesce(lead(p) OVER (PARTITION BY l_suppkey ORDER BY k), 0) AS q FROM h) SELECT l_suppkey, round(sum(k * q), 9) AS expected FROM d GROUP BY l_suppkey")
def ladder_expectation(t):
    h = t.lineitem.groupBy("l_suppkey").agg(*(F.avg((F.col("l_quantity") >= k * 10).cast("double")).alias(str(k)) for k in range(1, 6))).unpivot(["l_suppkey"], [str(k) for k in range(1, 6)], "k", "p").withColumn("k", F.col("k").cast("int"))
    d = h.withColumn("q", F.col("p") - F.coalesce(F.lead("p").over(Window.partitionBy("l_suppkey").orderBy("k")), F.lit(0.0)))
    return d.groupBy("l_suppkey").agg(F.round(F.sum(F.col("k") * F.col("q")), 9).alias("expected"))


@query("WITH b AS (SELECT l_partkey, l_suppkey, max(l_discount) - min(l_discount) AS spread, count(*) AS bets FROM lineitem GROUP BY ALL HAVING count(*) > 1) SELECT l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY spread, bets DESC, l_suppkey) AS rn FROM b) WHERE rn = 1")
def primary_line(t):
    b = t.lineitem.groupBy("l_partkey", "l_suppkey").agg((F.max("l_discount") - F.min("l_discount")).alias("spread"), F.count("*").alias("bets")).where("bets > 1")
    w = Window.partitionBy("l_partkey").orderBy("spread", F.col("bets").desc(), "l_suppkey")
    return b.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("l_partkey", "l_suppkey")
