"""Queries of the blend, scoring and board families.  A part is the entity, its brand the group; six slices of lineitem are six opinions of its measures, and a thin slice is an imputed one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import expr as e
from ..operators import blend, board, joins, present, windows
from .registry import Tables, query

SOURCES = ("AF", "AO", "NF", "NO", "RF", "RO")
WEIGHTS = {"AF": 0.25, "AO": 0.25, "NF": 0.0, "NO": 0.25, "RF": 0.15, "RO": 0.1}
LEAST = 6  # lines that a slice needs to have an opinion
RULES = {"qty": 2.0, "ext": 0.001}
KEYS = ["p_partkey"]

OPINIONS = """
s AS (SELECT l_partkey, l_returnflag || l_linestatus AS source, avg(l_quantity) AS qty, avg(l_extendedprice) AS ext FROM lineitem GROUP BY l_partkey, l_returnflag || l_linestatus HAVING count(*) >= 6),
grid AS (SELECT p_partkey, source FROM part CROSS JOIN (VALUES ('AF'), ('AO'), ('NF'), ('NO'), ('RF'), ('RO')) v(source)),
w AS (SELECT g.p_partkey, g.source, s.qty, s.ext FROM grid g LEFT JOIN s ON s.l_partkey = g.p_partkey AND s.source = g.source),
m AS (SELECT p_partkey, avg(qty) AS mq, avg(ext) AS me FROM w GROUP BY p_partkey),
o AS (SELECT w.p_partkey, 'qty' AS stat, w.source, coalesce(qty, mq) AS value, qty IS NULL AS is_imputed FROM w JOIN m ON w.p_partkey = m.p_partkey
 UNION ALL SELECT w.p_partkey, 'ext', w.source, coalesce(ext, me), ext IS NULL FROM w JOIN m ON w.p_partkey = m.p_partkey),
wt AS (SELECT * FROM (VALUES ('AF', 0.25::DOUBLE), ('AO', 0.25::DOUBLE), ('NF', 0.0::DOUBLE), ('NO', 0.25::DOUBLE), ('RF', 0.15::DOUBLE), ('RO', 0.1::DOUBLE)) t(source, weight)),
b AS (SELECT p_partkey, stat, CASE WHEN sum(weight * CASE WHEN is_imputed OR value IS NULL THEN 0 ELSE 1 END) > 0
  THEN sum(coalesce(value, 0) * weight * CASE WHEN is_imputed OR value IS NULL THEN 0 ELSE 1 END) / sum(weight * CASE WHEN is_imputed OR value IS NULL THEN 0 ELSE 1 END)
  ELSE sum(coalesce(value, 0) * weight) END AS value FROM o JOIN wt ON o.source = wt.source GROUP BY p_partkey, stat),
r AS (SELECT * FROM (VALUES ('qty', 2.0::DOUBLE), ('ext', 0.001::DOUBLE)) t(stat, points)),
sc AS (SELECT p_partkey, CASE WHEN count(value) > 0 THEN sum(coalesce(value, 0) * points) END AS points FROM b JOIN r ON b.stat = r.stat GROUP BY p_partkey)
"""


def opinions(t: Tables) -> DataFrame:
    """p_partkey, stat, source, value, is_imputed: long, one shuffle for both measures."""
    s = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey"), F.concat("l_returnflag", "l_linestatus").alias("source")).agg(F.avg("l_quantity").alias("qty"), F.avg("l_extendedprice").alias("ext"), F.count("*").alias("n")).where(F.col("n") >= LEAST).drop("n")
    grid = t.part.select("p_partkey", F.explode(F.array(*map(F.lit, SOURCES))).alias("source"))
    w = grid.join(s, ["p_partkey", "source"], "left")
    m = Window.partitionBy("p_partkey")
    both = [F.struct(F.lit(k).alias("stat"), F.coalesce(F.col(k), F.avg(k).over(m)).alias("value"), F.col(k).isNull().alias("is_imputed")) for k in ("qty", "ext")]
    return w.select("p_partkey", "source", F.array(*both).alias("x")).select("p_partkey", "source", F.inline("x"))


def weights(t: Tables) -> DataFrame:
    return t.constants(list(WEIGHTS.items()), "source string, weight double")


def rules(t: Tables) -> DataFrame:
    return t.constants(list(RULES.items()), "stat string, points double")


def scored(t: Tables) -> DataFrame:
    return blend.score(blend.weighted(opinions(t), weights(t), KEYS), rules(t), KEYS)


@query(f"WITH {OPINIONS}, x AS (SELECT p.p_partkey, p.p_brand, sc.points, rank() OVER (PARTITION BY p_brand ORDER BY points DESC) AS pos_rank FROM sc JOIN part p ON p.p_partkey = sc.p_partkey), y AS (SELECT p_brand, coalesce(max(CASE WHEN pos_rank >= 10 THEN points END), min(points)) AS base FROM x GROUP BY p_brand) SELECT x.p_partkey, x.p_brand, round(x.points, 4) AS points, CAST(x.pos_rank AS INTEGER) AS pos_rank, round(x.points - y.base, 4) AS vor FROM x JOIN y ON x.p_brand = y.p_brand WHERE x.pos_rank <= 20")
def flagship_board(t: Tables) -> DataFrame:
    brands = t.part.select("p_brand").distinct().withColumn("rank", F.lit(10))
    x = scored(t).join(t.part.select("p_partkey", "p_brand"), "p_partkey")
    v = board.value_over_replacement(x, "p_brand", "points", brands)
    return v.where("pos_rank <= 20").select("p_partkey", "p_brand", F.round("points", 4).alias("points"), "pos_rank", F.round("vor", 4).alias("vor"))


@query(f"WITH {OPINIONS} SELECT p_partkey, stat, round(value, 6) AS value FROM b")
def blend_weighted(t):
    return blend.weighted(opinions(t), weights(t), KEYS).withColumn("value", F.round("value", 6))


VARIANTS = {"shipped": WEIGHTS, "without": WEIGHTS | {"NO": 0.0}}
_VARIANTS = ", ".join(f"('{v}', '{s}', {w}::DOUBLE)" for v, ws in VARIANTS.items() for s, w in ws.items())


@query(f"WITH {OPINIONS}, wv AS (SELECT * FROM (VALUES {_VARIANTS}) t(variant, source, weight)), x AS (SELECT p_partkey, variant, stat, weight, coalesce(value, 0) AS v, CASE WHEN is_imputed OR value IS NULL THEN 0 ELSE 1 END AS real FROM o JOIN wv ON o.source = wv.source), y AS (SELECT p_partkey, variant, stat, CASE WHEN sum(weight * real) > 0 THEN sum(v * weight * real) / sum(weight * real) ELSE sum(v * weight) END AS value FROM x GROUP BY ALL), z AS (SELECT y.p_partkey, variant, max(CASE WHEN stat = 'qty' THEN value END) AS qty, max(CASE WHEN stat = 'ext' THEN value END) / 1000 AS ext FROM y GROUP BY ALL), g AS (SELECT z.*, p_type, sum(qty) OVER w AS a, sum(ext) OVER w AS b FROM z JOIN part USING (p_partkey) WINDOW w AS (PARTITION BY variant, p_brand)), cf AS (SELECT p_partkey, p_type, variant, round(CASE WHEN a > 0 AND b > 0 THEN 2 * qty * (a + b) / 2 / a + ext * (a + b) / 2 / b ELSE 2 * qty + ext END, 5) AS points FROM g) SELECT p_partkey, variant, points, CAST(rank() OVER (PARTITION BY variant, p_type ORDER BY points DESC) AS INTEGER) AS pos_rank FROM cf")
def counterfactual_blends(t):
    """The board under the weights in use and under those without one source: blended, reconciled per brand, priced, ranked."""
    w = t.constants([(v, s, x) for v, ws in VARIANTS.items() for s, x in ws.items()], "variant string, source string, weight double")
    x = blend.variants(opinions(t), w, KEYS, list(VARIANTS))
    x = x.groupBy("p_partkey", "variant").agg(F.max(F.when(F.col("stat") == "qty", F.col("value"))).alias("qty"), (F.max(F.when(F.col("stat") == "ext", F.col("value"))) / 1000).alias("ext"))
    x = blend.reconcile(x.join(t.part.select("p_partkey", "p_type", "p_brand"), "p_partkey"), "qty", "ext", ["variant", "p_brand"])
    x = x.withColumn("points", F.round(2 * F.col("qty") + F.col("ext"), 5))
    return x.select("p_partkey", "variant", "points", F.rank().over(Window.partitionBy("variant", "p_type").orderBy(F.col("points").desc())).alias("pos_rank"))


@query(f"WITH {OPINIONS} SELECT p_partkey, stat, round(sum(coalesce(value, 0) * weight), 6) AS value FROM o JOIN wt ON o.source = wt.source GROUP BY p_partkey, stat HAVING sum(weight * CASE WHEN is_imputed THEN 0 ELSE 1 END) = 0")
def blend_face_fallback(t):
    o = opinions(t)
    none = o.join(weights(t), "source").groupBy(*KEYS, "stat").agg(F.sum(F.col("weight") * (~F.col("is_imputed")).cast("int")).alias("d")).where("d = 0").drop("d")
    return blend.weighted(o, weights(t), KEYS).join(none, [*KEYS, "stat"], "left_semi").withColumn("value", F.round("value", 6))


@query(f"WITH {OPINIONS} SELECT source, stat, count(*) AS n, CAST(sum(CASE WHEN is_imputed OR value IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS real, round(100.0::DOUBLE * sum(CASE WHEN is_imputed OR value IS NULL THEN 0 ELSE 1 END) / count(*), 1) AS real_pct FROM o GROUP BY source, stat")
def coverage_report(t):
    return blend.coverage(opinions(t))


@query(f"WITH {OPINIONS} SELECT p_partkey, round(points, 4) AS points FROM sc")
def score_rules(t):
    return scored(t).withColumn("points", F.round("points", 4))


@query("WITH a AS (SELECT l_partkey, avg(CASE WHEN l_returnflag = 'A' AND l_quantity > 30 THEN l_quantity END) AS a, avg(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS n FROM lineitem GROUP BY l_partkey) SELECT l_partkey, round(coalesce(a, n), 6) AS a, a IS NULL AS a_is_imputed FROM a")
def impute_with_flags(t):
    x = t.lineitem.groupBy("l_partkey").agg(F.avg(F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 30), F.col("l_quantity"))).alias("a"), F.avg(F.when(F.col("l_returnflag") == "N", F.col("l_quantity"))).alias("n"))
    return blend.impute(x, "a", "n", "a_is_imputed").select("l_partkey", F.round("a", 6).alias("a"), "a_is_imputed")


@query("WITH a AS (SELECT l_partkey, avg(CASE WHEN l_returnflag = 'A' THEN l_tax END) AS a, avg(CASE WHEN l_returnflag = 'N' THEN l_tax END) AS n FROM lineitem GROUP BY l_partkey) SELECT l_partkey, round(CASE WHEN a IS NULL THEN n WHEN n IS NULL THEN a ELSE (a + n) / 2 END, 8) AS mean, CAST((a IS NOT NULL)::INT + (n IS NOT NULL)::INT AS INTEGER) AS sources FROM a")
def row_mean_pair(t):
    v = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_tax")))
    x = t.lineitem.groupBy("l_partkey").agg(v("A").alias("a"), v("N").alias("n"))
    return x.select("l_partkey", F.round(F.when(e.row_count(["a", "n"]) > 0, e.row_sum(["a", "n"]) / F.nullif(e.row_count(["a", "n"]), F.lit(0))), 8).alias("mean"), e.row_count(["a", "n"]).alias("sources"))


@query(f"WITH {OPINIONS}, x AS (SELECT p_partkey, stat, min(value) AS lo, max(value) AS hi, count(*) AS n FROM o WHERE value IS NOT NULL AND value <> 0 AND NOT is_imputed GROUP BY p_partkey, stat) SELECT p_partkey, stat, round(CASE WHEN n >= 2 THEN lo END, 6) AS floor, round(CASE WHEN n >= 2 THEN hi END, 6) AS ceiling, n AS n_sources FROM x")
def source_spread(t):
    return blend.spread(opinions(t), [*KEYS, "stat"]).select(*KEYS, "stat", F.round("floor", 6).alias("floor"), F.round("ceiling", 6).alias("ceiling"), "n_sources")


SLOT_RULES = [("BASE", "qty", 2.0), ("BASE", "price", 0.001), ("Brand#1", "qty", 0.0), ("Brand#2", "price", 0.01)]


@query("""WITH r AS (SELECT * FROM (VALUES ('BASE', 'qty', 2.0::DOUBLE), ('BASE', 'price', 0.001::DOUBLE), ('Brand#1', 'qty', 0.0::DOUBLE), ('Brand#2', 'price', 0.01::DOUBLE)) v(slot, stat, points)),
x AS (SELECT l_partkey, p_brand, sum(l_quantity) AS qty, sum(l_extendedprice) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey, p_brand),
y AS (SELECT l_partkey, p_brand, 'qty' AS stat, qty AS value FROM x UNION ALL SELECT l_partkey, p_brand, 'price', price FROM x)
SELECT l_partkey, p_brand, round(sum(value * CASE WHEN o.slot IS NOT NULL THEN o.points ELSE b.points END), 3) AS points FROM y LEFT JOIN r o ON o.slot = y.p_brand AND o.stat = y.stat LEFT JOIN r b ON b.slot = 'BASE' AND b.stat = y.stat GROUP BY l_partkey, p_brand""")
def score_by_slot(t):
    x = t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price")).join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    y = x.unpivot(["l_partkey", "p_brand"], ["qty", "price"], "stat", "value")
    r = t.constants(SLOT_RULES, "slot string, stat string, points double")
    return blend.score_by_slot(y, r, ["l_partkey", "p_brand"], "p_brand", "BASE").withColumn("points", F.round("points", 3))


_REG = "SELECT o_orderpriority AS slot, o_orderstatus AS stat, round(avg(o_totalprice), 2) AS points FROM orders WHERE {} GROUP BY ALL"


def _registry(t, where):
    return t.orders.where(where).groupBy(F.col("o_orderpriority").alias("slot"), F.col("o_orderstatus").alias("stat")).agg(F.round(F.avg("o_totalprice"), 2).alias("points"))


OLD, NEW = "year(o_orderdate) = 1997 AND o_orderpriority <> '5-LOW'", "year(o_orderdate) = 1998 AND o_orderstatus <> 'P'"


@query(f"WITH o AS ({_REG.format(OLD)}), n AS ({_REG.format(NEW)}) SELECT coalesce(o.slot, n.slot) AS slot, coalesce(o.stat, n.stat) AS stat, o.points AS old_value, n.points AS new_value, CASE WHEN o.slot IS NULL THEN 'added' WHEN n.slot IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.slot = n.slot AND o.stat = n.stat WHERE o.points IS DISTINCT FROM n.points")
def registry_diff(t):
    return joins.full_diff(_registry(t, OLD), _registry(t, NEW), ["slot", "stat"], "points")


@query(f"WITH o AS ({_REG.format(OLD)}), n AS ({_REG.format(NEW)}) SELECT slot, stat, points FROM n UNION ALL SELECT slot, stat, points FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.slot = o.slot AND n.stat = o.stat)")
def registry_upsert(t):
    return joins.upsert(_registry(t, OLD), _registry(t, NEW), ["slot", "stat"])


@query("WITH o AS (SELECT DISTINCT c_nationkey AS slot, c_mktsegment AS stat, '2024-01-01' AS recorded_at FROM customer WHERE c_acctbal > 8000), n AS (SELECT DISTINCT c_nationkey AS slot, c_mktsegment AS stat FROM customer) SELECT n.slot, n.stat, coalesce(o.recorded_at, '2024-02-01') AS recorded_at FROM n LEFT JOIN o ON n.slot = o.slot AND n.stat = o.stat")
def registry_recorded_at(t):
    x = t.customer.select(F.col("c_nationkey").alias("slot"), F.col("c_mktsegment").alias("stat"), "c_acctbal")
    old = x.where("c_acctbal > 8000").select("slot", "stat").distinct().withColumn("recorded_at", F.lit("2024-01-01"))
    return joins.keep_recorded_at(old, x.select("slot", "stat").distinct().withColumn("recorded_at", F.lit("2024-02-01")), ["slot", "stat"], "recorded_at")


@query("WITH c AS (SELECT c_nationkey AS nation, c_custkey % 10 AS k, sum(c_acctbal) AS lhs FROM customer GROUP BY ALL), s AS (SELECT s_nationkey AS nation, s_suppkey % 10 AS k, sum(s_acctbal) AS rhs FROM supplier GROUP BY ALL), j AS (SELECT coalesce(c.nation, s.nation) AS nation, coalesce(c.k, s.k) AS k, coalesce(lhs, 0) AS lhs, coalesce(rhs, 0) AS rhs FROM c FULL JOIN s ON c.nation = s.nation AND c.k = s.k), w AS (SELECT *, sum(lhs) OVER (PARTITION BY nation) AS a, sum(rhs) OVER (PARTITION BY nation) AS b FROM j) SELECT nation, k, round(CASE WHEN a > 0 AND b > 0 THEN lhs * ((a + b) / 2) / a ELSE lhs END, 4) AS lhs, round(CASE WHEN a > 0 AND b > 0 THEN rhs * ((a + b) / 2) / b ELSE rhs END, 4) AS rhs FROM w")
def reconcile_totals(t):
    c = t.customer.groupBy(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 10).alias("k")).agg(F.sum("c_acctbal").alias("lhs"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 10).alias("k")).agg(F.sum("s_acctbal").alias("rhs"))
    j = c.join(s, ["nation", "k"], "full").fillna(0.0, ["lhs", "rhs"])
    return blend.reconcile(j, "lhs", "rhs", "nation").select("nation", "k", F.round("lhs", 4).alias("lhs"), F.round("rhs", 4).alias("rhs"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part), f AS (SELECT p_type, 0.75::DOUBLE * median(p_retailprice) AS least FROM r WHERE rn <= 24 GROUP BY p_type) SELECT p.p_partkey, round(CASE WHEN p.p_size >= 25 AND p.p_retailprice < f.least THEN NULL ELSE p.p_retailprice END, 4) AS kept FROM part p JOIN f ON p.p_type = f.p_type")
def role_withdrawal_topk_median(t):
    top = windows.top_per(t.part, "p_type", 24, F.col("p_retailprice").desc(), F.col("p_partkey"))
    f = top.groupBy("p_type").agg((F.median("p_retailprice") * 0.75).alias("least"))
    gone = (F.col("p_size") >= 25) & (F.col("p_retailprice") < F.col("least"))
    return t.part.join(f, "p_type").select("p_partkey", F.round(F.when(~gone, F.col("p_retailprice")), 4).alias("kept"))


@query("WITH a AS (SELECT l_partkey, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS x, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS y FROM lineitem GROUP BY l_partkey) SELECT l_partkey, CASE WHEN x > 1.75 * y AND x > 40 THEN x / 2 ELSE x END AS x FROM a")
def doubled_correction(t):
    v = lambda s: F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity")))
    return t.lineitem.groupBy("l_partkey").agg(v("F").alias("x"), v("O").alias("y")).select("l_partkey", blend.halve_doubled("x", "y").alias("x"))


@query("SELECT p_partkey, round(p_size / (p_retailprice / 1000 + 0.5), 6) AS assisted, round(p_retailprice / 1000 * (p_size / (p_retailprice / 1000 + 0.5)), 6) AS solo FROM part")
def split_total(t):
    x = t.part.withColumn("ratio", F.col("p_retailprice") / 1000)
    a, s = blend.split_total("p_size", "ratio")
    return x.select("p_partkey", F.round(a, 6).alias("assisted"), F.round(s, 6).alias("solo"))


# ---------------------------------------------------------------- board

_FLEX = "fl AS (SELECT p_type, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS n FROM part), rest AS (SELECT * FROM fl WHERE n > 12 AND n <= 42), won AS (SELECT p_type, count(*) AS k FROM (SELECT * FROM rest ORDER BY p_retailprice DESC, p_partkey LIMIT 30) z GROUP BY p_type), ranks AS (SELECT d.p_type, CAST(12 + coalesce(won.k, 0) AS BIGINT) AS rank FROM (SELECT DISTINCT p_type FROM part) d LEFT JOIN won ON d.p_type = won.p_type)"


def _flex(t):
    slots = t.part.select("p_type").distinct().withColumn("dedicated", F.lit(12))
    return board.flex_ranks(t.part, "p_type", "p_retailprice", "p_partkey", slots, 30)


@query(f"WITH {_FLEX} SELECT p_type, rank FROM ranks")
def replacement_flex(t):
    return _flex(t)


@query(f"WITH {_FLEX}, x AS (SELECT p.*, rank() OVER (PARTITION BY p.p_type ORDER BY p_retailprice DESC) AS pos_rank, ranks.rank AS need FROM part p JOIN ranks ON p.p_type = ranks.p_type), y AS (SELECT p_type, coalesce(max(CASE WHEN pos_rank >= need THEN p_retailprice END), min(p_retailprice)) AS base FROM x GROUP BY p_type) SELECT x.p_partkey, x.p_type, CAST(x.pos_rank AS INTEGER) AS pos_rank, round(x.p_retailprice - y.base, 4) AS vor FROM x JOIN y ON x.p_type = y.p_type")
def vor(t):
    return board.value_over_replacement(t.part, "p_type", "p_retailprice", _flex(t)).select("p_partkey", "p_type", "pos_rank", F.round("vor", 4).alias("vor"))


@query("WITH n AS (SELECT p_type, CAST(round_even(p_size / 4.0, 0) AS BIGINT) AS level, count(*) AS n FROM part GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY p_type) AS al, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, level) AS rn FROM n) SELECT p_type, CAST(level - 1 AS BIGINT) AS plateau, n FROM w WHERE rn = 1 AND n >= 2 AND n >= 0.05 * al")
def adp_plateau(t):
    return board.plateau(t.part.withColumn("adp", F.col("p_size") / 4), "adp", "p_type")


@query("WITH s AS (SELECT DISTINCT user_id, date_part('day', ts) AS d FROM events), g AS (SELECT u.user_id, c.d FROM (SELECT DISTINCT user_id FROM s) u CROSS JOIN (SELECT DISTINCT d FROM s) c), x AS (SELECT g.user_id, min(g.d) AS missing, count(*) AS n FROM g LEFT JOIN s ON s.user_id = g.user_id AND s.d = g.d WHERE s.user_id IS NULL GROUP BY g.user_id) SELECT user_id, CAST(missing AS INTEGER) AS missing FROM x WHERE n = 1")
def missing_week(t):
    return board.missing_period(t.events.select("user_id", F.dayofmonth("ts").alias("d")), "user_id", "d")


@query("WITH x AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice - 1200 DESC, p_partkey) <= 50 AS inn FROM part), y AS (SELECT *, CASE WHEN inn THEN greatest(p_retailprice - 1200, 0) ELSE 0 END AS pos, sum(CASE WHEN inn THEN 1 ELSE 0 END) OVER (PARTITION BY p_type) AS n, sum(CASE WHEN inn THEN greatest(p_retailprice - 1200, 0) ELSE 0 END) OVER (PARTITION BY p_type) AS total FROM x) SELECT p_partkey, round(CASE WHEN inn THEN 1 + CASE WHEN total > 0 THEN pos / total ELSE 0 END * (200 - n) END, 4) AS cash FROM y")
def cash_value_pool(t):
    x = t.part.withColumn("value", F.col("p_retailprice") - 1200)
    return board.cash_value(x, "p_type", "value", "p_partkey", 200.0, 50).select("p_partkey", F.round("cash", 4).alias("cash"))


@query("WITH d AS (SELECT p_partkey, p_type, rank() OVER (ORDER BY p_retailprice DESC) - rank() OVER (ORDER BY p_size DESC) AS delta FROM part), g AS (SELECT p_type, avg(delta) AS m, stddev_samp(delta) AS sd, count(*) AS n FROM d GROUP BY p_type) SELECT d.p_partkey, round(CASE WHEN n >= 8 AND sd >= 0.5 THEN (delta - m) / sd END, 6) AS z, coalesce(abs(CASE WHEN n >= 8 AND sd >= 0.5 THEN (delta - m) / sd END) >= 1.5, false) AS outlier FROM d JOIN g ON d.p_type = g.p_type")
def agreement_z(t):
    x = present.global_ranks(t.part, "p_partkey", {"_a": (F.col("p_retailprice"), True), "_b": (F.col("p_size"), True)})
    x = board.agreement(x.withColumn("delta", (F.col("_a") - F.col("_b")).cast("double")), "delta", "p_type")
    return x.select("p_partkey", F.round("z", 6).alias("z"), F.coalesce(F.abs("z") >= 1.5, F.lit(False)).alias("outlier"))


@query("WITH b AS (SELECT p_type, p_partkey, p_size // 10 AS tier FROM part) SELECT p_type, tier, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY p_type ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS runway FROM b GROUP BY p_type, tier")
def tier_runway(t):
    n = t.part.groupBy("p_type", F.floor(F.col("p_size") / 10).cast("int").alias("tier")).agg(F.count("*").alias("n"))
    return n.withColumn("runway", windows.running_sum("n", "p_type", ["tier"]))


@query("WITH x AS (SELECT p_type, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS depth FROM part) SELECT p_type, CAST(depth AS INTEGER) AS depth, p_retailprice AS value FROM x WHERE depth <= 30")
def scarcity_curve(t):
    return t.part.select("p_type", windows.rank("ordinal", "p_retailprice", "p_type", tie="p_partkey").alias("depth"), F.col("p_retailprice").alias("value")).where("depth <= 30")


@query("SELECT s_suppkey, CAST(CASE WHEN s_acctbal > 0 THEN greatest(1, round_even(s_acctbal / 100, 0) + 5) END AS BIGINT) AS keeper_price FROM supplier")
def keeper_price(t):
    return t.supplier.select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.greatest(F.lit(1).cast("long"), F.bround(F.col("s_acctbal") / 100, 0).cast("long") + 5)).alias("keeper_price"))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_size >= 5 AND p_type IN ('ECONOMY', 'PROMO') AND p_brand NOT IN ('Brand#1', 'Brand#2') AND contains(lower(p_name), 'red') AND (p_size // 10 <= 3 OR p_size IS NULL)")
def filter_board(t):
    b = t.part.where("p_size >= 5").withColumns({"held": F.col("p_brand").isin("Brand#1", "Brand#2"), "tier": F.floor(F.col("p_size") / 10)})
    return board.filtered(b, keep={"p_type": ["ECONOMY", "PROMO"]}, without=["held"], most={"tier": 3}, search=("p_name", " Red ")).select("p_partkey", "p_name", "p_type")


@query("WITH x AS (SELECT p_type, quantile_cont(abs(p_retailprice - 1400), 0.9) AS scale FROM part GROUP BY p_type) SELECT p_partkey, CAST(least(3, greatest(-3, round_even(3 * (p_retailprice - 1400) / scale, 0))) AS INTEGER) AS step FROM part JOIN x ON part.p_type = x.p_type")
def shade_steps(t):
    s = t.part.groupBy("p_type").agg(F.percentile(F.abs(F.col("p_retailprice") - 1400), 0.9).alias("scale"))
    return t.part.join(s, "p_type").select("p_partkey", F.least(F.lit(3), F.greatest(F.lit(-3), F.bround(3 * (F.col("p_retailprice") - 1400) / F.col("scale"), 0).cast("int"))).alias("step"))


@query()
def assign_tiers_kmeans(t):
    return board.assign_tiers(t.part, "p_type", "p_retailprice", ["p_partkey"])


@query("WITH n AS (SELECT p_type, p_brand, count(*) AS have FROM part WHERE p_size > 40 GROUP BY ALL), need AS (SELECT * FROM (VALUES ('ECONOMY', 16), ('PROMO', 18), ('LARGE', 14)) v(p_type, want)), g AS (SELECT b.p_brand, need.p_type, need.want FROM need CROSS JOIN (SELECT DISTINCT p_brand FROM part) b) SELECT g.p_brand, g.p_type, CAST(greatest(0, g.want - coalesce(n.have, 0)) AS BIGINT) AS open FROM g LEFT JOIN n ON n.p_type = g.p_type AND n.p_brand = g.p_brand")
def roster_needs(t):
    have = t.part.where("p_size > 40").groupBy("p_type", "p_brand").agg(F.count("*").alias("have"))
    need = t.constants([("ECONOMY", 16), ("PROMO", 18), ("LARGE", 14)], "p_type string, want int")
    g = t.part.select("p_brand").distinct().crossJoin(F.broadcast(need))
    return g.join(have, ["p_type", "p_brand"], "left").select("p_brand", "p_type", F.greatest(F.lit(0).cast("long"), F.col("want") - F.coalesce("have", F.lit(0).cast("long"))).alias("open"))
