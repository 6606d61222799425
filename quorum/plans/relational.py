"""Queries of the joins, windows, aggregates, reshaping, text and feature families."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import expr as e
from ..operators import features, joins, shape, windows
from .registry import query



@query("WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 10000 DAY AS at FROM orders), x AS (SELECT o.o_orderkey, e.event_id, e.value, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY e.ts DESC, e.event_id DESC) AS rn FROM o LEFT JOIN events e ON e.user_id = o.o_custkey AND e.ts <= o.at) SELECT o_orderkey, event_id, value FROM x WHERE rn = 1")
def asof_backward(t):
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("user_id"), F.expr("o_orderdate + INTERVAL 10000 DAYS").alias("at"))
    ev = t.events.select("user_id", "ts", "event_id", "value")
    return joins.asof_backward(o, ev, "user_id", "at", "ts", ["event_id", "value"], "event_id").select("o_orderkey", "event_id", "value")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS t3_value FROM events")
def trailing_mean_excl(t):
    return t.events.select("event_id", F.round(windows.trailing_mean("value", "user_id", ["ts", "event_id"], 3), 6).alias("t3_value"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS r3_value FROM events")
def rolling_incl(t):
    return t.events.select("event_id", F.round(windows.trailing_mean("value", "user_id", ["ts", "event_id"], 3, current=True), 6).alias("r3_value"))


@query("SELECT event_id, round(CASE WHEN count(value) OVER w >= 5 THEN avg(value) OVER w END, 6) AS full5 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def rolling_full(t):
    return t.events.select("event_id", F.round(windows.trailing_mean("value", "user_id", ["ts", "event_id"], 5, current=True, least=5), 6).alias("full5"))


@query("SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_type ORDER BY p_size DESC) AS INTEGER) AS dense, CAST(rank() OVER (PARTITION BY p_type ORDER BY p_size DESC) AS INTEGER) AS min_rank, CAST(rank() OVER (PARTITION BY p_type ORDER BY p_size) AS INTEGER) AS min_asc, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS INTEGER) AS ordinal, rank() OVER (PARTITION BY p_type ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2.0::DOUBLE AS average FROM part")
def ranks_five_flavours(t):
    r = windows.rank
    return t.part.select("p_partkey", r("dense", "p_size", "p_type").alias("dense"), r("min", "p_size", "p_type").alias("min_rank"), r("min", "p_size", "p_type", desc=False).alias("min_asc"), r("ordinal", "p_size", "p_type", tie="p_partkey").alias("ordinal"), r("average", "p_size", "p_type").cast("double").alias("average"))


@query("SELECT p.p_partkey, CAST(s.r AS INTEGER) AS place FROM part p LEFT JOIN (SELECT p_partkey, rank() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC) AS r FROM part WHERE p_size > 25) s ON s.p_partkey = p.p_partkey")
def rank_subset_only(t):
    return t.part.select("p_partkey", windows.subset_rank("p_retailprice", F.col("p_size") > 25, "p_type").alias("place"))


@query("WITH x AS (SELECT event_id, user_id, ts, CASE WHEN value > 10 THEN 1 WHEN value < 10 THEN -1 ELSE 0 END AS o FROM events), y AS (SELECT *, CASE WHEN lag(o) OVER w IS NOT DISTINCT FROM o THEN 0 ELSE 1 END AS nw FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), z AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM y) SELECT event_id, CAST(o * row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS INTEGER) AS streak FROM z")
def streaks(t):
    x = t.events.withColumn("o", F.when(F.col("value") > 10, 1).when(F.col("value") < 10, -1).otherwise(0))
    return windows.streaks(x, "o", "user_id", ["ts", "event_id"]).select("event_id", "streak")


@query("WITH n AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS x FROM customer GROUP BY ALL) SELECT c_nationkey, c_mktsegment, round(CASE WHEN count(x) OVER w > 1 THEN (sum(x) OVER w - x) / (count(x) OVER w - 1) END, 5) AS room FROM n WINDOW w AS (PARTITION BY c_mktsegment)")
def leave_one_out_room(t):
    n = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("x"))
    return n.select("c_nationkey", "c_mktsegment", F.round(windows.leave_one_out("x", "c_mktsegment"), 5).alias("room"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_per_key(t):
    return windows.latest_per(t.orders, "o_custkey", F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).select("o_custkey", "o_orderkey", "o_totalprice")


@query("WITH a AS (SELECT user_id, event_type, max(ts) AS ts FROM events WHERE date_part('day', ts) <= 15 GROUP BY ALL), b AS (SELECT user_id, event_type, max(ts) AS ts FROM events WHERE date_part('day', ts) > 20 GROUP BY ALL) SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(b.ts, a.ts) AS ts FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type")
def upsert_latest(t):
    f = lambda c: t.events.where(c).groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"))
    return joins.upsert(f("day(ts) <= 15"), f("day(ts) > 20"), ["user_id", "event_type"]).select("user_id", "event_type", "ts")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM c) z WHERE rn = 1")
def modal_with_tiebreak(t):
    return windows.modal(t.events, "user_id", "event_type")


@query("WITH d AS (SELECT s_nationkey AS k, count(*) AS n, min(s_suppkey) AS s FROM supplier GROUP BY 1 HAVING count(*) = 1) SELECT c_custkey, d.s AS suppkey FROM customer LEFT JOIN d ON d.k = c_nationkey")
def ambiguous_key_guard(t):
    d = t.supplier.select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_suppkey").alias("suppkey"))
    return joins.left_unique(t.customer, d, "c_nationkey").select("c_custkey", "suppkey")


@query("WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 200 END AS id, 'Supplier#' || lpad(CAST(c_custkey % 150 AS VARCHAR), 9, '0') AS name FROM customer), i AS (SELECT s_suppkey AS id, min(s_acctbal) AS v FROM supplier GROUP BY 1), n AS (SELECT s_name AS name, min(s_acctbal) AS v FROM supplier GROUP BY 1) SELECT c_custkey, coalesce(i.v, n.v) AS s_acctbal FROM c LEFT JOIN i ON i.id = c.id LEFT JOIN n ON n.name = c.name")
def id_then_name_join(t):
    c = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 200).alias("id"), F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 150).cast("string"), 9, "0")).alias("name"))
    d = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_acctbal")
    return joins.id_then_name(c, d, "id", "name", "s_acctbal").select("c_custkey", "s_acctbal")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_and_anti(t):
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return t.customer.join(o.where("o_totalprice > 400000"), "c_custkey", "left_semi").join(o.where("o_orderstatus = 'P'"), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT coalesce(c_nationkey, s_nationkey) AS nation, n_c, n_s, CASE WHEN n_c IS NULL THEN 'right_only' WHEN n_s IS NULL THEN 'left_only' ELSE 'both' END AS side FROM (SELECT c_nationkey, count(*) AS n_c FROM customer WHERE c_acctbal > 9500 GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS n_s FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON c_nationkey = s_nationkey")
def full_outer_indicator(t):
    c = t.customer.where("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n_c"))
    s = t.supplier.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n_s"))
    return c.join(s, "nation", "full").withColumn("side", F.when(F.col("n_c").isNull(), "right_only").when(F.col("n_s").isNull(), "left_only").otherwise("both"))


@query("SELECT r_name, p_type, CAST(coalesce(n, 0) AS BIGINT) AS n FROM region CROSS JOIN (SELECT DISTINCT p_type FROM part) LEFT JOIN (SELECT n_regionkey AS rk, p_type AS pt, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) ON rk = r_regionkey AND pt = p_type")
def densify_grid(t):
    n = t.lineitem.join(t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("r_regionkey")), F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("r_regionkey", "p_type").agg(F.count("*").alias("n"))
    return shape.densify(n, t.region, t.part.select("p_type").distinct(), ["r_regionkey", "p_type"], {"n": 0}).select("r_name", "p_type", "n")


@query("SELECT s_suppkey AS k, s_acctbal AS bal, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def ragged_union(t):
    return shape.union_ragged(t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal")), t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment")))


@query("SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS r FROM lineitem GROUP BY l_suppkey")
def pivot_sum(t):
    return shape.widen(t.lineitem, ["l_suppkey"], "l_returnflag", "l_quantity", ["A", "N", "R"], F.sum).toDF("l_suppkey", "a", "n", "r")


@query("SELECT p_partkey, 'size' AS stat, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def unpivot_measures(t):
    return shape.melt(t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")), ["p_partkey"], ["size", "price"])


@query("SELECT 'i' AS op, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 3000) UNION ALL SELECT 'e', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 3000)")
def intersect_except(t):
    c, s = t.customer.select(F.col("c_nationkey").alias("k"), "c_acctbal"), t.supplier.where("s_acctbal < 3000").select(F.col("s_nationkey").alias("k"))
    return c.where("c_acctbal > 9000").select("k").intersect(s).select(F.lit("i").alias("op"), "k").union(c.select("k").subtract(s).select(F.lit("e"), "k"))


@query("SELECT p_partkey, CAST(unnest(string_split(p_name, ' ')) AS VARCHAR) AS word FROM part")
def delimited_explode(t):
    return shape.explode_delimited(t.part.select("p_partkey", "p_name"), "p_name", " ", "word").select("p_partkey", "word")


@query("SELECT event_type, count(*) AS n, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k FROM events GROUP BY event_type")
def json_flatten(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(e.json_number("props", "$.k")), 6).alias("mean_k"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages")
def html_title_extract(t):
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


@query("SELECT conv_id, turn, role, coalesce(lag(role) OVER w, 'start') AS before, CAST(strlen(text) AS INTEGER) AS bytes, CAST(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)")
def turn_windows(t):
    x = t.conversations.withColumn("bytes", F.octet_length("text"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    return x.select("conv_id", "turn", "role", F.coalesce(F.lag("role").over(w), F.lit("start")).alias("before"), "bytes", windows.running_sum("bytes", "conv_id", ["turn", "role"]).alias("so_far"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(upper(p_name), '[^A-Z0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS key FROM part")
def name_key(t):
    return t.part.select("p_partkey", e.name_key("p_name").alias("key"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(upper(replace(strip_accents(text), 'ß', 'ss')), '[.''`‘’]', '', 'g'), '[^A-Z0-9]+', ' ', 'g')), ' (JR|SR|II|III|IV|V)$', ''), ' +', ' ', 'g')) AS key FROM documents")
def name_key_folded(t):
    return t.documents.select("doc_id", e.name_key("text").alias("key"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^(red|blue|green) ') THEN 'colour' WHEN regexp_matches(p_name, 'ring$') THEN 'ring' ELSE 'other' END AS code FROM part")
def text_stat_code(t):
    n = F.col("p_name")
    return t.part.select("p_partkey", F.when(n.rlike("^(red|blue|green) "), "colour").when(n.rlike("ring$"), "ring").otherwise("other").alias("code"))


@query("SELECT o_orderkey % 1000 AS n, CAST(o_orderkey % 1000 AS VARCHAR) || CASE WHEN (o_orderkey % 1000) % 100 BETWEEN 11 AND 13 THEN 'th' WHEN o_orderkey % 10 = 1 THEN 'st' WHEN o_orderkey % 10 = 2 THEN 'nd' WHEN o_orderkey % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal, strftime(o_orderdate, '%b %d') AS day FROM orders")
def format_labels(t):
    x = t.orders.select((F.col("o_orderkey") % 1000).alias("n"), "o_orderdate")
    return x.select("n", e.ordinal("n").alias("ordinal"), F.date_format("o_orderdate", "MMM dd").alias("day"))


@query("SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 12 THEN '1-12' WHEN p_size > 12 AND p_size <= 24 THEN '13-24' WHEN p_size > 24 AND p_size <= 50 THEN '25-50' END AS band, CASE p_type WHEN 'ECONOMY' THEN 'E' WHEN 'PROMO' THEN 'P' ELSE p_type END AS code FROM part")
def bins_and_value_map(t):
    return t.part.select("p_partkey", e.bins("p_size", [0, 12, 24, 50], ["1-12", "13-24", "25-50"]).alias("band"), e.value_map("p_type", {"ECONOMY": "E", "PROMO": "P"}).alias("code"))


@query("SELECT user_id, round(quantile_cont(value, 0.9), 6) AS p90, round(median(value), 6) AS med, round(stddev_samp(value), 6) AS sd, round(stddev_pop(value), 6) AS sdp, count(DISTINCT event_type) AS kinds, bool_or(value > 50) AS any_high, max_by(event_type, (value, event_id)) AS top_type, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 6) AS error_rate FROM events GROUP BY user_id")
def aggregates(t):
    return t.events.groupBy("user_id").agg(F.round(F.percentile("value", 0.9), 6).alias("p90"), F.round(F.median("value"), 6).alias("med"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.stddev_pop("value"), 6).alias("sdp"), F.count_distinct("event_type").alias("kinds"), F.bool_or(F.col("value") > 50).alias("any_high"), F.max_by("event_type", F.struct("value", "event_id")).alias("top_type"), F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("error_rate"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS top3 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3 GROUP BY o_custkey")
def top_k_sum(t):
    return windows.top_per(t.orders, "o_custkey", 3, F.col("o_totalprice").desc(), F.col("o_orderkey")).groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("top3"))


@query("(SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) UNION ALL (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10)")
def both_tails(t):
    o = t.orders.select("o_orderkey", "o_totalprice")
    return o.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10).union(o.orderBy("o_totalprice", "o_orderkey").limit(10))


@query("SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def grouping_sets_extra(t):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_window_extra(t):
    return t.events.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


@query("WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS nw FROM events), y AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, s")
def session_window_extra(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.col("ts") <= F.lag("ts").over(w) + F.expr("INTERVAL 12 HOURS"), 0).otherwise(1)
    x = t.events.withColumn("nw", new).withColumn("s", F.sum("nw").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("user_id", "s").agg(F.min("ts").alias("start"), F.count("*").alias("n")).drop("s")


# ---------------------------------------------------------------- season features

_YEARS = "y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS season, sum(o_totalprice) AS total, count(*) AS games, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS last_priority FROM orders GROUP BY ALL)"


def _years(t):
    return t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("season")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("games"), F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("last_priority"))


@query(f"WITH {_YEARS} SELECT o_custkey, season, round(total, 2) AS total, games, last_priority FROM y")
def season_totals(t):
    return _years(t).withColumn("total", F.round("total", 2))


@query(f"WITH {_YEARS} SELECT a.o_custkey, a.season, b.games AS p1_games, c.games AS p2_games, round(b.total, 2) AS p1_total FROM y a LEFT JOIN y b ON b.o_custkey = a.o_custkey AND b.season = a.season - 1 LEFT JOIN y c ON c.o_custkey = a.o_custkey AND c.season = a.season - 2")
def lag1_lag2_features(t):
    x = features.lags(_years(t), "o_custkey", "season", ["games", "total"])
    return x.select("o_custkey", "season", "p1_games", "p2_games", F.round("p1_total", 2).alias("p1_total"))


_RATE = "x AS (SELECT l_suppkey, l_returnflag, sum(l_discount * l_extendedprice) AS num, sum(l_extendedprice) AS den FROM lineitem GROUP BY ALL), base AS (SELECT l_returnflag, sum(num) / sum(den) AS base_rate FROM x GROUP BY 1)"


@query(f"WITH {_RATE} SELECT l_returnflag, round(base_rate, 9) AS base_rate FROM base")
def pooled_rate(t):
    x = t.lineitem.withColumn("num", F.col("l_discount") * F.col("l_extendedprice"))
    return features.pooled_rate(x, ["l_returnflag"], "num", "l_extendedprice").withColumn("base_rate", F.round("base_rate", 9))


@query(f"WITH {_RATE} SELECT l_suppkey, x.l_returnflag, round((den * (num / den) + 1000000 * base_rate) / (den + 1000000), 9) AS rate FROM x JOIN base ON x.l_returnflag = base.l_returnflag")
def shrinkage(t):
    x = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.sum(F.col("l_discount") * F.col("l_extendedprice")).alias("num"), F.sum("l_extendedprice").alias("den"))
    base = features.pooled_rate(x, ["l_returnflag"], "num", "den")
    return features.shrunk_rates(x, base, ["l_returnflag"], "num", "den", 1_000_000.0).select("l_suppkey", "l_returnflag", F.round("rate", 9).alias("rate"))


@query("WITH x AS (SELECT c_nationkey, sum(c_acctbal) AS total, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal ELSE 0 END) AS b, sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal ELSE 0 END) AS m FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1) SELECT c_nationkey, round(CASE WHEN total > 0 THEN b / total END, 7) AS share_building, round(CASE WHEN total > 0 THEN m / total END, 7) AS share_machinery FROM x")
def team_profile_pivot(t):
    p = features.profile_shares(t.customer.where("c_mktsegment IN ('BUILDING', 'MACHINERY')"), ["c_nationkey"], "c_mktsegment", "c_acctbal", ["BUILDING", "MACHINERY"])
    return p.select("c_nationkey", F.round("share_BUILDING", 7).alias("share_building"), F.round("share_MACHINERY", 7).alias("share_machinery"))


@query("WITH e AS (SELECT user_id, user_id % 10 AS team, CAST(1 AS INTEGER) AS season, date_part('day', ts) AS d FROM events), p AS (SELECT season, user_id, max(team) AS team, count(DISTINCT d) AS played FROM e GROUP BY ALL), s AS (SELECT season, team, count(DISTINCT d) AS slate FROM e GROUP BY ALL) SELECT p.user_id, p.played, s.slate, round(least(1, p.played / s.slate), 9) AS availability FROM p JOIN s ON s.season = p.season AND s.team = p.team")
def availability(t):
    x = t.events.select("user_id", (F.col("user_id") % 10).alias("team"), F.lit(1).alias("season"), F.dayofmonth("ts").alias("d"))
    return features.availability(x, x, "user_id", "team", "season", "d").select("user_id", "played", "slate", F.round("availability", 9).alias("availability"))


@query("SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS season FROM orders o WHERE month(o_orderdate) = (SELECT min(month(o_orderdate)) FROM orders i WHERE year(i.o_orderdate) = year(o.o_orderdate))")
def first_snapshot(t):
    x = t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"))
    return features.first_snapshot(x, "season", "week").drop("week")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, o_orderkey DESC) AS rn FROM orders WHERE year(o_orderdate) <= 1997) WHERE rn = 1")
def latest_contract(t):
    x = t.orders.select("*", F.year("o_orderdate").alias("signed"), F.lit(1997).alias("target"))
    return features.latest_contract(x, "o_custkey", "signed", "target", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT s_suppkey, round(coalesce(CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END, median(CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END) OVER (PARTITION BY s_nationkey), median(CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END) OVER ()), 6) AS filled FROM supplier")
def median_fill(t):
    x = t.supplier.withColumn("v", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")))
    return windows.fill_median(x, "v", "s_nationkey", "filled").select("s_suppkey", F.round("filled", 6).alias("filled"))
