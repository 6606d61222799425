"""Queries of whole pipelines: a week's line-ups and a season's projections from five declared sources, six stats, one call each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemble
from ..operators.assemble import Sources
from .registry import query

r = lambda c, n=4: F.round(c, n).alias(c)

STATS = ["pass_yds", "rec_yds", "pass_td", "rec_td", "pass_cmp", "rec"]
IDENTITIES = [("pass_yds", "rec_yds"), ("pass_td", "rec_td"), ("pass_cmp", "rec")]
WEIGHTS = {"espn": 0.4, "fp": 0.3, "pinny": {s: 0.15 for s in STATS}, "bol": {"pass_yds": 0.1, "rec_yds": 0.2}, "usg": 0.25}
DOUBLED = ("pass_yds", "rec_yds")
WEEKLY = Sources("espn", "fp", ("pinny", "bol"), (), {k: v for k, v in WEIGHTS.items() if k != "usg"}, DOUBLED)
SEASONAL = Sources("espn", "fp", ("pinny", "bol"), ("usg",), WEIGHTS)
RULES = [("BASE", "pass_yds", 0.5), ("BASE", "rec_yds", 1.0), ("BASE", "pass_td", 4.0), ("BASE", "rec_td", 6.0), ("BASE", "rec", 0.25), ("DST", "rec_td", 0.0), ("DST", "pass_cmp", 2.0)]

_LINES = f"""en AS (SELECT p_partkey, p_type, CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS team, CASE p_type WHEN 'SMALL' THEN 'DST' ELSE 'BASE' END AS slot FROM part),
es AS (SELECT l_partkey, ({STATS!r})[l_linenumber] AS stat, CASE WHEN l_returnflag = 'A' THEN 'espn' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN CASE WHEN l_suppkey % 3 = 0 THEN 'pinny' ELSE 'fp' END WHEN l_suppkey % 2 = 0 THEN 'bol' ELSE 'usg' END AS source, l_quantity AS value FROM lineitem WHERE l_linenumber <= 6),
pv AS (SELECT en.*, st.stat, {', '.join(f"max(CASE WHEN source = '{s}' THEN value END) AS {s}" for s in SEASONAL.all)} FROM en CROSS JOIN (SELECT unnest({STATS!r}) AS stat) st LEFT JOIN es ON es.l_partkey = en.p_partkey AND es.stat = st.stat GROUP BY ALL),
pr(slot, stat, own) AS (VALUES {', '.join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in RULES)})"""


def _weighed(src: Sources) -> str:
    def w(s):
        v = src.weights.get(s, 0.0)
        return f"{v}::DOUBLE" if not isinstance(v, dict) else f"CASE stat {' '.join(f'''WHEN '{k}' THEN {x}::DOUBLE''' for k, x in v.items())} ELSE 0 END"

    real = {s: f"(CASE WHEN {s}_i THEN 0 ELSE {w(s)} END)" for s in src.all}
    total = " + ".join(real.values())
    first = f"CASE WHEN stat IN {src.doubled} AND espn > 1.75 * fp AND espn > 40 THEN espn / 2 ELSE espn END" if src.doubled else "espn"
    return f"""d1 AS (SELECT * REPLACE ({first} AS espn), {', '.join(f'{s} IS NULL AS {s}_i' for s in src.all)} FROM pv), d2 AS (SELECT * REPLACE (coalesce(fp, espn) AS fp), CASE WHEN espn IS NULL OR fp IS NULL THEN coalesce(espn, fp) ELSE (espn + fp) / 2 END AS mean FROM d1), d3 AS (SELECT * REPLACE (coalesce(pinny, mean) AS pinny, coalesce(bol, mean) AS bol) FROM d2),
d4 AS (SELECT *, CASE WHEN {total} > 0 THEN ({' + '.join(f'coalesce({s}, 0) * {x}' for s, x in real.items())}) / ({total}) ELSE {' + '.join(f'coalesce({s}, 0) * {w(s)}' for s in src.all)} END AS "true" FROM d3)"""


def _points(of: list[str], table: str, more: str = "") -> str:
    sums = ", ".join(f'CASE WHEN count(CASE WHEN p IS NOT NULL THEN "{s}" END) > 0 THEN sum(coalesce("{s}", 0) * p) END AS {s}_points' for s in of)
    return f"pc AS (SELECT x.*, coalesce(a.own, b.own) AS p FROM {table} x LEFT JOIN pr a ON a.slot = x.slot AND a.stat = x.stat LEFT JOIN pr b ON b.slot = 'BASE' AND b.stat = x.stat), pp AS (SELECT p_partkey, {sums}{more} FROM pc GROUP BY p_partkey)"


def _entities(t):
    return t.part.select("p_partkey", "p_type", "p_size", "p_retailprice", F.when(F.col("p_partkey") % 13 != 0, F.col("p_brand")).alias("team"), F.when(F.col("p_type") == "SMALL", "DST").otherwise("BASE").alias("slot"))


def _estimates(t):
    flag, supp = F.col("l_returnflag"), F.col("l_suppkey")
    source = F.when(flag == "A", "espn").when((flag == "N") & (F.col("l_linestatus") == "O"), F.when(supp % 3 == 0, "pinny").otherwise("fp")).otherwise(F.when(supp % 2 == 0, "bol").otherwise("usg"))
    return t.lineitem.where("l_linenumber <= 6").select(F.col("l_partkey").alias("p_partkey"), F.element_at(F.array(*map(F.lit, STATS)), F.col("l_linenumber").cast("int")).alias("stat"), source.alias("source"), F.col("l_quantity").alias("value"))


def _rules(t):
    return t.constants(RULES, "slot string, stat string, points double")


_WEEKLY_OF = [*WEEKLY.all, "mean", "true"]


@query(f"WITH {_LINES}, {_weighed(WEEKLY)}, {_points(_WEEKLY_OF, 'd4')}, sh AS (SELECT p_partkey, p_type, p_retailprice / 10 - espn_points AS shift, p_size AS actual, {', '.join(f'{s}_points + (p_retailprice / 10 - espn_points) AS {s}_points' for s in _WEEKLY_OF)} FROM part JOIN pp USING (p_partkey)) SELECT p_partkey, {', '.join(f'''round({s}_points, 4) AS {s}_points, CAST(CASE WHEN {s}_points IS NOT NULL THEN dense_rank() OVER (PARTITION BY p_type ORDER BY round({s}_points, 6) DESC NULLS LAST) END AS INTEGER) AS {s}_rank''' for s in _WEEKLY_OF)}, CAST(dense_rank() OVER (PARTITION BY p_type ORDER BY actual DESC) AS INTEGER) AS rank FROM sh")
def lineup_pipeline(t):
    x = assemble.clean_lineups(_entities(t).withColumn("official", F.col("p_retailprice") / 10), _estimates(t), ["p_partkey"], STATS, WEEKLY, _rules(t), "slot", "BASE", "official", "p_size", ["p_type"], 6)
    return x.select("p_partkey", *(r(f"{s}_points") for s in _WEEKLY_OF), *(f"{s}_rank" for s in _WEEKLY_OF), "rank")


_SEASON_OF = [*SEASONAL.all, "true"]
_RATIO = " ".join(f"WHEN stat = '{s}' AND s{i} > 0 AND s{i ^ 1} > 0 THEN (s{i} + s{i ^ 1}) / 2 / s{i}" for i, s in enumerate(STATS))
_REAL = "list_filter([" + ", ".join(f"CASE WHEN r_{s} THEN {s}_points END" for s in SEASONAL.all) + "], lambda v: v IS NOT NULL)"


_SUMS = ", ".join(f"""sum(CASE WHEN stat = '{s}' THEN "true" END) AS s{i}""" for i, s in enumerate(STATS))


@query(f"""WITH {_LINES}, {_weighed(SEASONAL)}, ts AS (SELECT team, {_SUMS} FROM d4 WHERE team IS NOT NULL GROUP BY team),
d5 AS (SELECT d4.* REPLACE (d4."true" * CASE {_RATIO} ELSE 1 END AS "true") FROM d4 LEFT JOIN ts USING (team)), {_points(_SEASON_OF, 'd5', ', ' + ', '.join(f'coalesce(bool_or(NOT {s}_i AND {s} <> 0), false) AS r_{s}' for s in SEASONAL.all))},
rl AS (SELECT pp.*, p_type, {_REAL} AS op FROM pp JOIN part USING (p_partkey)), rk AS (SELECT *, CASE WHEN true_points IS NOT NULL THEN rank() OVER (PARTITION BY p_type ORDER BY round(true_points, 6) DESC NULLS LAST) END AS pr, CASE WHEN usg_points IS NOT NULL THEN rank() OVER (PARTITION BY p_type ORDER BY round(usg_points, 6) DESC NULLS LAST) END AS mr FROM rl)
SELECT p_partkey, {', '.join(f'round({s}_points, 4) AS {s}_points' for s in _SEASON_OF)}, round(CASE WHEN len(op) >= 2 THEN list_min(op) END, 4) AS floor, round(CASE WHEN len(op) >= 2 THEN list_max(op) END, 4) AS ceiling, CAST(len(op) AS INTEGER) AS n_sources, CAST(pr AS INTEGER) AS pos_rank, CAST(mr AS INTEGER) AS model_rank, CAST(pr - mr AS INTEGER) AS model_delta FROM rk""")
def season_pipeline(t):
    x = assemble.season_projections(_entities(t), _estimates(t), ["p_partkey"], STATS, SEASONAL, IDENTITIES, _rules(t), "slot", "BASE", "team", "p_type", "usg", 6)
    return x.select("p_partkey", *(r(f"{s}_points") for s in _SEASON_OF), r("floor"), r("ceiling"), "n_sources", "pos_rank", "model_rank", "model_delta")
