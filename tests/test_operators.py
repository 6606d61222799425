import numpy as np
import pytest
from pyspark.sql import functions as F

from quorum.functions import distributions, expr as e
from quorum.operators import blend, board, features, history, joins, model, windows
from quorum.sources import store


def vals(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_blend_drops_imputed_weight(spark):
    w = spark.createDataFrame([("a", 0.25), ("b", 0.25), ("c", 0.5)], "source string, weight double")
    x = spark.createDataFrame([(1, "y", "a", 950.0, False), (1, "y", "b", 10.0, True), (1, "y", "c", 20.0, None), (2, "y", "a", 8.0, True), (2, "y", "b", 4.0, True)], "k int, stat string, source string, value double, is_imputed boolean")
    assert vals(blend.weighted(x, w, ["k"]), "k", "value") == [(1, 950.0), (2, 3.0)]
    flagless = x.drop("is_imputed").where("k = 2")
    assert vals(blend.weighted(flagless, w, ["k"]), "value") == [(6.0,)]


def test_scores(spark):
    r = spark.createDataFrame([("y", 2.0), ("z", None)], "stat string, points double")
    x = spark.createDataFrame([(1, "y", 3.0), (2, "y", None), (3, "z", 1.0)], "k int, stat string, value double")
    assert {a.k: a.points for a in blend.score(x, r, ["k"]).collect()} == {1: 6.0, 2: None, 3: None}


def test_impute_never_unflags(spark):
    x = spark.createDataFrame([(None, 5.0, None), (1.0, 5.0, True), (2.0, 5.0, False)], "t double, s double, f boolean")
    assert vals(blend.impute(x, "t", "s", "f"), "t", "f") == [(1.0, True), (2.0, False), (5.0, True)]


def test_reconcile_meets_in_the_middle(spark):
    x = blend.reconcile(spark.createDataFrame([(1, 10.0, 5.0), (1, 30.0, 15.0)], "g int, l double, r double"), "l", "r", "g")
    s = x.agg(F.sum("l"), F.sum("r")).first()
    assert s[0] == s[1] == 30.0


def test_trailing_and_asof_agree(spark):
    x = spark.createDataFrame([(1, w, float(20 * w - 10)) for w in range(1, 6)], "p int, w int, v double")
    t = x.withColumn("t3", windows.trailing_mean("v", "p", ["w"], 3))
    assert [r.t3 for r in t.orderBy("w").collect()] == [None, 10.0, 20.0, 30.0, 50.0]
    state = x.select("p", (F.col("w") + 1).alias("since"), windows.trailing_mean("v", "p", ["w"], 3, current=True).alias("t3"))
    a = joins.asof_backward(x, state, "p", "w", "since", ["t3"], "since")
    assert [r.t3 for r in a.orderBy("w").collect()] == [None, 10.0, 20.0, 30.0, 50.0]


def test_joins(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert sorted(r.v or "" for r in joins.left_unique(left, d, "k").collect()) == ["", "", "c"]
    old, new = spark.createDataFrame([(1, 1.0), (None, 2.0)], "k int, v double"), spark.createDataFrame([(2, 1.0), (None, 3.0)], "k int, v double")
    assert {r.change for r in joins.full_diff(old, new, ["k"], "v").collect()} == {"added", "removed", "changed"}
    assert joins.upsert(old, new, ["k"]).count() == 4


def test_tiers_and_vor(spark):
    t = board.assign_tiers(spark.createDataFrame(list(enumerate([100.0, 99.0, 98.0, 3.0, 1.0, 2.0])), "id int, p double").withColumn("g", F.lit("q")), "g", "p", ["id"])
    assert vals(t, "id", "tier") == list(enumerate([1, 1, 1, 2, 2, 2]))
    x = spark.createDataFrame([("q", i, 30.0 - i) for i in range(5)], "g string, id int, p double")
    v = board.value_over_replacement(x, "g", "p", spark.createDataFrame([("q", 3)], "g string, rank int"))
    assert vals(v, "vor") == [(-2.0,), (-1.0,), (0.0,), (1.0,), (2.0,)]


def test_flex(spark):
    x = spark.createDataFrame([("a", i, 100.0 - i) for i in range(6)] + [("b", 10 + i, 50.0 - i) for i in range(6)], "g string, id int, p double")
    r = board.flex_ranks(x, "g", "p", "id", spark.createDataFrame([("a", 1), ("b", 1)], "g string, dedicated int"), 3)
    assert vals(r, "g", "rank") == [("a", 4), ("b", 1)]


def test_models(spark):
    x = spark.createDataFrame([("g", float(i), float(i % 3), 2.0 * i - (i % 3) + 1) for i in range(30)], "g string, a double, b double, y double")
    c = {r.term: round(r.value, 6) for r in model.fit(x, "g", ["a", "b"], "y").collect()}
    assert c == {"intercept": 1.0, "a": 2.0, "b": -1.0}
    assert abs(distributions.gamma_cdf(distributions.gamma_quantile(0.3, 4, 2) / 0.5, 8)[0] - 0.3) < 1e-9
    assert model.nnls(np.array([[1.0, 0], [0, 1]]), np.array([-1.0, 2])).tolist() == [0.0, 2.0]


def test_leak_guard(spark):
    x = spark.createDataFrame([(2019,), (2020,)], "season int")
    with pytest.raises(features.LeakError):
        features.guard_history(x, "season", 2020)
    assert features.guard_history(x, "season", 2021) is x
    assert features.leakage_columns(["p1_x", "y_x", "age", "id"], keys=("id",)) == ["age"]


def test_lineup(spark):
    x = spark.createDataFrame([(1, 1, 10.0, ["A", "FLEX"]), (1, 2, 9.0, ["A", "FLEX"]), (1, 3, 1.0, ["B"])], "t int, p int, pts double, e array<string>")
    r = history.best_lineup(x, ["t"], "p", "pts", "e", {"A": 1, "FLEX": 1, "B": 1}).first()
    assert (r.best, r.used) == (20.0, 3)


def test_expressions(spark):
    x = spark.createDataFrame([("D'André  Smith-Jones Jr.", -150, 112)], "n string, o int, k int")
    assert x.select(e.name_key("n"), F.round(e.american_to_probability("o"), 2), e.ordinal("k")).first()[:] == ("DANDRE SMITH JONES", 0.6, "112th")


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    df = spark.createDataFrame([(1, ["QB"])], "id int, slots array<string>")
    s.write(2024, "x", board=df)
    s.write(2024, "x", draft=df)
    assert s.meta(2024, "x")["artifacts"].keys() == {"board", "draft"} and not s.stale(2024, "x", 5)
    assert s.read(2024, "x", "board").first().slots == ["QB"] and s.seasons("board").count() == 1
    with pytest.raises(FileNotFoundError):
        s.read(2023, "x", "board")
    with pytest.raises(ValueError):
        store.checked(df.union(df), ["id"])
    assert store.optional(spark, f"{tmp_path}/none", "a int").count() == 0


def test_every_oracle_has_a_query():
    from quorum import catalogue

    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and len(catalogue.queries()) > 80


def test_season_has_every_team(spark):
    from quorum import catalogue

    odds, places, swing = (catalogue.queries()[x](spark, "/root/testdata/sf0.001").toPandas() for x in ("simulate_season", "simulate_places", "playoff_swing"))
    teams = set(range(25))
    assert set(odds.team) == set(places.team) == set(swing.team) == teams
    assert abs(odds.playoff_odds.sum() - 4) < 1e-9 and abs(odds.mean_wins.sum() - 300) < 1e-9
    table = places.set_index("team")
    assert table.shape == (25, 25) and np.allclose(table.sum(axis=0), 100) and np.allclose(table.sum(axis=1), 100)
    assert np.allclose(table * 10, (table * 10).round())  # 1,000 trials


def test_name_key_takes_all_lines(spark, tmp_path):
    from quorum import catalogue

    spark.createDataFrame([(1, "\nAndré Smith-Jones\nand O'Neil Jr.\n"), (2, "One"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert vals(catalogue.queries()["name_key_folded"](spark, str(tmp_path)), "doc_id", "key") == [(1, "ANDRE SMITH JONES AND ONEIL"), (2, "ONE"), (3, None)]


def test_game_lines_shuffle_once(spark, tmp_path):
    from quorum import catalogue

    rows = [(1, 1, 10.0, 0.1), (1, 2, 4.0, None), (1, 3, 20.0, 0.2), (2, 2, 5.0, 0.05), (3, 1, None, None), (None, 4, 7.0, 0.5), (4, None, 1.0, 1.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalogue.queries()["game_lines"](spark, str(tmp_path))
    want = {(1, "spread"): (4.0, 15.0), (1, "total"): (None, 0.15), (2, "spread"): (5.0, None), (2, "total"): (0.05, None), (None, "spread"): (7.0, None), (None, "total"): (0.5, None)}
    want |= {(k, m): (None, None) for k in (3, 4) for m in ("spread", "total")}
    assert {(r.game, r.market): (r.away, r.home) for r in got.collect()} == want and got.count() == len(want)
    plan = got._jdf.queryExecution().executedPlan().initialPlan().toString()
    assert plan.count("Exchange ") == 1 and "HashAggregate" not in plan[plan.index("Exchange ") :]  # one shuffle, below all sums
