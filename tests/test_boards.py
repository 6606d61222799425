"""Ranks over whole tables, filters that compose, blends under several weight tables, models that are loaded or fitted."""

import random

import pytest
from pyspark.sql import functions as F

from quorum.operators import blend, board, model, present


@pytest.mark.parametrize("desc", [True, False])
def test_global_ranks(spark, desc):
    rnd = random.Random(2)
    values = [7] * 400 + [2**60 + i for i in range(9)] + [None] * 30 + [rnd.randrange(-50, 50) for _ in range(300)]  # one value of half the rows, longs beyond doubles
    rnd.shuffle(values)
    df = spark.createDataFrame(list(enumerate(values)), "id int, v long")
    known = sorted((v for v in values if v is not None), reverse=desc)
    first = {v: known.index(v) + 1 for v in set(known)}
    got = {r.id: r.place for r in present.global_ranks(df, "id", {"place": (F.col("v"), desc)}).collect()}
    assert len(got) == len(values) and all(got[i] == (None if v is None else first[v]) for i, v in enumerate(values))
    order = sorted((i for i, v in enumerate(values) if v is not None), key=lambda i: ((-values[i] if desc else values[i]), i))
    got = {r.id: r.place for r in present.global_ranks(df, "id", {"place": (F.col("v"), desc)}, ties=False).collect()}
    assert [got[i] for i in order] == list(range(1, len(order) + 1)) and sum(p is None for p in got.values()) == 30
    two = present.global_ranks(df, "id", {"a": (F.col("v"), True), "b": (F.col("v") + 1, False)}).where("v = 7").select("a", "b").distinct().collect()
    assert len(two) == 1 and present.global_ranks(df.limit(0), "id", {"place": (F.col("v"), desc)}).count() == 0


def test_filters_compose(spark, tmp_path):
    rows = [(1, "A.J. One", "QB", True, False, 2, 5), (2, "B Two", "RB", None, None, None, None), (3, "AxJx Three", "QB", False, True, 9, 7), (4, "C Four", None, True, None, 1, 5)]
    spark.createDataFrame(rows, "id int, name string, pos string, startable boolean, held boolean, tier int, bye int").write.parquet(f"{tmp_path}/b")
    b = spark.read.parquet(f"{tmp_path}/b")
    ids = lambda **k: sorted(r.id for r in board.filtered(b, **k).collect())
    assert ids() == [1, 2, 3, 4] == ids(keep={"pos": [], "nothing": [1]}, most={"tier": None}, search=("name", "  "))
    assert ids(keep={"pos": ["QB"]}) == [1, 3] and ids(keep={"bye": [5, 7]}) == [1, 3, 4]
    assert ids(without=["held"]) == [1, 2, 4] and ids(only=["startable"]) == [1, 2, 4] and ids(most={"tier": 2}) == [1, 2, 4]
    assert ids(search=("name", " a.j. ")) == [1] and ids(search=("name", "(")) == []
    assert ids(keep={"pos": ["QB"], "bye": [5]}, without=["held"], most={"tier": 3}, search=("name", "one")) == [1]
    plan = board.filtered(b, keep={"pos": ["QB"]}, most={"tier": 2}, without=["held"])._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "In(pos" in pushed or "EqualTo(pos" in pushed
    assert "LessThanOrEqual(tier,2)" in pushed


def test_variants_are_separate_blends(spark):
    o = spark.createDataFrame([(1, "s", "a", 10.0, False), (1, "s", "b", 20.0, False), (2, "s", "a", 5.0, False), (2, "s", "b", 7.0, True)], "id int, stat string, source string, value double, is_imputed boolean")
    tables = {"all": [("a", 0.5), ("b", 0.5)], "less": [("a", 1.0), ("b", 0.0)]}
    got = {(r.id, r.variant): r.value for r in blend.variants(o, spark.createDataFrame([(v, *x) for v, w in tables.items() for x in w], "variant string, source string, weight double"), ["id"], list(tables)).collect()}
    for v, w in tables.items():
        for r in blend.weighted(o, spark.createDataFrame(w, "source string, weight double"), ["id"]).collect():
            assert got[r.id, v] == r.value
    assert len(got) == 4


def test_models_are_loaded_where_current(spark, tmp_path):
    df, calls = spark.createDataFrame([("g", float(i % 3), float(i), 2.0 * i + 1) for i in range(30)], "g string, s double, x double, y double"), []

    def fit(through):
        calls.append(through)
        return model.fit(df, "g", ["x"], "y")

    path = f"{tmp_path}/m"
    assert model.is_stale(spark, path, 2024)
    one = sorted(map(tuple, model.load_or_fit(spark, path, 2024, "g", "string", fit).collect()))
    assert calls == [2023] and not model.is_stale(spark, path, 2024) and model.is_stale(spark, path, 2025)
    assert sorted(map(tuple, model.load_or_fit(spark, path, 2024, "g", "string", fit).collect())) == one and calls == [2023]
    model.load_or_fit(spark, path, 2025, "g", "string", fit)
    model.load_or_fit(spark, path, 2024, "g", "string", fit)  # the later one has seen the season
    assert calls == [2023, 2024]
    model.load_or_fit(spark, path, 2025, "g", "string", fit, refit=True)
    assert calls == [2023, 2024, 2024]


def test_traits_are_chosen_as_one_by_one(spark):
    """Equal to going through the candidates from the strongest, with two timing sentences and one of any other kind, until three are chosen."""
    from quorum.operators import tendencies

    rnd = random.Random(5)
    some = [(o, rnd.choice(["timing", "build", "team", "auto"]), float(rnd.choice([1, 1.5, 2, 3])), f"text {rnd.randrange(9)}") for o in range(12) for _ in range(rnd.randrange(8))]
    some = list(dict.fromkeys(some))
    owners = [(o, o % 4) for o in range(14)]
    got = {r.owner: (r.traits, r.headline) for r in tendencies.compose(spark.createDataFrame(some, "owner int, kind string, score double, text string"), spark.createDataFrame(owners, "owner int, seasons int"), "owner").collect()}
    for o, seasons in owners:
        chosen, used = [], {}
        for _, kind, score, text in sorted((x for x in some if x[0] == o), key=lambda x: (-x[2], x[1], x[3])):
            if used.get(kind, 0) < {"timing": 2}.get(kind, 1) and len(chosen) < 3:
                used[kind] = used.get(kind, 0) + 1
                chosen.append((kind, text[0].upper() + text[1:] + "."))
        if seasons < 2:
            assert got[o] == ("One draft on record: nothing here is a tendency yet.", None)
        elif not chosen:
            assert got[o] == (f"Drafts near consensus over {seasons} drafts.", None)
        else:
            assert got[o] == (" ".join(t for _, t in chosen) + f" ({seasons} drafts)", chosen[0][0])
