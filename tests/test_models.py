"""Regressions from moments: walk-forward coverage, weights of many sources, every combination of sources."""

from itertools import combinations

import numpy as np
import pytest

from quorum.operators import model


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(x if x is None or isinstance(x, str) else float(x) for x in r) for r in rows], schema)


def test_moments_do_not_cancel(spark):
    df = frame(spark, [(g, 1e9 + x, 3 * x + 1e12) for g in ("a", "b") for x in range(100)], "g string, x double, y double")
    got = {(r.g, r.term): r.value for r in model.fit(df, "g", ["x"], "y").collect()}
    assert abs(got["a", "x"] - 3) < 1e-6
    before = {(r.s, r.term): r.value for r in model.fit_before(df.withColumn("s", df.g), "s", ["x"], "y").collect()}
    assert set(s for s, _ in before) == {"b"} and abs(before["b", "x"] - 3) < 1e-6


def test_walk_forward_against_separate_fits(spark):
    r = np.random.default_rng(7)
    rows = []
    for s in range(6):
        for i in range(60):
            rookie = i % 4 == 0
            a, b, c = r.normal(size=3) * 3 + 9
            y = (2 * c if rookie else a + 0.5 * b) + r.normal() * 2 + s
            rows.append((s, "rookie" if rookie else "veteran", None if rookie else a, None if rookie or i % 9 == 1 else b, c, None if i % 11 == 0 else y))
    df = frame(spark, rows, "s double, arm string, a double, b double, c double, y double")
    terms = {"veteran": ["a", "b"], "rookie": ["c"]}
    got = {(x.season, x.arm): x for x in model.walk_forward(df, "s", "arm", terms, "y", 1.28).collect()}
    assert len(got) == 12
    for (s, arm), x in got.items():
        use = lambda row: [row[2], row[3]] if arm == "veteran" else [row[4]]
        train = [(use(q), q[5]) for q in rows if q[0] < s and q[1] == arm and q[5] is not None and None not in use(q)]
        test = [(use(q), q[5]) for q in rows if q[0] == s and q[1] == arm and q[5] is not None]
        assert x.n == len(test)
        if not train:
            assert (x.spoke, x.covered, x.below, x.above, x.mae) == (0, 0, 0, 0, None)
            continue
        design = np.column_stack([np.ones(len(train)), np.array([t for t, _ in train])])
        beta, *_ = np.linalg.lstsq(design, np.array([v for _, v in train]), rcond=None)
        rest = np.array([v for _, v in train]) - design @ beta
        sd = np.sqrt(rest @ rest / (len(train) - design.shape[1]))
        pairs = [(max(0.0, float(np.r_[1, q] @ beta)), v) for q, v in test if None not in q]
        low = [max(0.0, g - 1.28 * sd) for g, _ in pairs]
        assert abs(x.sigma - sd) < 1e-9 and x.spoke == len(pairs) and abs(x.mae - np.mean([abs(g - v) for g, v in pairs])) < 1e-9
        assert x.covered == sum(lo <= v <= g + 1.28 * sd for lo, (g, v) in zip(low, pairs))
        assert x.below == sum(v < lo for lo, (_, v) in zip(low, pairs)) and x.above == sum(v > g + 1.28 * sd for g, v in pairs)


def test_weights_against_all_supports(spark):
    r = np.random.default_rng(3)
    for trial in range(40):
        x = r.normal(size=(50, 5))
        x[:, 4] = x[:, 0] + r.normal(size=50) * (0 if trial % 5 == 0 else 0.1)  # near and exact copies
        y = x @ (r.normal(size=5)) + r.normal(size=50)
        a, b = x.T @ x, x.T @ y
        w = model.nnls(a, b)
        best = min(
            (float(np.sum((x[:, s] @ v - y) ** 2)) if len(s) else float(y @ y))
            for k in range(6) for s in map(list, combinations(range(5), k)) for v in [np.linalg.lstsq(x[:, s], y, rcond=None)[0] if s else np.zeros(0)] if (v >= -1e-12).all()
        )
        assert (w >= 0).all() and float(np.sum((x @ w - y) ** 2)) <= best + 1e-7
    rows = [(i % 2, *map(float, v), float(v @ [0.2, 0.3, 0, 0.5, 0])) for i, v in enumerate(r.random((60, 5)))]
    df = spark.createDataFrame([*rows, (0, None, 1.0, 1.0, 1.0, 1.0, 1.0)], "half int, a double, b double, c double, d double, e double, y double")
    for got in model.nnls_weights(df, ["half"], list("abcde"), "y", normalise=True).collect():
        assert got.n == 30 and all(abs(got.weights[k] - v) < 1e-6 for k, v in zip("abcde", (0.2, 0.3, 0, 0.5, 0)))


@pytest.mark.parametrize("most", [2, 4])
def test_every_combination_from_one_matrix(spark, most):
    r = np.random.default_rng(5)
    x = r.normal(size=(80, 4)) * [1, 10, 0.1, 3] + [5, 1e4, 0, -2]
    y = x @ [1, -0.2, 7, 0.5] + r.normal(size=80)
    df = spark.createDataFrame([("g", *map(float, v), float(u)) for v, u in zip(x, y)], "g string, a double, b double, c double, d double, y double")
    got = {}
    for q in model.weight_finder(df, "g", list("abcd"), "y", most).collect():
        got.setdefault(q.sources, ({}, q.r2, q.n))[0][q.term] = q.value
    wanted = [c for k in range(1, most + 1) for c in combinations(range(4), k)]
    assert len(got) == len(wanted)
    for c in wanted:
        names = ["abcd"[i] for i in c]
        design = np.column_stack([np.ones(80), x[:, c]])
        beta, *_ = np.linalg.lstsq(design, y, rcond=None)
        values, r2, n = got["+".join(names)]
        assert n == 80 and all(abs(values[t] - b) < 1e-6 * max(1, abs(b)) for t, b in zip(["intercept", *names], beta))
        assert abs(r2 - (1 - np.sum((y - design @ beta) ** 2) / np.sum((y - y.mean()) ** 2))) < 1e-9


def test_a_source_that_repeats_another(spark):
    df = spark.createDataFrame([("g", float(i), 2.0 * i, float(i) + 1) for i in range(9)], "g string, a double, b double, y double")
    assert {q.sources for q in model.weight_finder(df, "g", ["a", "b"], "y").collect()} == {"a", "b"}


def test_closed_forms_equal_the_solver(spark):
    r = np.random.default_rng(8)
    rows = []
    for g in range(6):
        a, b = r.normal(size=30) * 5 + 100, r.normal(size=30)
        b = {1: 2 * a, 2: np.full(30, 3.0), 3: -a + 7}.get(g, b)
        a = np.full(30, 1.0) if g in (4, 5) else a
        b = np.full(30, 4.0) if g == 5 else b
        rows += [(g, float(x), float(y), float(2 * x - y + z)) for x, y, z in zip(a, b, r.normal(size=30))]
    df = spark.createDataFrame(rows, "g int, a double, b double, y double")
    for xs in (["a"], ["a", "b"]):
        got = {(q.g, q.term): q.value for q in model.fit(df, "g", xs, "y").collect()}
        for q in model.moments(df, "g", [*xs, "y"]).collect():
            want, _ = model.solve(q.n, np.array(q["mean"]), model.symmetric(q.products, len(xs) + 1))
            assert all(abs(got[q.g, t] - v) < 1e-6 * max(1, abs(v)) for t, v in zip(["intercept", *xs], want)), (q.g, xs)
