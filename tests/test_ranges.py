"""Order statistics and clusters by rounds of counting: equal to sorting and to all partitions, whatever the values."""

import itertools

import numpy as np
import pytest

from quorum.operators import board, ranges


def test_quantiles_equal_percentile(spark):
    r = np.random.default_rng(1)
    rows = [("flat", 5.0)] * 50 + [("one", -2.5), (None, 1.0), (None, 4.0), ("none", None), ("wide", -1e308), ("wide", 1e308), ("wide", 1e-300), ("wide", 0.0), ("wide", -1e-300)]
    rows += [("near", 1e15 + i) for i in range(7)] + [("normal", float(x)) for x in r.normal(size=900)] + [("ties", float(x)) for x in r.integers(0, 4, 500)] + [("tail", float(np.exp(x))) for x in r.normal(size=300) * 40]
    df = spark.createDataFrame(rows, "g string, v double")
    at = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {x.g: (x.n, x.quantiles) for x in ranges.quantiles(df, "g", "v", at).collect()}
    assert set(got) == {"flat", "one", None, "wide", "near", "normal", "ties", "tail"}
    for g, (n, q) in got.items():
        v = np.array([x for k, x in rows if k == g and x is not None])
        want = np.quantile(v, at) if g != "wide" else [-1e308, None, 0.0, None, 1e308]
        assert n == len(v) and all(w is None or abs(a - w) <= 1e-12 * abs(w) for a, w in zip(q, want)), g
    assert ranges.quantiles(df, None, "v", [0.5]).first().n == sum(x is not None for _, x in rows)
    assert ranges.quantiles(df.limit(0), "g", "v", [0.5]).count() == 0


def cost(v, tier):
    return sum(((v[tier == t] - v[tier == t].mean()) ** 2).sum() for t in set(tier.tolist()))


def test_tiers_against_all_partitions(spark, monkeypatch):
    monkeypatch.setattr(ranges, "BUCKETS", 16)  # several rounds
    r = np.random.default_rng(4)
    groups = {i: np.round(r.random(r.integers(2, 15)) * r.choice([5, 20, 1e6])) for i in range(40)}
    groups |= {100: np.array([10.0, 10.0, 0.0]), 101: np.array([3.0]), 102: np.array([7.0] * 9), 103: np.r_[np.exp(r.normal(size=12) * 9)]}
    df = spark.createDataFrame([(g, i, float(x)) for g, v in groups.items() for i, x in enumerate(v)] + [(5, 99, None)], "g int, id int, v double")
    got = {}
    for x in board.assign_tiers(df, "g", "v", ["id"]).collect():
        got.setdefault(x.g, {})[x.id] = x.tier
    assert set(got) == set(groups)
    for g, v in groups.items():
        tier, d = np.array([got[g][i] for i in range(len(v))]), np.unique(v)
        if len(d) < 2:
            assert (tier == 1).all()
            continue
        k = min(max(2, min(8, round(len(v) / 6))), len(d))
        best = min(cost(v, np.searchsorted(np.array(cuts), v, "right")) for cuts in itertools.combinations(d[1:], k - 1))
        assert set(tier.tolist()) == set(range(1, k + 1)) and cost(v, tier) <= best * (1 + 1e-9) + 1e-12
        assert all(tier[i] <= tier[j] for i in range(len(v)) for j in range(len(v)) if v[i] > v[j])


def dynamic(v, k):
    """Least cost by a table over all distinct values."""
    x, w = np.unique(v, return_counts=True)
    c0, c1, c2 = (np.r_[0, np.cumsum(a)] for a in (w, w * x, w * x * x))
    best = np.r_[0.0, np.full(len(x), np.inf)]
    for _ in range(k):
        new = np.full(len(x) + 1, np.inf)
        for j in range(1, len(x) + 1):
            i = np.arange(j)
            new[j] = (best[i] + c2[j] - c2[i] - (c1[j] - c1[i]) ** 2 / (c0[j] - c0[i])).min()
        best = new
    return best[-1]


@pytest.mark.parametrize("buckets", [1024, 64])
def test_tiers_of_large_groups(spark, monkeypatch, buckets):
    monkeypatch.setattr(ranges, "BUCKETS", buckets)
    r = np.random.default_rng(9)
    groups = {"normal": r.normal(size=1500), "lumps": np.r_[r.normal(size=400), r.normal(size=700) + 8, r.normal(size=50) * 0.01 + 30], "long": np.exp(r.normal(size=1200) * 3), "even": np.linspace(0, 1, 1000)}
    df = spark.createDataFrame([(g, i, float(x)) for g, v in groups.items() for i, x in enumerate(v)], "g string, id int, v double")
    tiers = {}
    for x in board.assign_tiers(df, "g", "v", ["id"]).collect():
        tiers.setdefault(x.g, {})[x.id] = x.tier
    for g, v in groups.items():
        got = np.array([tiers[g][i] for i in range(len(v))])
        assert abs(cost(v, got) - dynamic(v, 8)) <= 1e-7 * dynamic(v, 8), g
