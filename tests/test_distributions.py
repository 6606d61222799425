"""Quantiles of whole arrays: equal to brute sums and integrals, alike at every size of mean."""

import math
import time
import tracemalloc

import numpy as np
import pytest

from quorum.functions import distributions as d


def test_lgamma():
    x = np.r_[np.linspace(1e-3, 30, 500), 1e3, 1e7]
    assert np.allclose(d.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def brute_nb(q, mean, var):
    r, p = mean * mean / (var - mean), mean / var
    k, term = 0, math.exp(r * math.log(p))
    total = term
    while total < q:
        term *= (k + r) / (k + 1) * (1 - p)
        k += 1
        total += term
    return k


@pytest.mark.parametrize("q", [0.05, 0.1, 0.5, 0.9, 0.99])
def test_negative_binomial_against_sums(q):
    mean = np.array([0.02, 0.5, 3, 3, 17.3, 200, 450.5, 5000])
    var = np.array([0.5, 0.6, 3.5, 90, 40, 260, 30_000, 2e6])
    assert d.negative_binomial_quantile(q, mean, var).tolist() == [brute_nb(q, m, v) for m, v in zip(mean, var)]


def test_poisson_limit_and_points():
    got = d.negative_binomial_quantile(0.5, np.array([0.0, -1, 10.0, 4e4]), np.array([1.0, 1, 10.0, 4e4]))
    assert got[:2].tolist() == [0, 0] and got[2] == 10 and abs(got[3] - 4e4) <= 1
    assert d.gamma_quantile(0.3, np.array([0.0, -2, 5]), np.array([1.0, 1, 0])).tolist() == [0, 0, 5]


def test_gamma_against_integrals():
    for mean, var in ((1.0, 1.0), (4, 2), (0.2, 1), (50, 2000), (9000, 8000), (1e5, 1e5)):
        for q in (0.01, 0.1, 0.5, 0.9):
            x = float(d.gamma_quantile(q, mean, var)[0])
            a, s = mean * mean / var, var / mean
            if a < 1:  # in u = y^a the density has no pole
                u = np.linspace(0, (x / s) ** a, 400_001)
                area = np.trapezoid(np.exp(-(u ** (1 / a))), u) / (a * math.gamma(a))
            else:
                y = np.linspace(max(0, x / s - 24 * math.sqrt(a)), x / s, 400_001)[1:]
                area = np.trapezoid(np.exp((a - 1) * np.log(y) - y - math.lgamma(a)), y)
            assert abs(area - q) < 1e-6 + 1e-4 * (a < 1.01), (mean, var, q)
    assert np.allclose(d.gamma_quantile(0.5, np.array([1.0]), np.array([1.0])), math.log(2))


def test_forms_meet_where_they_change():
    """Series and fractions on one side of LARGE, quadrature on the other."""
    a = np.array([d.LARGE * 0.999999, d.LARGE * 1.000001])
    for t in (-3, -0.5, 0, 2):
        got = d.gamma_cdf(a + t * np.sqrt(a), a)
        assert abs(got[0] - got[1]) < 1e-7
        got = d.beta_cdf(0.4 + t * 0.004, a, a * 1.5)
        assert abs(got[0] - got[1]) < 1e-5


def test_neither_time_nor_memory_grows_with_the_mean():
    mean = np.array([1e3, 1e6, 1e9, 1e12])
    tracemalloc.start()
    began = time.perf_counter()
    for var in (mean * 2, mean * mean, mean**1.5):
        for q in (0.1, 0.9):
            k = d.negative_binomial_quantile(q, mean, var)
            assert (np.abs(k - mean) < 6 * np.sqrt(var)).all()
            below, at = d.negative_binomial_cdf(k - 1, mean, var), d.negative_binomial_cdf(k, mean, var)
            assert (below < q).all() and (at >= q).all()
    assert time.perf_counter() - began < 20 and tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


def test_mass_at_zero_keeps_mean_and_variance():
    q = (np.arange(4000) + 0.5) / 4000
    x = np.array([d.quantile(20.0, 300.0, p, bust=0.2).item() for p in q])
    assert (x[: 4000 // 5] == 0).all() and (x[4000 // 5 :] > 0).all()
    assert abs(x.mean() - 20) < 0.05 and abs(x.var() - 300) < 6
    assert d.quantile(20.0, 300.0, 0.1, bust=0.2).item() == 0.0


def test_columns(spark):
    df = spark.createDataFrame([(3.0, 9.0, 0.0), (3.0, 9.0, 0.5), (None, 1.0, 0.0), (2.0, None, 0.0), (0.0, 1.0, 0.0)], "m double, v double, b double")
    got = [tuple(r) for r in df.select(d.interval("m", "v", 0.9), d.interval("m", "v", 0.9, "count"), d.interval("m", "v", 0.4, bust="b")).collect()]
    assert abs(got[0][0] - float(d.gamma_quantile(0.9, 3.0, 9.0)[0])) < 1e-12 and got[0][1] == brute_nb(0.9, 3.0, 9.0)
    assert got[1][2] == 0.0 and got[0][2] > 0 and got[2] == (None, None, None) == got[3] and got[4][:2] == (0.0, 0.0)


def test_beta_binomial():
    cdf = d.beta_binomial_cdf(17, np.array([0.0, 0.3, 0.7, 1.0]), 0.2)
    assert np.allclose(cdf[:, -1], 1)
    assert abs((17 - cdf[1, :-1].sum()) - 17 * 0.3) < 1e-9  # the mean is the sum of the tails
    assert np.allclose(d.beta_binomial_cdf(5, np.array([0.5]), 0.0)[0], np.cumsum([math.comb(5, k) / 32 for k in range(6)]))


def test_calibration_of_what_it_generated(spark):
    """Games drawn from the distribution itself are covered about as often as the interval claims, a discrete one somewhat more; those of a wider one less."""
    from quorum.operators import usage

    r = np.random.default_rng(6)
    share = np.repeat([0.3, 0.6, 0.8], 400)

    def games(rho):
        s = (1 - rho) / rho
        return r.binomial(17, r.beta(share * s, (1 - share) * s))

    rows = [(k, float(17 * p), int(g)) for k, rho in (("same", 0.1), ("wider", 0.5)) for p, g in zip(share, games(rho))] + [("same", None, 3), ("same", 4.0, None)]
    got = {x.k: x for x in usage.calibration(spark.createDataFrame(rows, "k string, m double, g int"), ["k"], "m", "g", 17, 0.1).collect()}
    assert got["same"].n == 1200 and 0.8 <= got["same"].coverage <= 0.92 and got["wider"].coverage < 0.7
    for x in got.values():
        low, high = (d.beta_binomial_quantile(17, share, 0.1, q) for q in (0.1, 0.9))
        g = np.array([v for k, m, v in rows if k == x.k and m is not None and v is not None])
        assert (x.covered, x.below, x.above) == (int(((g >= low) & (g <= high)).sum()), int((g < low).sum()), int((g > high).sum())) and abs(x.nominal - 0.8) < 1e-12
