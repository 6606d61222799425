"""Distribution functions and quantiles of whole arrays: gamma, negative binomial, Beta-Binomial.

Incomplete gamma and beta functions by series and continued fractions while parameters are moderate, and by Gauss-Legendre quadrature of the
density around its peak beyond that, so neither time nor memory grows with the mean.  Quantiles are found for all rows of an array together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

LARGE = 3000.0
NODES, WEIGHTS = np.polynomial.legendre.leggauss(64)
TINY = 1e-300


def remainder(x: np.ndarray) -> np.ndarray:
    """lgamma(x + 1) - (x log x - x + log(2 pi x) / 2) for x >= 8: Stirling's series."""
    y = 1 / (x * x)
    return (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y * (1 / 1188))))) / x


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0."""
    x = np.asarray(x, float)
    shift, lead = x.copy(), np.zeros_like(x)
    for _ in range(9):  # up to where the series holds
        low = shift < 9
        lead = np.where(low, lead - np.log(np.where(low, shift, 1.0)), lead)
        shift = np.where(low, shift + 1, shift)
    z = shift - 1
    return lead + z * np.log(z) - z + 0.5 * np.log(2 * np.pi * z) + remainder(z)


def _until_still(step, state: tuple, live: np.ndarray):
    """Repeats step(state, i, rows) on the rows that still move."""
    i = 0
    while len(live):
        i += 1
        live = live[step(state, i, live)]
    return state


def gamma_cdf(x, shape) -> np.ndarray:
    """Regularised lower incomplete gamma function."""
    x, a = np.broadcast_arrays(np.asarray(x, float), np.asarray(shape, float))
    out = np.zeros(x.shape)
    x, a, flat = x.ravel(), a.ravel(), out.ravel()
    there = x > 0
    big = there & (a > LARGE)
    if big.any():
        xx, a1 = x[big], a[big] - 1
        root = np.sqrt(a1)
        end = np.where(xx > a1, np.maximum(a1 + 11.5 * root, xx + 6 * root), np.maximum(0, np.minimum(a1 - 11.5 * root, xx - 6 * root)))
        mid, half = (xx + end) / 2, (end - xx) / 2
        t = mid[:, None] + half[:, None] * NODES
        d = (t - a1[:, None]) / a1[:, None]
        with np.errstate(divide="ignore"):
            f = np.exp(a1[:, None] * (np.log1p(np.maximum(d, -1)) - d)) @ WEIGHTS
        area = f * half * np.exp(-0.5 * np.log(2 * np.pi * a1) - remainder(a1))
        flat[big] = np.where(xx > a1, 1 - area, -area)
    rest = there & ~big
    lead = np.zeros(x.shape)
    lead[rest] = np.exp(a[rest] * np.log(x[rest]) - x[rest] - lgamma(a[rest]))
    series = np.flatnonzero(rest & (x < a + 1))
    if len(series):
        term = np.zeros(x.shape)
        term[series] = 1 / a[series]
        total = term.copy()

        def add(_, i, live):
            term[live] *= x[live] / (a[live] + i)
            total[live] += term[live]
            return term[live] > 1e-16 * total[live]

        _until_still(add, (), series)
        flat[series] = lead[series] * total[series]
    tail = np.flatnonzero(rest & (x >= a + 1))
    if len(tail):
        b, c = x + 1 - a, np.full(x.shape, 1 / TINY)
        d = np.zeros(x.shape)
        d[tail] = 1 / b[tail]
        h = d.copy()

        def go(_, i, live):
            an = -i * (i - a[live])
            b[live] += 2
            d[live] = an * d[live] + b[live]
            d[live] = 1 / np.where(np.abs(d[live]) < TINY, TINY, d[live])
            c[live] = b[live] + an / c[live]
            c[live] = np.where(np.abs(c[live]) < TINY, TINY, c[live])
            m = d[live] * c[live]
            h[live] *= m
            return np.abs(m - 1) > 1e-15

        _until_still(go, (), tail)
        flat[tail] = 1 - lead[tail] * h[tail]
    return np.clip(flat, 0, 1).reshape(out.shape)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < TINY, TINY, d)
    h = d.copy()

    def go(_, m, live):
        aa, bb, xx = a[live], b[live], x[live]
        for k in (m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m)), -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))):
            dd, cc = 1 + k * d[live], 1 + k / c[live]
            d[live], c[live] = 1 / np.where(np.abs(dd) < TINY, TINY, dd), np.where(np.abs(cc) < TINY, TINY, cc)
            step = d[live] * c[live]
            h[live] *= step
        return np.abs(step - 1) > 1e-15

    _until_still(go, (), np.arange(len(x)))
    return h


def beta_cdf(x, a, b) -> np.ndarray:
    """Regularised incomplete beta function."""
    x, a, b = (v.astype(float).ravel() for v in np.broadcast_arrays(np.asarray(x, float), a, b))
    out = np.where(x >= 1, 1.0, 0.0)
    inside = (x > 0) & (x < 1)
    big = inside & (a > LARGE) & (b > LARGE)
    if big.any():
        xx, a1, b1 = x[big], a[big] - 1, b[big] - 1
        n = a1 + b1
        peak = a1 / n
        wide = np.sqrt(peak * (1 - peak) / n)
        end = np.where(xx > peak, np.minimum(1, np.maximum(peak + 11 * wide, xx + 6 * wide)), np.maximum(0, np.minimum(peak - 11 * wide, xx - 6 * wide)))
        mid, half = (xx + end) / 2, (end - xx) / 2
        t = (mid - peak)[:, None] + half[:, None] * NODES
        with np.errstate(divide="ignore", invalid="ignore"):
            f = np.exp(a1[:, None] * np.log1p(np.maximum(t / peak[:, None], -1)) + b1[:, None] * np.log1p(np.maximum(-t / (1 - peak)[:, None], -1))) @ WEIGHTS
        lead = np.log(n + 1) + 0.5 * np.log(n / (2 * np.pi * a1 * b1)) + remainder(n) - remainder(a1) - remainder(b1)
        area = f * half * np.exp(lead)
        out[big] = np.where(xx > peak, 1 - area, -area)
    rest = np.flatnonzero(inside & ~big)
    if len(rest):
        xx, aa, bb = x[rest], a[rest], b[rest]
        lead = np.exp(lgamma(aa + bb) - lgamma(aa) - lgamma(bb) + aa * np.log(xx) + bb * np.log1p(-xx))
        swap = xx > (aa + 1) / (aa + bb + 2)
        p, q, z = np.where(swap, bb, aa), np.where(swap, aa, bb), np.where(swap, 1 - xx, xx)
        part = lead * _beta_fraction(p, q, z) / p
        out[rest] = np.where(swap, 1 - part, part)
    return np.clip(out, 0, 1)


def gamma_quantile(q, mean, var) -> np.ndarray:
    """Quantiles of gamma distributions with these means and variances; a mean of 0 or less, or no variance, is a point."""
    q, m, v = (x.astype(float).ravel() for x in np.broadcast_arrays(np.asarray(q, float), mean, var))
    out = np.maximum(m, 0.0)
    out = np.where((m > 0) & (v > 0) & (q <= 0), 0.0, out)
    rows = np.flatnonzero((m > 0) & (v > 0) & (q > 0) & (q < 1))
    shape, scale, p = m[rows] ** 2 / v[rows], v[rows] / m[rows], q[rows]
    low, high = np.zeros(len(rows)), shape + 10 * np.sqrt(shape) + 10
    while len(up := np.flatnonzero(gamma_cdf(high, shape) < p)):
        high[up] *= 2
    x, live = shape.copy(), np.arange(len(rows))
    while len(live):
        f = gamma_cdf(x[live], shape[live]) - p[live]
        low[live], high[live] = np.where(f < 0, x[live], low[live]), np.where(f >= 0, x[live], high[live])
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            density = np.exp((shape[live] - 1) * np.log(x[live]) - x[live] - lgamma(shape[live]))
            new = x[live] - f / density
        bad = ~((new > low[live]) & (new < high[live]))
        new = np.where(bad, (low[live] + high[live]) / 2, new)
        still = (np.abs(new - x[live]) > 1e-13 * np.abs(new)) & (high[live] - low[live] > 1e-14 * high[live])
        x[live] = new
        live = live[still & (new > TINY)]
    out[rows] = x * scale
    return out


def negative_binomial_cdf(k, mean, var) -> np.ndarray:
    """P(X <= k) with this mean and variance; a variance of no more than the mean is taken as just above it (Poisson)."""
    v = np.maximum(var, np.asarray(mean) * 1.000001)
    return np.where(np.asarray(k) < 0, 0.0, beta_cdf(mean / v, np.asarray(mean) ** 2 / (v - mean), np.asarray(k) + 1))


def _least_integer(cdf, q: np.ndarray, guess: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """The smallest k >= 0 with cdf(k, rows) >= q: steps that double away from a guess, then halving."""
    low, high = np.floor(np.maximum(guess - wide, -1)), np.ceil(guess + wide)
    step, live = np.ceil(wide) + 1, np.arange(len(q))
    while len(live := live[cdf(high[live], live) < q[live]]):
        low[live], high[live] = high[live], high[live] + step[live]
        step[live] *= 2
    step, live = np.ceil(wide) + 1, np.flatnonzero(low >= 0)
    while len(live := live[cdf(low[live], live) >= q[live]]):
        high[live], low[live] = low[live], np.maximum(low[live] - step[live], -1)
        step[live] *= 2
        live = live[low[live] >= 0]
    while len(live := np.flatnonzero(high - low > 1)):
        mid = np.floor((low[live] + high[live]) / 2)
        up = cdf(mid, live) >= q[live]
        high[live], low[live] = np.where(up, mid, high[live]), np.where(up, low[live], mid)
    return high


def negative_binomial_quantile(q, mean, var) -> np.ndarray:
    q, m, v = (x.astype(float).ravel() for x in np.broadcast_arrays(np.asarray(q, float), mean, var))
    out = np.zeros(len(m))
    rows = np.flatnonzero(m > 0)
    m, v, q = m[rows], np.maximum(v[rows], m[rows] * 1.000001), q[rows]
    guess = gamma_quantile(np.clip(q, 1e-12, 1 - 1e-12), m, v)
    out[rows] = _least_integer(lambda k, at: negative_binomial_cdf(k, m[at], v[at]), q, guess, 2 + 0.05 * np.sqrt(v))
    return out


def beta_binomial_cdf(n: int, share: np.ndarray, rho: float) -> np.ndarray:
    """One row per share, one column per value 0..n: distribution function with mean n share and intra-class correlation rho."""
    mu = np.clip(np.asarray(share, float), 1e-6, 1 - 1e-6)[:, None]
    k = np.arange(n + 1.0)[None, :]
    comb = lgamma(np.array([n + 1.0])) - lgamma(k + 1) - lgamma(n - k + 1)
    if rho <= 1e-9:
        logs = comb + k * np.log(mu) + (n - k) * np.log1p(-mu)
    else:
        s = (1 - rho) / rho
        a, b = mu * s, (1 - mu) * s
        logs = comb + lgamma(k + a) + lgamma(n - k + b) - lgamma(np.full_like(mu, n + s)) - (lgamma(a) + lgamma(b) - lgamma(np.full_like(mu, s)))
    return np.minimum(np.cumsum(np.exp(logs), 1), 1)


def beta_binomial_quantile(n: int, share: np.ndarray, rho: float, q: float) -> np.ndarray:
    """Number of values whose distribution function lies below q."""
    return (beta_binomial_cdf(n, share, rho) < q - 1e-12).sum(1)


MOST_BUST = 0.95


def quantile(mean, var, q: float, family: str = "gamma", bust=0.0) -> np.ndarray:
    """Quantiles of a count (negative binomial), or of a gamma with mass `bust` at 0 whose other part is scaled so that the whole keeps mean and variance."""
    m, v, b = (np.asarray(x, float) for x in np.broadcast_arrays(mean, var, bust))
    if family != "gamma":
        return negative_binomial_quantile(q, m, v)
    b = np.clip(b, 0, MOST_BUST)
    part = m / (1 - b)
    spread = np.where(b > 0, np.maximum((v + m * m) / (1 - b) - part * part, 1e-9), v)
    return np.where(q > b, gamma_quantile(np.where(q > b, (q - b) / (1 - b), 0.5), part, spread), 0.0)


def interval(mean: str, var: str, q: float, family: str = "gamma", bust: str | float = 0.0) -> Column:
    """A quantile column; each batch solves its distinct (mean, variance, bust) together.  Null where one of them is."""

    @F.pandas_udf("double")
    def run(m: pd.Series, v: pd.Series, b: pd.Series) -> pd.Series:
        cols = [x.astype("float64") for x in (m, v, b)]
        ok = np.logical_and.reduce([x.notna().to_numpy() for x in cols])
        out = np.full(len(m), np.nan)
        if ok.any():
            u, inv = np.unique(np.stack([x.to_numpy()[ok] for x in cols], 1), axis=0, return_inverse=True)
            out[ok] = quantile(u[:, 0], u[:, 1], q, family, u[:, 2])[inv.ravel()]
        return pd.Series(out).astype(object).where(ok, None).astype("Float64")

    return run(mean, var, F.lit(float(bust)) if isinstance(bust, (int, float)) else F.col(bust).cast("double"))


def games_interval(mean: str, slate: int, rho: float, q: float) -> Column:
    """Quantile of games played, Beta-Binomial with the expected share of the slate."""

    @F.pandas_udf("int")
    def run(m: pd.Series) -> pd.Series:
        ok = m.notna().to_numpy()
        u, inv = np.unique(np.clip(m.astype("float64").to_numpy()[ok] / slate, 0, 1), return_inverse=True)
        out = pd.Series([None] * len(m), dtype="Int32")
        out[ok] = beta_binomial_quantile(slate, u, rho, q)[inv.ravel()]
        return out

    return run(mean)
