"""Small regressions per group by moments: one aggregate job, a tiny solve per group, Column arithmetic to score.

Moments are counts, means and centred products, which one pass gives without cancellation and which add up over groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.store import Store


def moments(df: DataFrame, by: str | list[str], cols: list[str]) -> DataFrame:
    """by, n, mean (array) and products (array of the upper triangle's centred sums) of the rows complete in cols."""
    x = [F.col(c).cast("double") for c in cols]
    ok = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in cols))
    n = F.count("*").cast("double")
    return ok.groupBy(*([by] if isinstance(by, str) else by)).agg(
        n.alias("n"), F.array(*(F.avg(a) for a in x)).alias("mean"), F.array(*(F.covar_pop(a, b) * n for i, a in enumerate(x) for b in x[i:])).alias("products")
    )


def symmetric(products: list[float], k: int) -> np.ndarray:
    """The matrix of its upper triangle, row by row."""
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = products
    return m + np.triu(m, 1).T


def running(m: DataFrame, order: str, by: list[str]) -> DataFrame:
    """Moments of all rows of the groups before each one, from the groups' own: one row a group, no data row is read again."""
    def merge(acc: Column, g: Column) -> Column:
        n = acc["n"] + g["n"]
        d = F.zip_with(g["mean"], acc["mean"], lambda p, q: p - q)
        mean = F.zip_with(acc["mean"], d, lambda p, q: p + q * g["n"] / n)
        outer = F.flatten(F.transform(d, lambda a, i: F.transform(F.slice(d, i + 1, F.size(d)), lambda b: a * b * acc["n"] * g["n"] / n)))
        both = F.zip_with(F.zip_with(acc["products"], g["products"], lambda p, q: p + q), outer, lambda p, q: p + q)
        return F.struct(n.alias("n"), mean.alias("mean"), both.alias("products"))

    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    x = m.withColumn("_before", F.collect_list(F.struct("n", "mean", "products")).over(w)).where(F.size("_before") > 0)
    first = F.get("_before", F.lit(0))
    x = x.withColumn("_sum", F.aggregate(F.slice("_before", 2, F.greatest(F.size("_before") - 1, F.lit(0))), first, merge))
    return x.select(*by, order, "_sum.*")


def solve(n: float, mean: np.ndarray, products: np.ndarray, ridge: float = 0.0) -> tuple[np.ndarray, float]:
    """Intercept and slopes of the last column on the others by least squares, or ridge on standardised terms with a free intercept, and the sum of squared residuals."""
    c = products / n
    sd = np.sqrt(np.maximum(np.diag(c)[:-1], 0))
    use = sd > 1e-12
    beta = np.zeros(len(sd))
    if use.any():
        z = c[:-1, :-1][np.ix_(use, use)] / np.outer(sd[use], sd[use])
        beta[use] = np.linalg.lstsq(z + ridge / n * np.eye(int(use.sum())), c[:-1, -1][use] / sd[use], rcond=None)[0] / sd[use]
    rest = n * float(c[-1, -1] - 2 * beta @ c[:-1, -1] + beta @ c[:-1, :-1] @ beta)
    return np.r_[mean[-1] - beta @ mean[:-1], beta], max(rest, 0.0)


def _closed(m: DataFrame, by: str, xs: list[str], least: int) -> DataFrame:
    """solve() of one or two terms as Column arithmetic, which starts no Python worker: the inverse of their correlation matrix, its pseudo-inverse where they are collinear."""
    n, mean, p = F.col("n"), F.col("mean"), F.col("products")
    at = (lambda i: F.get(p, F.lit(i)) / n)
    sd = lambda c: F.sqrt(F.greatest(c, F.lit(0.0)))
    if len(xs) == 1:
        s = sd(at(0))
        betas = [F.when(s > 1e-12, at(1) / (s * s)).otherwise(0.0)]
    else:
        a, b = sd(at(0)), sd(at(3))
        alone = F.when(a > 1e-12, F.struct((at(2) / (a * a)).alias("a"), F.lit(0.0).alias("b"))).when(b > 1e-12, F.struct(F.lit(0.0).alias("a"), (at(4) / (b * b)).alias("b"))).otherwise(F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")))
        r, u, v = at(1) / (a * b), at(2) / a, at(4) / b
        det = 1 - r * r
        pair = lambda x, y: F.struct((x / a).alias("a"), (y / b).alias("b"))
        both = F.when(det > 1e-13, pair((u - r * v) / det, (v - r * u) / det)).otherwise(pair((u + r * v) / 4, (v + r * u) / 4))
        m = m.withColumn("_beta", F.when((a > 1e-12) & (b > 1e-12), both).otherwise(alone))
        betas = [F.col("_beta.a"), F.col("_beta.b")]
    first = F.get(mean, F.lit(len(xs)))
    for i, beta in enumerate(betas):
        first = first - beta * F.get(mean, F.lit(i))
    rows = F.array(*(F.struct(F.lit(t).alias("term"), v.alias("value")) for t, v in zip(["intercept", *xs], [first, *betas])))
    return m.where(n >= least).select(by, F.inline(rows))


def _solved(m: DataFrame, by: str, xs: list[str], ridge: float, least: int) -> DataFrame:
    """Coefficients (group, term, value), solved where the groups are."""
    if not ridge and len(xs) in (1, 2):
        return _closed(m, by, xs, least)
    kind = m.schema[by].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for g, n, mean, products in zip(pdf[by], pdf["n"], pdf["mean"], pdf["products"]):
                if n >= least:
                    out += [(g, t, float(v)) for t, v in zip(["intercept", *xs], solve(n, np.asarray(mean), symmetric(products, len(xs) + 1), ridge)[0])]
            yield pd.DataFrame(out, columns=[by, "term", "value"])

    return m.select(by, "n", "mean", "products").mapInPandas(run, f"`{by}` {kind}, term string, value double")


def fit(df: DataFrame, by: str, xs: list[str], y: str, ridge: float = 0.0, least: int = 1) -> DataFrame:
    """Coefficients as rows (group, term, value) from one pass; one row of moments a group is solved in Python, none reaches the driver."""
    return _solved(moments(df, by, [*xs, y]), by, xs, ridge, least)


def fit_before(df: DataFrame, season: str, xs: list[str], y: str, least: int = 1) -> DataFrame:
    """Coefficients for every season from all seasons before it: moments add up, so no row is read twice."""
    return _solved(running(moments(df, season, [*xs, y]), season, []), season, xs, 0.0, least)


def walk_forward(df: DataFrame, season: str, arm: str, terms: dict[str, list[str]], y: str, z: float, least: int = 3, low: float | None = 0.0) -> DataFrame:
    """season, arm, n, spoke, covered, below, above, mae, sigma: how predictions and their intervals of z deviations fare, season by season.

    Every arm has its own terms (veterans last season's figures, rookies what is known of them) and is fitted on its earlier seasons; the
    deviation is that of the residuals of the same fit, which the moment matrices give (yy - 2 b xy + b xx b over the rows less the terms), so
    all seasons' fits and intervals take one pass, and scoring one more.  n counts rows with an outcome, spoke those of them with a prediction.
    """
    per = None
    for name, xs in terms.items():
        rows = df.where(F.col(arm) == name)
        m = running(moments(rows.select(season, *dict.fromkeys([*xs, y])), season, [*xs, y]), season, []).withColumn("arm", F.lit(name))
        per = m if per is None else per.unionByName(m)
    kind = df.schema[season].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for s, a, n, mean, products in zip(pdf[season], pdf["arm"], pdf["n"], pdf["mean"], pdf["products"]):
                k = len(terms[a]) + 1
                if n >= max(least, k + 1):
                    beta, rest = solve(n, np.asarray(mean), symmetric(products, k))
                    out.append((s, a, beta.tolist(), float(np.sqrt(rest / (n - k)))))
            yield pd.DataFrame(out, columns=["_season", "_arm", "_beta", "_sigma"])

    fits = per.select(season, "arm", "n", "mean", "products").mapInPandas(run, f"_season {kind}, _arm string, _beta array<double>, _sigma double")
    x = df.where(F.col(y).isNotNull()).join(fits, (F.col(season) == F.col("_season")) & (F.col(arm) == F.col("_arm")), "left")
    guess = None
    for name, xs in terms.items():
        line = F.get("_beta", F.lit(0))
        for i, c in enumerate(xs):
            line = line + F.get("_beta", F.lit(i + 1)) * F.col(c)
        guess = F.when(F.col(arm) == name, line) if guess is None else guess.when(F.col(arm) == name, line)
    x = x.withColumn("_guess", guess if low is None else F.when(guess.isNotNull(), F.greatest(guess, F.lit(low))))
    under, over = F.col("_guess") - z * F.col("_sigma"), F.col("_guess") + z * F.col("_sigma")
    under = under if low is None else F.greatest(under, F.lit(low))
    return x.groupBy(F.col(season).alias("season"), F.col(arm).alias("arm")).agg(
        F.count("*").alias("n"), F.count("_guess").alias("spoke"), F.count_if((F.col(y) >= under) & (F.col(y) <= over)).alias("covered"),
        F.count_if(F.col(y) < under).alias("below"), F.count_if(F.col(y) > over).alias("above"), F.avg(F.abs(F.col(y) - F.col("_guess"))).alias("mae"), F.max("_sigma").alias("sigma"),
    )


def predict(df: DataFrame, coefs: DataFrame, by: str, xs: list[str], low: float | None = 0.0) -> DataFrame:
    """df with a prediction; null where a term is null or the group was not fitted."""
    wide = coefs.groupBy(by).pivot("term", ["intercept", *xs]).agg(F.first("value")).select(by, *(F.col(t).alias(f"_b_{t}") for t in ["intercept", *xs]))
    z = F.col("_b_intercept")
    for x in xs:
        z = z + F.col(f"_b_{x}") * F.col(x)
    z = z if low is None else F.when(z.isNotNull(), F.greatest(z, F.lit(low)))
    return df.join(wide, by, "left").withColumn("prediction", z).drop(*wide.columns[1:])


# ---------------------------------------------------------------- weights of sources


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights w >= 0 that minimise w a w / 2 - b w, by active sets (Lawson and Hanson): a source enters while the gradient says so, and leaves where its weight would be negative."""
    k = len(b)
    w, on = np.zeros(k), np.zeros(k, bool)
    scale = np.abs(b).max(initial=0.0)
    for _ in range(30 * k + 30):
        slope = b - a @ w
        slope[on] = -np.inf
        if on.all() or slope.max() <= 1e-12 * scale:
            break
        on[slope.argmax()] = True
        while True:
            s = np.zeros(k)
            s[on] = np.linalg.lstsq(a[np.ix_(on, on)], b[on], rcond=None)[0]
            bad = on & (s <= 0)
            if not bad.any():
                w = s
                break
            step = (w[bad] / (w[bad] - s[bad])).min()
            w = np.maximum(w + step * (s - w), 0)
            on &= w > 1e-14 * max(w.max(initial=0.0), 1e-300)
            if not on.any():
                break
    return w


def nnls_weights(df: DataFrame, by: list[str], sources: list[str], actual: str, normalise: bool = False) -> DataFrame:
    """by, n, weights (map of source to weight): non-negative least squares of any number of sources without intercept, on rows that have all of them, from one pass."""
    cols = [*sources, actual]
    x = [F.col(c).cast("double") for c in cols]
    m = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in cols)).groupBy(*by).agg(F.count("*").alias("n"), F.array(*(F.sum(a * b) for i, a in enumerate(x) for b in x[i:])).alias("products"))

    @F.pandas_udf("array<double>")
    def run(products: pd.Series) -> pd.Series:
        out = []
        for p in products:
            q = symmetric(p, len(cols))
            w = nnls(q[:-1, :-1], q[:-1, -1])
            out.append((w / w.sum() if normalise and w.sum() > 0 else w).tolist())
        return pd.Series(out)

    return m.select(*by, "n", F.map_from_arrays(F.array(*map(F.lit, sources)), run("products")).alias("weights"))


def sweep(m: np.ndarray, k: int) -> np.ndarray:
    """Sweeps row and column k of a symmetric matrix in; the same again, with the sign of its pivot turned, takes it out."""
    d = m[k, k]
    out = m - np.outer(m[:, k], m[k]) / d
    out[k], out[:, k] = m[k] / d, m[:, k] / d
    out[k, k] = -1 / d
    return out


def subsets(n: float, mean: np.ndarray, products: np.ndarray, most: int) -> Iterator[tuple[tuple[int, ...], np.ndarray, float]]:
    """(columns, coefficients with intercept, R2) of least squares on every subset of at most `most` columns: each is its parent with one more swept in, and a column
    that the parent explains (by all but 1e-10 of its variance) makes no new subset."""
    k = len(mean) - 1
    total = products[-1, -1]

    def grow(cols: tuple[int, ...], m: np.ndarray):
        if cols:
            b = m[list(cols), -1]
            yield cols, np.r_[mean[-1] - b @ mean[list(cols)], b], float(1 - m[-1, -1] / total) if total > 0 else float("nan")
        if len(cols) < most:
            for j in range(cols[-1] + 1 if cols else 0, k):
                if m[j, j] > 1e-10 * max(products[j, j], 1e-300):
                    yield from grow((*cols, j), sweep(m, j))

    yield from grow((), products.copy())


def weight_finder(df: DataFrame, by: str, sources: list[str], actual: str, most: int | None = None) -> DataFrame:
    """by, sources (names joined by +), n, term, value, r2 of least squares of `actual` on every combination of sources, from one moment matrix a group."""
    most = len(sources) if most is None else most
    kind = df.schema[by].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for g, n, mean, products in zip(pdf[by], pdf["n"], pdf["mean"], pdf["products"]):
                out = []
                for cols, beta, r2 in subsets(n, np.asarray(mean), symmetric(products, len(sources) + 1), most):
                    names = [sources[c] for c in cols]
                    out += [(g, "+".join(names), int(n), t, float(v), r2) for t, v in zip(["intercept", *names], beta)]
                yield pd.DataFrame(out, columns=[by, "sources", "n", "term", "value", "r2"])

    return moments(df, by, [*sources, actual]).mapInPandas(run, f"`{by}` {kind}, sources string, n long, term string, value double, r2 double")


def fit_variance(df: DataFrame, mean: str, residual: str) -> tuple[float, float]:
    """phi, 1/k of Var = phi mu + mu^2 / k, both non-negative, from one aggregate."""
    m, v = F.col(mean), F.col(residual) ** 2
    r = df.where(F.col(mean).isNotNull() & F.col(residual).isNotNull()).agg(F.sum(m * m).alias("aa"), F.sum(m * m * m).alias("ab"), F.sum(m * m * m * m).alias("bb"), F.sum(m * v).alias("ay"), F.sum(m * m * v).alias("by")).first()
    aa, ab, bb, ay, by = (float(r[k] or 0) for k in ("aa", "ab", "bb", "ay", "by"))
    phi, inverse = nnls(np.array([[aa, ab], [ab, bb]]), np.array([ay, by]))
    return float(phi), float(inverse)


def save(coefs: DataFrame, path: str) -> None:
    coefs.coalesce(1).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str, by: str, kind: str = "string") -> DataFrame:
    return spark.read.schema(f"`{by}` {kind}, term string, value double").json(path)


def _trained(spark: SparkSession, path: str) -> int | None:
    """The last season that a saved model has seen."""
    return max((int(x.split("=")[1]) for x in Store(spark, path)._names(path) if x.startswith("through=")), default=None)


def is_stale(spark: SparkSession, path: str, season: int) -> bool:
    """Whether the saved model, if there is one, has not seen all seasons before this one."""
    through = _trained(spark, path)
    return through is None or through < season - 1


def load_or_fit(spark: SparkSession, path: str, season: int, by: str, kind: str, fit: Callable[[int], DataFrame], refit: bool = False) -> DataFrame:
    """Coefficients for a season: the saved ones where they are current, else fit(season - 1), which is saved under the last season it has seen.  A model that has seen
    the season itself, or a later one, is none for it."""
    through = season - 1
    if refit or through not in [int(x.split("=")[1]) for x in Store(spark, path)._names(path) if x.startswith("through=")]:
        save(fit(through), f"{path}/through={through}")
    return load(spark, f"{path}/through={through}", by, kind)
