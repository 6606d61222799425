"""Order statistics and exact one-dimensional clusters of groups of any size, by rounds of counting over value ranges.

A round cuts every range that is still open into buckets of equal width and counts them (a partial aggregate, so a group that holds a third of
all rows sends each reducer no more than its buckets); what is found closes ranges or narrows them to a bucket's least and greatest value.
A round narrows a range by its number of buckets, so rounds number a few, at most some seventy for values spread over all doubles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import written

BUCKETS = 1024
GROUP = "_group"


def _buckets(x: DataFrame, open_ranges: DataFrame) -> DataFrame:
    """_group, rid, idx, n, s, q, lo, hi: counts, sums, sums of squares and extremes of the buckets of (_group, rid, lo, hi, cells); x holds _group and _v.

    Ranges of a group may overlap, a row then counts in each.  Groups with open ranges are few or their rows are read in the order they have."""
    per = open_ranges.groupBy(GROUP).agg(F.collect_list(F.struct("rid", "lo", "hi", "cells")).alias("_ranges")).withColumnRenamed(GROUP, "_g")
    v, r = F.col("_v"), F.col("_r")
    y = x.join(per, F.col(GROUP).eqNullSafe(F.col("_g"))).withColumn("_r", F.explode(F.filter("_ranges", lambda a: (F.col("_v") >= a["lo"]) & (F.col("_v") <= a["hi"]))))
    # halves, as the width of a range may exceed the largest double
    at = F.floor((v / 2 - r["lo"] / 2) / (r["hi"] / 2 - r["lo"] / 2) * r["cells"])
    at = F.when(r["hi"] > r["lo"], F.least(at, r["cells"] - 1)).otherwise(0).cast("int")
    return y.groupBy(GROUP, r["rid"].alias("rid"), at.alias("idx")).agg(F.count("*").alias("n"), F.sum("_v").alias("s"), F.sum(v * v).alias("q"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))


def quantiles(df: DataFrame, by: str | None, value: str, at: list[float]) -> DataFrame:
    """by (not there where by is None), n and quantiles (array) of the non-null values of each group, interpolated as percentile() does; exact, in bounded memory."""
    group = F.col(by) if by is not None else F.lit(0)
    x = written(df.where(F.col(value).isNotNull()).select(group.alias(GROUP), F.col(value).cast("double").alias("_v")))
    size = x.groupBy(GROUP).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    ranks = F.explode(F.flatten(F.array(*(F.array(F.struct(F.lit(2 * i).alias("rid"), F.floor((F.col("n") - 1) * q).alias("rank")), F.struct(F.lit(2 * i + 1).alias("rid"), F.ceil((F.col("n") - 1) * q).alias("rank"))) for i, q in enumerate(at)))))
    state = written(size.select(GROUP, "n", "lo", "hi", ranks.alias("t")).select(GROUP, "n", "lo", "hi", "t.rid", "t.rank", F.lit(0).cast("long").alias("before")))
    closed = []
    while not (rest := state.where("lo < hi")).isEmpty():
        closed.append(state.where("lo >= hi"))
        b = _buckets(x, rest.select(GROUP, "rid", "lo", "hi", F.lit(BUCKETS).alias("cells")))
        up = F.sum("n").over(Window.partitionBy(GROUP, "rid").orderBy("idx"))  # at most BUCKETS rows
        b = b.select(F.col(GROUP).alias("_g"), F.col("rid").alias("_rid"), F.col("n").alias("_n"), up.alias("_up"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        hit = rest.join(b, F.col(GROUP).eqNullSafe(F.col("_g")) & (F.col("rid") == F.col("_rid"))).where((F.col("before") + F.col("_up") > F.col("rank")) & (F.col("before") + F.col("_up") - F.col("_n") <= F.col("rank")))
        state = written(hit.select(GROUP, "n", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "rid", "rank", (F.col("before") + F.col("_up") - F.col("_n")).alias("before")))
    for part in closed:
        state = state.unionByName(part)
    got = state.groupBy(GROUP).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rid", "lo"))).alias("m"))
    low, high = (lambda i: F.col("m")[2 * i]), (lambda i: F.col("m")[2 * i + 1])
    part = lambda q: (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
    out = F.array(*(low(i) + (high(i) - low(i)) * part(q) for i, q in enumerate(at)))
    return got.select(*([F.col(GROUP).alias(by)] if by is not None else []), "n", out.alias("quantiles"))


# ---------------------------------------------------------------- clusters


class Units:
    """Values of a group in order, as units of neighbouring values with their counts, sums, squares and extremes; `solid` units are not to be cut."""

    def __init__(self, n, s, q, lo, hi, solid):
        self.n, self.s, self.q, self.lo, self.hi = (np.asarray(x, float) for x in (n, s, q, lo, hi))
        self.solid = np.asarray(solid, bool) | (self.lo >= self.hi)
        c0, c1, c2 = (np.r_[0.0, np.cumsum(x)] for x in (self.n, self.s, self.q))
        with np.errstate(divide="ignore", invalid="ignore"):
            w, d = c0[None, :] - c0[:, None], c1[None, :] - c1[:, None]
            cost = np.where(w > 0, c2[None, :] - c2[:, None] - d * d / w, 0.0)
        i = np.arange(len(c0))
        self.cost = np.where(i[:, None] <= i[None, :], np.maximum(cost, 0), np.inf)  # of units i .. j - 1

    def best(self, k: int) -> tuple[float, list[int]]:
        """Least squares about means of k clusters of whole units, and where they begin."""
        m = len(self.n)
        full = np.where(np.tri(m + 1, dtype=bool).T & ~np.eye(m + 1, dtype=bool), self.cost, np.inf)
        f, back = np.r_[0.0, np.full(m, np.inf)], []
        for _ in range(k):
            all_ = f[:, None] + full
            back.append(all_.argmin(0))
            f = all_.min(0)
        cuts, j = [], m
        for b in back[::-1]:
            j = int(b[j])
            cuts.append(j)
        return float(f[m]), cuts[::-1]

    def _below(self, cost: np.ndarray, soft: np.ndarray, k: int) -> np.ndarray:
        """Row t: least cost of t clusters over the units before each boundary, where a cluster may begin inside a soft unit, whose values then cost nothing."""
        m = len(soft)
        rows = [np.r_[0.0, np.full(m, np.inf)]]
        for _ in range(k):
            f = rows[-1]
            start = f.copy()
            start[1:] = np.where(soft, np.minimum(f[1:], f[:-1]), f[1:])  # at the boundary, or inside the unit before it
            rows.append((start[:, None] + cost).min(0))
        return np.array(rows)

    def refine(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Which units an optimal cut may lie in, and which boundaries (1 .. m - 1) it may be: all others cost more than a known partition, whatever is inside."""
        m, (most, _) = len(self.n), self.best(k)
        soft = ~self.solid
        ahead = self._below(self.cost, soft, k)
        behind = self._below(self.cost[::-1, ::-1].T, soft[::-1], k)[:, ::-1]
        limit = most * (1 + 1e-9) + 1e-12 * float(self.q.sum())
        inside, edge = np.zeros(m, bool), np.zeros(m + 1, bool)
        for t in range(1, k):
            inside |= ahead[t, :-1] + behind[k - t, 1:] <= limit
            edge |= ahead[t] + behind[k - t] <= limit
        return inside & soft, edge[1:-1]


def _tiers_wanted(n: int, low: int, high: int, size: float) -> int:
    return int(max(low, min(high, round(n / size))))


def clusters(df: DataFrame, by: str, value: str, low: int = 2, high: int = 8, size: float = 6) -> DataFrame:
    """by, n, cuts: per group the least values of the clusters but the lowest of an exact one-dimensional k-means, k = round(n / size) in [low, high] and no more than there are
    distinct values.  Bounds on what a cut inside a bucket could gain rule out all but a few buckets; those are counted again, until cuts lie between values."""
    x = written(df.where(F.col(value).isNotNull()).select(F.col(by).alias(GROUP), F.col(value).cast("double").alias("_v")))
    kind = x.schema[GROUP].dataType.simpleString()
    size_ = x.groupBy(GROUP).agg(F.count("*").alias("total"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.sum("_v").alias("s"), F.sum(F.col("_v") * F.col("_v")).alias("q"))
    state = written(size_.select(GROUP, "total", F.lit(0).alias("rid"), F.col("total").alias("n"), "s", "q", "lo", "hi", (F.col("lo") >= F.col("hi")).alias("solid")))
    schema = f"{GROUP} {kind}, total long, rid int, n long, s double, q double, lo double, hi double, solid boolean"

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["lo", "hi"]).reset_index(drop=True)
        k = _tiers_wanted(int(p["total"].iloc[0]), low, high, size)
        u = Units(p["n"], p["s"], p["q"], p["lo"], p["hi"], p["solid"])
        if len(p) < k:  # too few to cut between: look into all that hold several values
            inside, edge = ~u.solid, np.ones(len(p) - 1, bool)
        else:
            inside, edge = u.refine(k)
        run = np.r_[0, np.cumsum(edge | inside[1:] | inside[:-1])]
        g = p.assign(_run=run, solid=~inside).groupby("_run", sort=True)
        out = g.agg(n=("n", "sum"), s=("s", "sum"), q=("q", "sum"), lo=("lo", "min"), hi=("hi", "max"), solid=("solid", "all")).reset_index(drop=True)
        out[GROUP], out["total"], out["rid"] = p[GROUP].iloc[0], p["total"].iloc[0], np.arange(len(out))
        return out[[GROUP, "total", "rid", "n", "s", "q", "lo", "hi", "solid"]]

    while not (rest := state.where("NOT solid")).isEmpty():
        cells = F.greatest(F.lit(8), F.floor(F.lit(BUCKETS) / F.count("*").over(Window.partitionBy(GROUP)))).cast("int")
        b = _buckets(x, rest.select(GROUP, "rid", "lo", "hi", cells.alias("cells")))
        b = b.join(rest.select(F.col(GROUP).alias("_g"), "total").distinct(), F.col(GROUP).eqNullSafe(F.col("_g"))).select(GROUP, "total", F.lit(0).alias("rid"), "n", "s", "q", "lo", "hi", F.lit(False).alias("solid"))
        moved = rest.select(F.col(GROUP).alias("_g")).distinct()
        still = state.join(moved, F.col(GROUP).eqNullSafe(F.col("_g")), "left_anti")
        kept = state.where("solid").join(moved, F.col(GROUP).eqNullSafe(F.col("_g")), "left_semi")
        state = written(kept.unionByName(b).groupBy(GROUP).applyInPandas(step, schema).unionByName(still))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("lo").reset_index(drop=True)
        k = min(_tiers_wanted(int(p["total"].iloc[0]), low, high, size), len(p))
        _, begin = Units(p["n"], p["s"], p["q"], p["lo"], p["hi"], p["solid"]).best(k)
        return pd.DataFrame({GROUP: [p[GROUP].iloc[0]], "n": [int(p["total"].iloc[0])], "cuts": [p["lo"].to_numpy()[begin[1:]].tolist()]})

    return state.groupBy(GROUP).applyInPandas(cut, f"{GROUP} {kind}, n long, cuts array<double>").withColumnRenamed(GROUP, by)
