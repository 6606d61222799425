"""Hard negatives by blocked dense matrix products.

Anchors are a stated set of rows (ids divisible by 50), compared with all rows in blocks.  A block of anchors of a fixed number of bytes is
broadcast; each task multiplies its batches of candidates with it in float64.  Components are integers, so a product is exact while the
lengths of both vectors multiply to less than 2^53 (no partial sum can be larger); rows beyond that are multiplied as Python integers.

First pass: every task keeps a running list of each anchor's best rows of its own label, and lists of tasks merge by the same rule.  Second
pass: with the positives' scores known, every task keeps for each anchor and positive the best rows of other labels inside the window.

A repeated row counts as often as it stands.  A row is left out as its own anchor's positive once, its repeats are not.  Null ids are no
anchors and come last among ties.  Vectors of different lengths are compared as if the shorter one ended in zeros.  Scores beyond a long
raise an error.  Columns other than the three named are not read.  An empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import shared_dir, stored

BLOCK_BYTES = 32 << 20
TILE = 1024
CANDIDATES = 2048
POSITIVES, NEGATIVES = 5, 3
EXACT = float(1 << 53)
LAST = np.iinfo(np.int64).max

BEST = "anchor int, score long, id long, no_id boolean"
PICKED = "anchor int, slot int, anchor_id long, positive_id long, positive_score long, times long, score long, id long, no_id boolean"


def usable(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, v) of the rows that take part: label, vector and every component are there, and every component is finite."""
    inf = float("inf")
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(inf)))
    return rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & ~bad).select(
        F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v")
    )


def shifted(rows: DataFrame, every: int, labels: int) -> DataFrame:
    """Wrong labels for a check: where the id is divisible by `every`, the next label."""
    return rows.withColumn("label", F.when(F.col("id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """floor(256 x) of each component, as a float64 matrix of at least dim columns."""
    n = len(col)
    ends = np.asarray(col.offsets, np.int64)
    flat = np.floor(256.0 * np.asarray(col.values, np.float64)[ends[0] : ends[-1]]) if n else np.zeros(0)
    size = np.diff(ends) if n else np.zeros(0, np.int64)
    width = max(dim, int(size.max()) if n else 0)
    if n and (size == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width))
    out[np.arange(width) < size[:, None]] = flat
    return out


class Scorer:
    """Scores of candidates against some anchors: int64, by a float64 product where that is exact."""

    def __init__(self, anchors: np.ndarray):
        self.a, self.norms = anchors, np.sqrt((anchors**2).sum(1))

    def __call__(self, lo: int, hi: int, c: np.ndarray, norms: np.ndarray) -> np.ndarray:
        a = self.a[lo:hi]
        w = min(a.shape[1], c.shape[1])
        top_a, top_c = self.norms[lo:hi].max(initial=0), norms.max(initial=0)
        if top_a * top_c < EXACT:
            return (a[:, :w] @ c[:, :w].T).astype(np.int64)
        got = np.zeros((len(a), len(c)), np.int64)
        fits = norms * top_a < EXACT
        got[:, fits] = (a[:, :w] @ c[fits, :w].T).astype(np.int64)
        whole = [[int(x) for x in r] for r in a[:, :w]]
        for j in np.flatnonzero(~fits):
            row = [int(x) for x in c[j, :w]]
            got[:, j] = [sum(x * y for x, y in zip(r, row)) for r in whole]  # numpy raises where a score exceeds a long
        return got


LOW = np.iinfo(np.int64).min


class Best:
    """Running lists of k best (score, id) of n anchors: higher scores first, ties by smaller id, rows without an id last."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.full((n, k), LOW), np.full((n, k), LAST)
        self.no_id = np.ones((n, k), bool)

    def offer(self, lo: int, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        """scores: anchors from lo on against candidates in the order of their ids, LOW where a candidate is none; changed in place."""
        worst = self.score[lo : lo + len(scores), -1]
        top = scores.max(1, initial=LOW)
        live = np.flatnonzero((top >= worst) & (top > LOW))
        if not len(live):
            return
        s, at = scores[live], np.arange(len(live))
        new_s, new_i, new_n = np.full((len(live), self.k), LOW), np.full((len(live), self.k), LAST), np.ones((len(live), self.k), bool)
        for r in range(min(self.k, s.shape[1])):
            j = s.argmax(1)  # the first of equal scores, so that of smallest id
            new_s[:, r] = s[at, j]
            got = new_s[:, r] > LOW
            new_i[got, r], new_n[got, r] = ids[j[got]], no_id[j[got]]
            s[at, j] = LOW
        rows = lo + live
        s, i, n = np.hstack([self.score[rows], new_s]), np.hstack([self.id[rows], new_i]), np.hstack([self.no_id[rows], new_n])
        order = np.lexsort((i, n, ~s), axis=1)[:, : self.k]  # ~s falls as s rises, and cannot overflow
        self.score[rows], self.id[rows], self.no_id[rows] = (np.take_along_axis(x, order, 1) for x in (s, i, n))


def _candidates(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple]:
    """Blocks of candidates in the order of their ids, null last: ids, which have none, labels, matrix, lengths."""
    for whole in batches:
        most = max(1, min(CANDIDATES, BLOCK_BYTES // (8 * dim)))
        for lo in range(0, whole.num_rows, most):
            b = whole.slice(lo, most)
            none = b.column("id").is_null().to_numpy(zero_copy_only=False)
            ids = np.where(none, LAST, b.column("id").fill_null(0).to_numpy())
            m = _matrix(b.column("v"), dim)
            order = np.lexsort((ids, none))
            m = m[order]
            yield ids[order], none[order], b.column("label").to_numpy()[order], m, np.sqrt((m**2).sum(1))


def _positives(block):
    """A task's best rows of each anchor's label; the anchor itself, and its equals, are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, labels, anchors, _ = block.value
        best, score = Best(len(labels), POSITIVES + 1), Scorer(anchors)
        for ids, none, has, m, norms in _candidates(batches, anchors.shape[1]):
            for lo in range(0, len(labels), TILE):
                hi = min(lo + TILE, len(labels))
                s = score(lo, hi, m, norms)
                s[labels[lo:hi, None] != has[None, :]] = LOW
                best.offer(lo, s, ids, none)
        at, r = np.nonzero(best.score > LOW)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(best.score[at, r]), pa.array(best.id[at, r], mask=best.no_id[at, r]), pa.array(best.no_id[at, r])], names=["anchor", "score", "id", "no_id"])

    return run


def _negatives(block, chosen):
    """A task's best rows of other labels inside the window of each anchor and positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_ids, labels, anchors, times = block.value
        p_score, p_id, p_none, low, high = chosen.value
        slots, score = p_score.shape[1], Scorer(anchors)
        best = [Best(len(labels), NEGATIVES) for _ in range(slots)]
        for ids, none, has, m, norms in _candidates(batches, anchors.shape[1]):
            for lo in range(0, len(labels), TILE):
                hi = min(lo + TILE, len(labels))
                s = score(lo, hi, m, norms)
                s[labels[lo:hi, None] == has[None, :]] = LOW
                for k in range(slots):
                    lows, highs = low[lo:hi, k], high[lo:hi, k]
                    if (lows <= highs).any():
                        best[k].offer(lo, np.where((s >= lows[:, None]) & (s <= highs[:, None]), s, LOW), ids, none)
        for k in range(slots):
            at, r = np.nonzero(best[k].score > LOW)
            n = len(at)
            yield pa.record_batch(
                [
                    pa.array(at.astype(np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(a_ids[at]), pa.array(p_id[at, k], mask=p_none[at, k]), pa.array(p_score[at, k]),
                    pa.array(times[at]), pa.array(best[k].score[at, r]), pa.array(best[k].id[at, r], mask=best[k].no_id[at, r]), pa.array(best[k].no_id[at, r]),
                ],
                names=["anchor", "slot", "anchor_id", "positive_id", "positive_score", "times", "score", "id", "no_id"],
            )

    return run


def _merged(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Lists of tasks made one: the k best of each key, with their ranks."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "no_id", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def windows(anchors: np.ndarray, ids: np.ndarray, best: pa.Table, floor: int, ceiling: int) -> tuple[np.ndarray, ...]:
    """From the merged lists, each anchor's positives without itself, and the windows of scores their negatives lie in.

    A list has one row more than is needed.  If the anchor is in it, one row of its id and score goes; if not, POSITIVES others are ahead of it.
    """
    n, k = len(ids), POSITIVES
    s, i, none = np.full((n, k + 1), LOW), np.full((n, k + 1), LAST), np.ones((n, k + 1), bool)
    at, r = best.column("anchor").to_numpy(), best.column("rank").to_numpy() - 1
    s[at, r], none[at, r] = best.column("score").to_numpy(), best.column("no_id").to_numpy(zero_copy_only=False)
    i[at, r] = best.column("id").fill_null(LAST).to_numpy()
    own = np.array([sum(int(x) * int(x) for x in v) for v in anchors], np.int64) if n and (anchors**2).sum(1).max() >= EXACT else (anchors**2).sum(1).astype(np.int64)
    me = (s == own[:, None]) & (i == ids[:, None]) & ~none
    gone = np.where(me.any(1), me.argmax(1), k)
    keep = np.arange(k) + (np.arange(k) >= gone[:, None])
    s, i, none = (np.take_along_axis(x, keep, 1) for x in (s, i, none))
    there = s > LOW
    whole = s.astype(object)  # a positive's score times 95 may exceed a long
    low = np.where(there, -((-floor * whole) // 100), 1).astype(np.int64)
    high = np.where(there, (ceiling * whole) // 100, 0).astype(np.int64)
    return s, i, none, low, high


def mine(rows: DataFrame, every: int = 50, floor: int = 50, ceiling: int = 95) -> DataFrame:
    """Of (id, label, v): for each anchor (id divisible by every) and each of its POSITIVES best rows of the same label, the NEGATIVES best rows of other
    labels whose score is from floor to ceiling per cent of the positive's.

    Anchors that are equal in all columns are one row with a count.  A block's anchors and positives pass through the driver, BLOCK_BYTES at a
    time; every block reads the candidates twice, without moving them.
    """
    spark = rows.sparkSession
    anchors = rows.where(F.col("id") % every == 0).groupBy("id", "label", "v").agg(F.count("*").alias("times"))
    anchors = stored(anchors.withColumn("h", F.xxhash64("id", "label", "v")))
    total = anchors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dim = max(1, int(total[1]))
    blocks = max(1, math.ceil(total[0] * 8 * dim / BLOCK_BYTES))
    out = shared_dir(spark)
    for b in range(blocks):
        got = anchors.where(F.pmod("h", F.lit(blocks)) == b).drop("h").toArrow()
        ids, labels, times = (got.column(c).to_numpy() for c in ("id", "label", "times"))
        matrix = np.vstack([_matrix(c, dim) for c in got.column("v").chunks] or [np.zeros((0, dim))])
        block = spark.sparkContext.broadcast((ids, labels, matrix, times))
        best = _merged(rows.mapInArrow(_positives(block), BEST), ["anchor"], POSITIVES + 1).toArrow()
        chosen = spark.sparkContext.broadcast(windows(matrix, ids, best, floor, ceiling))
        found = _merged(rows.mapInArrow(_negatives(block, chosen), PICKED), ["anchor", "slot"], NEGATIVES)
        found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.mode("append").parquet(out)
        block.destroy()
        chosen.destroy()
    return spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(out)
