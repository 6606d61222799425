"""Quality rules and a calibrated hashed n-gram logistic regression.

Base rules count words, characters in words, symbols, repeated lines and words in repeated 8-word windows.  The model
is a logistic regression on hashed words, word bigrams, characters and character 3-grams (code points; relative counts within
each kind), fitted by full-batch gradient steps on a bounded sample of labelled rows (the `sample` labelled documents with the
smallest hashes of their ids), then calibrated (Platt) on a fifth of the sample that the fit does not see.  A document is kept
if it passes the base rules and its probability of good quality reaches the fixed threshold.

Nulls and empty texts have no words and fail the base rules.  Where no labels of both kinds exist, the base rules decide alone.
Rows with one id all count for themselves, repeated rows too; labelled rows that tie in the sample's order are taken by id and text.  Whole
texts are scored, in slices of whole texts, and equal lines and windows are compared as they are, not by a hash.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as c

U = np.uint64
DIM_BITS = 16
SCALE = 10.0
SAMPLE = 2500
THRESHOLD = 0.3
MIN_WORDS = 20
REPEAT_WINDOW = 8  # a power of two
SYMBOLS = b"#*$%&|<>"


@dataclass
class Model:
    weights: np.ndarray  # four blocks of 2^DIM_BITS
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40)))


def _bucket(h: np.ndarray, block: int) -> np.ndarray:
    return ((h >> U(64 - DIM_BITS)).astype(np.int64)) + (block << DIM_BITS)


def features(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block, the hashed feature of every occurrence and its document."""
    s, e, doc = c.words(data, off)
    w = c.word_hashes(data, s, e)
    pair = doc[1:] == doc[:-1]
    yield _bucket(w, 0), doc
    two = c.mix(w[:-1] * U(3) + w[1:])[pair]
    yield _bucket(two, 1), doc[:-1][pair] if len(doc) else doc
    del s, e, w, two, pair, doc
    head = (data & 0xC0) != 0x80
    cp = data if head.all() else np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-" + ("le" if sys.byteorder == "little" else "be")), np.uint32)
    v = c.mix(cp.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(3))
    del cp
    of = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(np.r_[0, np.cumsum(head)][off]))
    for block, k in ((2, 1), (3, 3)):
        gram = v[: len(v) - k + 1] if k == 1 else v[:-2] * U(9) + v[1:-1] * U(3) + v[2:]
        same = of[: len(gram)] == of[k - 1 :][: len(gram)]
        yield _bucket(c.mix(gram), block)[same], of[: len(gram)][same]


def _per_doc(idx: np.ndarray, doc: np.ndarray, n: int):
    """Distinct features of each document with their relative counts."""
    key, count = np.unique(doc.astype(np.int64) << 20 | idx, return_counts=True)
    d, i = key >> 20, key & (1 << 20) - 1
    total = np.bincount(doc, minlength=n)
    return i, d, SCALE * count / total[d]


def scores(data: np.ndarray, off: np.ndarray, m: Model) -> np.ndarray:
    n = len(off) - 1
    z = np.full(n, m.bias)
    for idx, doc in features(data, off):
        z += SCALE * np.bincount(doc, weights=m.weights[idx], minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1)
    return z


def fit(texts: list[bytes], y: np.ndarray, steps: int = 100, l2: float = 1e-3) -> Model:
    """Full-batch fit; class weights balance the labels; Platt calibration on every fifth row."""
    n = len(texts)
    m = Model(np.zeros(4 << DIM_BITS, np.float32), 0.0)
    if not 0 < y.sum() < n or n < 20:
        return m
    off = np.r_[0, np.cumsum([len(x) for x in texts])].astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    parts = [[], [], []]
    for lo, hi in c.cuts(np.diff(off)):
        for idx, doc in features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]):
            i, d, x = _per_doc(idx, doc, hi - lo)
            for p, v in zip(parts, (i.astype(np.int32), (d + lo).astype(np.int32), x.astype(np.float32))):
                p.append(v)
    i, d, x = (np.concatenate(p) for p in parts)
    held = np.arange(n) % 5 == 4
    share = y[~held].mean()
    weight = np.where(held, 0, np.where(y == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))) / max(1, (~held).sum())
    used = np.unique(i)
    j = np.searchsorted(used, i).astype(np.int32)
    w, b = np.zeros(len(used)), 0.0
    mw, vw, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam on the whole sample
        z = np.bincount(d, weights=w[j] * x, minlength=n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        gw = np.bincount(j, weights=g[d] * x, minlength=len(used)) + l2 * w / len(used)
        gb = g.sum()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        u, v = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.3 * (mw / u) / (np.sqrt(vw / v) + 1e-7)
        b -= 0.3 * (mb / u) / (np.sqrt(vb / v) + 1e-7)
    z = np.bincount(d, weights=w[j] * x, minlength=n) + b
    m.weights[used], m.bias = w, b
    zh, yh = z[held], y[held].astype(float)
    if 0 < yh.sum() < len(yh):
        m.slope, m.shift = _platt(zh, yh)
    return m


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method on smoothed targets."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    scale = max(1e-6, float(np.abs(z).mean()))
    a, b = 1.0, 0.0
    x = z / scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([((p - t) * x).sum(), (p - t).sum()])
        r = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(r * x * x).sum() + 1e-3, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3) / scale, float(b)


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the `sample` labelled documents with the smallest hashes of their ids."""
    lab = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").selectExpr("CAST(doc_id AS LONG) doc_id", "CAST(quality AS INT) quality").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    pick = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.selectExpr("CAST(doc_id AS LONG) doc_id", "CAST(text AS STRING) text").where("text IS NOT NULL").join(F.broadcast(pick), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).collect()
    return fit([r.text.encode() for r in rows], np.array([r.quality > 0 for r in rows], float) if rows else np.zeros(0))


def _repeating(key: np.ndarray, doc: np.ndarray) -> list[int]:
    """Documents that have a key twice; what repeats in them is then counted on the bytes themselves."""
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    return np.unique(d[1:][(k[1:] == k[:-1]) & (d[1:] == d[:-1])]).tolist()


def _repeat_words(words: list[bytes]) -> int:
    """Words in windows that stand in the text twice or more: numbers of words, then of pairs of numbers, and so on."""
    number: dict[bytes, int] = {}
    v, step = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)), 1
    while step < REPEAT_WINDOW:
        v = np.unique(v[:-step] << 32 | v[step:], return_inverse=True)[1]
        step *= 2
    again = np.flatnonzero(np.bincount(v)[v] > 1)
    return int(c.covered(again, REPEAT_WINDOW, len(words)).sum())


def base(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of the base rules for every text."""
    n = len(off) - 1
    s, e, doc = c.words(data, off)
    n_words = np.bincount(doc, minlength=n)
    heads = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    word_chars = np.bincount(doc, weights=heads[e] - heads[s], minlength=n).astype(np.int64)
    sym = np.r_[0, np.cumsum(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))]
    n_symbols = sym[off[1:]] - sym[off[:-1]]
    # lines with a word, equal to an earlier line of their text
    cut = np.unique(np.r_[off, np.flatnonzero(data == 10) + 1])
    lo, hi = cut[:-1], cut[1:].copy()
    hi[data[hi - 1] == 10] -= 1
    line_of = np.searchsorted(lo, s, "right") - 1
    has = np.unique(line_of)
    lo, hi = lo[has], hi[has]
    ld = np.searchsorted(off, lo, "right") - 1
    raw = data.tobytes()
    h = c.span_names(data, lo, hi, 4)
    n_dup = np.zeros(n, np.int64)
    for d in _repeating(h, ld):
        a, b = np.searchsorted(ld, (d, d + 1))
        mine = [raw[x:y] for x, y in zip(lo[a:b].tolist(), hi[a:b].tolist())]
        n_dup[d] = len(mine) - len(set(mine))
    # words in windows found twice or more in their text
    end = np.cumsum(n_words)
    at = np.arange(len(s))
    at = at[at + REPEAT_WINDOW <= end[doc]] if len(s) else at
    wd = doc[at]
    key = c.Windows(c.word_hashes(data, s, e), REPEAT_WINDOW, 1).of(at, REPEAT_WINDOW) if len(at) else np.zeros(0, np.uint64)
    n_repeat = np.zeros(n, np.int64)
    for d in _repeating(key, wd):
        n_repeat[d] = _repeat_words(raw[off[d] : off[d + 1]].split())
    return {"n_words": n_words.astype(np.int64), "word_chars": word_chars, "n_symbols": n_symbols.astype(np.int64), "n_dup_lines": n_dup.astype(np.int64), "n_repeat_words": n_repeat, "base_failed": (n_words < MIN_WORDS) | (100 * n_repeat > 30 * n_words)}


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality_score double, kept boolean"


def judged(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` (a stage passes all of documents) with the counts, the calibrated score and the verdict."""
    schema = docs.select(*keep).schema
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    source = "text" if "text" in keep else "__text"
    cols = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").cast("string").alias("__text"))

    def run(batches):
        for b in c.slices(batches, source):
            data, off = c.flat(b.column(source))
            out = base(data, off)
            p = model.probability(scores(data, off, model)) if model.weights.any() else np.ones(len(off) - 1)
            out |= {"quality_score": p, "kept": ~out["base_failed"] & (p >= threshold)}
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(out[k]) for k in names)], names=[*keep, *names])

    return cols.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, {COLUMNS}")
