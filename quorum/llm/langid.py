"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 code points of the letters and blanks of a text (case folded); a text's
vector is the relative counts times the inverse document frequencies.  Document frequencies are counted over every learning row;
the weights are fitted by follow-the-regularised-leader with elastic-net penalties (so most stay zero) on a bounded sample: the
`sample` learning rows with the smallest hashes of their ids, in that order, `epochs` times.  Every tenth row of the
sample is held back to fit the temperature of the softmax, on targets smoothed by their number.

Texts that are null or have no letter are `und` with score 0.  If nothing can be learned, every text is.  Whole texts are read, in slices
of whole texts.  Repeated rows get equal predictions, each its own row; of equally likely languages the first by name is predicted, and
rows that tie in the sample's order are taken by id, text and language.  Only doc_id, text and lang are read, whatever other columns say.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common as c

U = np.uint64
BITS = 15
SAMPLE = 3000
UND = "und"


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    table: np.ndarray | None = None  # idf times weight: (2^BITS, languages), float32
    bias: np.ndarray | None = None
    temperature: float = 1.0


_fold: list[np.ndarray] = []


def fold() -> np.ndarray:
    """Code point to its lower-case letter, or 0 for what is no letter."""
    if not _fold:
        import regex

        out = np.zeros(0x110000, np.uint32)
        for lo in range(0, 0x110000, 0x800):  # in blocks, so that a worker never holds a string object per code point
            if not 0xD800 <= lo < 0xE000:
                for m in regex.finditer(r"\p{L}", "".join(map(chr, range(lo, lo + 0x800)))):
                    out[ord(m[0])] = ord(m[0].lower()[0])
        _fold.append(out)
    return _fold[0]


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams, their documents, and each document's letters."""
    n = len(off) - 1
    head = (data & 0xC0) != 0x80
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-" + ("le" if sys.byteorder == "little" else "be")), np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(np.r_[0, np.cumsum(head)][off]))
    x = fold()[cp]
    letter = x > 0
    letters = np.bincount(doc[letter], minlength=n)
    keep = letter | np.r_[False, letter[:-1]]  # one blank after each run of letters
    x, doc = x[keep].astype(np.uint32), doc[keep]
    if not len(x):
        return np.zeros(0, np.int32), doc, letters
    idx, docs = [], []
    for k in (1, 2, 3):
        h = x[: len(x) - k + 1].copy()
        for j in range(1, k):
            h = h * np.uint32(0x9E3779B1) + x[j : len(x) - k + 1 + j]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(k * 0x27D4EB2F)
        same = doc[: len(h)] == doc[k - 1 :]
        idx.append(((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS))[same].astype(np.int32))
        docs.append(doc[: len(h)][same])
    return np.concatenate(idx), np.concatenate(docs), letters


def frequencies(docs: DataFrame) -> np.ndarray:
    """Number of texts that have each hashed n-gram, and last their number; summed by Spark from one vector per task."""

    def run(batches):
        total = np.zeros((1 << BITS) + 1, np.int64)
        for b in c.slices(batches):
            data, off = c.flat(b.column("text"))
            idx, doc, _ = grams(data, off)
            key = np.unique(doc.astype(np.int64) << BITS | idx)
            total[:-1] += np.bincount(key & (1 << BITS) - 1, minlength=1 << BITS)
            total[-1] += len(off) - 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["i", "n"])

    out = np.zeros((1 << BITS) + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # 2^BITS + 1 rows at most
        out[r.i] = r.n
    return out


def train(texts: list[bytes], y: list[str], df: np.ndarray, epochs: int = 5, alpha: float = 20.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.002) -> Model:
    langs = sorted(set(y))
    if not langs:
        return Model()
    k = len(langs)
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float64)
    off = np.r_[0, np.cumsum([len(x) for x in texts])].astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    rows = []
    for lo, hi in c.cuts(np.diff(off)):
        idx, doc, _ = grams(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        key, n = np.unique(doc.astype(np.int64) << BITS | idx, return_counts=True)
        d, i = key >> BITS, key & (1 << BITS) - 1
        at = np.searchsorted(d, np.arange(hi - lo + 1))
        for a, b in zip(at, at[1:]):
            v = n[a:b] / max(1, n[a:b].sum()) * idf[i[a:b]]
            rows.append((i[a:b], v))
    target = np.array([langs.index(x) for x in y])
    z, s = np.zeros((len(idf) + 1, k)), np.zeros((len(idf) + 1, k))

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(s[i])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        return w

    bias = len(idf)
    held = np.arange(len(rows)) % 10 == 9 if len(rows) >= 20 else np.zeros(len(rows), bool)
    for _ in range(epochs):
        for r in np.flatnonzero(~held):
            i, v = rows[r]
            i, v = np.r_[i, bias], np.r_[v, 1.0]
            w = weights(i)
            p = v @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[target[r]] -= 1
            g = v[:, None] * p
            step = (np.sqrt(s[i] + g * g) - np.sqrt(s[i])) / alpha
            z[i] += g - step * w
            s[i] += g * g
    w = weights(np.arange(len(idf) + 1))
    m = Model(langs, (w[:-1] * idf[:, None]).astype(np.float32), w[-1], 1.0)
    use = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    logits = np.array([(rows[r][1][:, None] * w[rows[r][0]]).sum(0) + w[-1] for r in use]).reshape(len(use), k)
    best, slack = np.inf, 1 / (len(use) + 2)  # smoothed targets: texts that are all told apart do not make every score 1
    for t in np.exp(np.linspace(np.log(0.005), np.log(10), 80)):  # the temperature of least loss
        a = logits / t
        a -= a.max(1, keepdims=True)
        right = np.zeros_like(a)
        right[np.arange(len(use)), target[use]] = 1
        soft = right * (1 - slack) + (1 - right) * slack / max(1, k - 1)
        loss = (np.log(np.exp(a).sum(1)) - (a * soft).sum(1)).mean() if len(use) else 0
        if loss < best - 1e-9:
            best, m.temperature = loss, float(t)
    return m


def in_learning(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from the rows of docs (text, lang, doc_id) that in_learning() allows."""
    rows = docs.selectExpr("CAST(doc_id AS LONG) doc_id", "CAST(text AS STRING) text", "CAST(lang AS STRING) lang").where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").where(in_learning())
    df = frequencies(rows)
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    got = rows.join(F.broadcast(ids.distinct()), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text", "lang").limit(sample).collect()
    return train([r.text.encode() for r in got], [r.lang for r in got], df)


def predict(data: np.ndarray, off: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language (or -1) and its probability."""
    n = len(off) - 1
    idx, doc, letters = grams(data, off)
    if not m.langs:
        return np.full(n, -1), np.zeros(n)
    total = np.maximum(np.bincount(doc, minlength=n), 1)
    z = np.stack([np.bincount(doc, weights=m.table[:, j][idx], minlength=n) for j in range(len(m.langs))], 1) / total[:, None] + m.bias
    z /= m.temperature
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = np.where(letters > 0, p.argmax(1), -1)
    return best, np.where(best < 0, 0.0, p.max(1))


def identified(docs: DataFrame, m: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` with lang_pred and score."""
    schema = docs.select(*keep).schema
    source = "text" if "text" in keep else "__text"
    cols = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").cast("string").alias("__text"))

    def run(batches):
        names = np.array([*m.langs, UND], object)
        for b in c.slices(batches, source):
            data, off = c.flat(b.column(source))
            best, score = predict(data, off, m)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return cols.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, lang_pred string, score double")
