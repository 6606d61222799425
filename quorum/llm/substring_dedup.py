"""Exact removal of repeated word windows by recompression (Jez).

Every round renames maximal runs of one symbol, then pairs of a left and a right symbol.  A symbol's name is 128 bits
of what it spells (of a word's bytes, of a symbol and its count, of two symbols), so a name is global: equal text gets
equal names on every executor, and no round needs a shuffle for a dictionary.  Each symbol also carries the words it
spells and the span of words that its existence depends on.  A symbol whose span lies inside a window stands, at the
same place, in every copy of that window: the highest such symbol (the leftmost of them) is the window's core.

Spark's rounds: count the cores; windows whose core occurs twice are told apart by their core's name, its place, and
the symbols before and after it, and counted in turn; words covered by a repeated window go.  So equal windows get equal names, and
windows of equal names spell the same words, up to collisions of 128 bits.  Nulls and empty texts have no word;
repeated rows are copies of one another; every text is read whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c

WINDOW = 35
FAR = 1 << 40
U = np.uint64
_RUN, _LEFT = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)), (U(0x9FB21C651E98DF25), U(0xE7037ED1A0B428DB))


@dataclass
class Symbols:
    """Symbols of one level: one or two names (the first decides how symbols are joined), document, the words [lo, hi) that each spells and the span [left, right) it depends on."""

    names: tuple[np.ndarray, ...]
    doc: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def __len__(self) -> int:
        return len(self.doc)

    def pick(self, m: np.ndarray) -> "Symbols":
        return Symbols(tuple(x[m] for x in self.names), self.doc[m], self.lo[m], self.hi[m], self.left[m], self.right[m])


def runs(x: Symbols) -> Symbols:
    """Names maximal runs of one symbol."""
    joint = x.doc[1:] == x.doc[:-1]
    same = joint & (x.names[0][1:] == x.names[0][:-1])
    a = np.flatnonzero(np.r_[True, ~same])
    b = np.r_[a[1:], len(x)] - 1
    left = np.where(np.r_[False, joint][a], x.left[np.maximum(a - 1, 0)], -FAR)
    right = np.where(np.r_[joint, False][b], x.right[np.minimum(b + 1, len(x) - 1)], FAR)
    n = (b - a + 1).astype(np.uint64)
    names = tuple(np.where(n > 1, c.mix(v[a] ^ n * k), v[a]) for v, k in zip(x.names, _RUN))
    return Symbols(names, x.doc[a], x.lo[a], x.hi[b], left, right)


def paired(x: Symbols, rnd: int) -> Symbols:
    """Names pairs of a left and a right symbol; a round's coin, from the name, says which a symbol is."""
    joint = x.doc[1:] == x.doc[:-1]
    second = c.mix(x.names[0] + U(c.mixed(rnd))) >> U(63) == 1
    pair = joint & ~second[:-1] & second[1:]
    head, tail = np.r_[pair, False], np.r_[False, pair]
    left = np.where(second & ~tail, np.r_[-FAR, np.where(joint, x.left[:-1], -FAR)], x.left)
    right = np.where(~second & ~head, np.r_[np.where(joint, x.right[1:], FAR), FAR], x.right)
    at = np.flatnonzero(pair)
    right[at] = x.right[at + 1]
    hi = x.hi.copy()
    hi[at] = x.hi[at + 1]
    names = tuple(v.copy() for v in x.names)
    for v, k in zip(names, _LEFT):
        v[at] = c.mix(v[at] * k ^ c.mix(v[at + 1] + k))
    return Symbols(names, x.doc, x.lo, hi, left, right).pick(~tail)


def levels(names: tuple[np.ndarray, ...], doc: np.ndarray, width: int) -> list[Symbols]:
    """Of every round, the symbols whose span fits a window; rounds end when none does."""
    pos = np.arange(len(doc), dtype=np.int64)
    x = Symbols(names, doc, pos, pos + 1, pos, pos + 1)
    out = [x]
    while len(x) > 1:
        x = paired(runs(x), len(out))
        ok = (x.left >= 0) & (x.right - x.left <= width)
        if not ok.any():
            break
        out.append(x.pick(ok))
    return out


@dataclass
class Cores:
    """For each window start: its core's names, first word and end, and a number that tells occurrences of cores apart."""

    names: tuple[np.ndarray, ...]
    lo: np.ndarray
    hi: np.ndarray
    which: np.ndarray


def cores(levels: list[Symbols], starts: np.ndarray, width: int) -> Cores:
    out = Cores(tuple(np.zeros(len(starts), np.uint64) for _ in levels[0].names), *(np.zeros(len(starts), np.int64) for _ in range(3)))
    todo, base = np.arange(len(starts)), sum(map(len, levels))
    for n in range(len(levels) - 1, -1, -1):
        x = levels[n]
        base -= len(x)
        at = starts[todo]
        j = np.searchsorted(x.left, at)
        jj = np.minimum(j, len(x) - 1)
        ok = (j < len(x)) & (x.right[jj] <= at + width)
        rows, jj = todo[ok], jj[ok]
        for mine, name in zip(out.names, x.names):
            mine[rows] = c.mix(name[jj] + U(n + 1))
        out.lo[rows], out.hi[rows], out.which[rows] = x.lo[jj], x.hi[jj], base + jj
        todo = todo[~ok]
        if not len(todo):
            break
    return out


class Group:
    """One group's words, and its windows of `width` words."""

    def __init__(self, t: pa.Table, width: int):
        c.trim()
        self.t, self.width = c.in_order(t), width
        self.data, self.off = c.flat(self.t.column("text"))
        self.s, self.e, self.doc = c.words(self.data, self.off)
        self.count = np.bincount(self.doc, minlength=self.t.num_rows)
        end = np.cumsum(self.count)
        self.first = end - self.count
        pos = np.arange(len(self.s))
        self.starts = pos[pos + width <= end[self.doc]] if len(pos) else pos

    def core_keys(self, names: int = 1):
        """Distinct cores, whether each occurs more than once here, and the index of every window's core."""
        self.words = tuple(c.word_hashes(self.data, self.s, self.e, seed) for seed in range(names))
        self.cores = cores(levels(self.words, self.doc, self.width), self.starts, self.width)
        w, at = np.unique(self.cores.which, return_index=True)
        keys, inv, n = c.distinct(self.cores.names[0][at])
        return keys, n > 1, inv[np.searchsorted(w, self.cores.which)]

    def window_keys(self, hit: np.ndarray):
        """Distinct names of the windows in the mask: each from its core, the core's place and the symbols of the words around it."""
        at, lo, hi = self.starts[hit], self.cores.lo[hit], self.cores.hi[hit]
        names = []
        for seed, (core, words) in enumerate(zip(self.cores.names, self.words), 1):
            w = c.Windows(words, self.width, seed)
            before, after = w.of(at, lo - at), w.of(hi, at + self.width - hi)
            names.append(c.mix(c.mix(core[hit] * _RUN[0] ^ before) * _LEFT[0] ^ after + (lo - at).astype(np.uint64)))
        keys, inv, n = c.distinct(np.stack(names, 1))
        return keys, n > 1, inv


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def remove_repeats(docs: DataFrame, width: int = WINDOW, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (texts) kept: the words outside repeated windows, one space apart."""
    total = c.text_bytes(docs)
    g = c.grouped(docs, total)
    buckets = max(64, total // (16 << 20))
    schema = OUT if texts else OUT.rsplit(",", 1)[0]

    def send_cores(t: pa.Table) -> pa.Table:
        keys, many, _ = Group(t, width).core_keys()
        return pa.Table.from_batches([c.key_rows(t.column("g")[0].as_py(), 0, keys, many, buckets)])

    def send_windows(t: pa.Table, rows: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.Table.from_batches([], pa.schema([("b", pa.int32()), ("g", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("many", pa.binary())]))
        x, own = Group(t, width), t.column("g")[0].as_py()
        keys, _, back = x.core_keys(2)
        hit = c.flags(rows, 0, keys, buckets)[back] if len(x.starts) else np.zeros(0, bool)
        keys, many, inv = x.window_keys(hit)
        # keys are sent in order of their first windows, so that the last step needs no names to find a window's answer: only
        # the bucket of each first window, and of each later one which key it repeats
        first = np.full(len(keys), len(inv), np.int64)
        first[inv[::-1]] = np.arange(len(inv))[::-1]
        order = np.argsort(first)
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        inv = rank[inv]
        new = np.zeros(len(inv), bool)
        new[first] = True
        out = c.key_rows(own, 1, keys[order], many[order], buckets)
        place = c.bucket_of(keys[order, 0], buckets).astype(np.min_scalar_type(buckets))
        blobs = [np.packbits(hit).tobytes(), b"".join([np.packbits(new).tobytes(), place.tobytes(), inv[~new].astype(np.int32).tobytes()])]
        # this note travels as a row of a bucket of its own, which only passes it on
        note = pa.record_batch([pa.array([-1 - own], pa.int32()), pa.array([own], pa.int32()), pa.array([2], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], names=out.schema.names)
        return pa.Table.from_batches([out, note])

    def count_windows(t: pa.Table) -> pa.Table:
        if t.column("b")[0].as_py() >= 0:
            counts = [len(k) // 16 for k in t.column("keys").to_pylist()]
            out = c.answer(2)(t)
            return out.append_column("many", pa.array([np.int32(n).tobytes() for n in counts], pa.binary()))
        return pa.table([t.column("g"), t.column("kind"), t.column("b"), t.column("keys"), t.column("many")], names=["g", "kind", "b", "bits", "many"])

    def finish(t: pa.Table, rows: pa.Table) -> pa.Table:
        x = Group(t, width) if t.num_rows else None
        if x is None:
            return pa.Table.from_batches([], _schema(texts))
        gone = np.zeros(len(x.s), bool)
        got = sorted(zip(rows.column("kind").to_pylist(), rows.column("b").to_pylist(), rows.column("bits").to_pylist(), rows.column("many").to_pylist()))
        if len(x.starts) and got[0][0] == 1:
            hit = np.unpackbits(np.frombuffer(got[-1][2], np.uint8), count=len(x.starts)).astype(bool)
            again = np.concatenate([np.unpackbits(np.frombuffer(bits, np.uint8), count=int(np.frombuffer(n, np.int32)[0])) for kind, _, bits, n in got[:-1]]).astype(bool)
            m, note = int(hit.sum()), got[-1][3]
            new = np.unpackbits(np.frombuffer(note, np.uint8, (m + 7) // 8), count=m).astype(bool)
            place = np.frombuffer(note, np.min_scalar_type(buckets), len(again), (m + 7) // 8)
            mine = np.empty(len(again), bool)
            mine[np.argsort(place, kind="stable")] = again
            key = np.empty(m, np.int64)
            key[new], key[~new] = np.arange(len(again)), np.frombuffer(note, np.int32, -1, (m + 7) // 8 + place.nbytes) if len(again) < m else 0
            gone = c.covered(x.starts[hit][mine[key]], width, len(x.s))
        kept, removed = [], np.bincount(x.doc, weights=gone, minlength=x.t.num_rows).astype(np.int64)
        raw = x.data.tobytes()
        for i in range(x.t.num_rows):
            w = raw[x.off[i] : x.off[i + 1]].split()
            if removed[i]:
                a = x.first[i]
                w = compress(w, (~gone[a : a + x.count[i]]).tolist())
            kept.append(b" ".join(w))
        cols = [x.t.column("doc_id"), pa.array(x.count.astype(np.int64)), pa.array(removed), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        return pa.Table.from_arrays(cols + ([pa.array(kept, pa.binary()).cast(pa.string())] if texts else []), schema=_schema(texts))

    bits = g.groupBy("g").applyInArrow(send_cores, c.KEYS).groupBy("b").applyInArrow(c.answer(1), c.BITS)
    wins = g.groupBy("g").cogroup(bits.groupBy("g")).applyInArrow(send_windows, c.KEYS)
    back = wins.groupBy("b").applyInArrow(count_windows, c.BITS + ", many binary")
    return g.groupBy("g").cogroup(back.groupBy("g")).applyInArrow(finish, schema)


def _schema(texts: bool) -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + ([("kept", pa.string())] if texts else []))
