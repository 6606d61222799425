"""Exact removal of repeated byte strings with suffix arrays by external induced sorting (see induced.py).

Which strings can repeat at all is settled first: every `width`-byte string has an anchor, the least 16-byte hash in
it (leftmost of equals), so copies of a string share it.  Anchors are counted over all documents; strings whose
anchor stands in one document only cannot repeat across documents.  Runs of the other strings that share an anchor go, as text, to
the shard that the anchor names; equal runs of a group go once, with the smallest doc_id that has them.  A shard
sorts its suffixes to `width` bytes; neighbours that share `width` bytes hold one string, and the smallest doc_id of
such a stretch decides.  One bit per string goes back to the group.

An anchor of HOT_RUNS runs or more is hot: its runs are cut into single strings, each of which goes to the shard that its
own hash names, once a group.  So the edges of a passage that many documents have are spread over all shards.

Nulls count as empty.  Copies of a string within one document, or in rows of one doc_id, stay.  A null doc_id counts as larger
than any other.  Strings are judged on the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import common as c
from .induced import MEMORY, SENTINEL, SEPARATOR, SHIFT, suffix_array

WIDTH = 50
ANCHOR = 16
SHARD_BYTES = 3 << 20
HOT_RUNS = SHARD_BYTES // 128
FEW = 8  # a group reports no fewer runs of an anchor
LAST_ID = np.iinfo(np.int64).max
U = np.uint64


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    h, step = c.byte_values(5)[data], 1
    while step < ANCHOR:
        h = h[:-step] * U(0x9E3779B97F4A7C15 ^ step << 7) + h[step:]
        step *= 2
    return c.mix(h)


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    step = 1
    while step * 2 <= w:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (w - step)], h[w - step :]) if w > step else h


def anchors(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the `width`-byte strings that lie in one document, their anchors' positions (ascending), and the hashes of all places."""
    if len(data) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, w = _anchor_hashes(data), width - ANCHOR + 1
    low = _sliding_min(h, w)
    fine = np.ones(len(low), bool)
    for o in off[1:-1]:
        fine[max(0, o - width + 1) : o] = False
    at = np.flatnonzero(fine)
    # the anchor is the first place at or after a string's start that has the string's least value
    hits = _places(h, low)
    mask = np.zeros(len(h), np.int32)
    mask[hits] = 1
    j = (np.cumsum(mask, dtype=np.int32) - mask)[at]
    got = hits[j]
    wrong = np.flatnonzero(h[got] != low[at])
    while len(wrong):
        j[wrong] += 1
        got[wrong] = hits[np.minimum(j[wrong], len(hits) - 1)]
        wrong = wrong[h[got[wrong]] != low[at[wrong]]]
    return at, got, h


def _places(h: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Positions whose hash is the least of some window over them."""
    w = len(h) - len(low) + 1
    pad = np.zeros(w - 1, np.uint64)
    x, step = np.r_[pad, low, pad], 1
    while step * 2 <= w:
        x = np.maximum(x[:-step], x[step:])
        step *= 2
    x = np.maximum(x[: len(x) - (w - step)], x[w - step :]) if w > step else x
    return np.flatnonzero(x == h)


class Group:
    """The distinct texts of a group; `ids` has the smallest doc_id of each."""

    def __init__(self, t: pa.Table, width: int):
        c.trim()
        self.t, self.width = t, width
        col = t.column("text").combine_chunks()
        col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
        coded = pc.fill_null(col, "").dictionary_encode()
        order = pc.sort_indices(coded.dictionary)  # whatever order the rows came in
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        self.text = place[coded.indices.to_numpy()]
        self.data, self.off = c.flat(coded.dictionary.take(order))
        self.row_ids = pc.fill_null(t.column("doc_id"), LAST_ID).to_numpy()
        self.ids = np.full(len(order), LAST_ID)
        np.minimum.at(self.ids, self.text, self.row_ids)

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, "right") - 1

    def _anchored(self, first: int, stop: int) -> tuple[np.ndarray, ...]:
        """Starts, lengths, anchors and anchor hashes of the runs in some of the texts."""
        o = self.off[first]
        at, where, h = anchors(self.data[o : self.off[stop]], self.off[first : stop + 1] - o, self.width)
        new = np.r_[True, (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1)] if len(at) else np.zeros(0, bool)
        lo = np.flatnonzero(new)
        return at[lo] + o, np.diff(np.r_[lo, len(at)]), where[lo] + o, h[where[lo]]

    def anchor_keys(self):
        """Distinct anchor hashes, whether two documents here have them, and each run's index among them; a run is of strings with one anchor."""
        runs = [self._anchored(*x) for x in c.cuts(np.diff(self.off))]  # a few texts at a time: the arrays over all bytes are many
        self.start, self.n, place, h = (np.concatenate(x) for x in zip(*runs)) if runs else (np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64))
        keys, inv, _ = c.distinct(h)
        first = np.full(len(keys), LAST_ID)
        ids = self.ids[self.doc(place)]
        np.minimum.at(first, inv, ids)
        many = np.zeros(len(keys), bool)
        many[inv[ids != first[inv]]] = True
        return keys, many, inv

    def runs(self, hit: np.ndarray, anchor: np.ndarray, hot: np.ndarray):
        """Of the candidate runs, those of hot anchors as single strings: starts, lengths, index among the distinct ones, and the hashes that name their shards."""
        start, n, shard, hot = self.start[hit], self.n[hit], anchor[hit], hot[hit]
        if hot.any():
            cut = c.ragged(start[hot], n[hot])
            own = c.span_names(self.data, cut, cut + self.width, 8)
            start, n, shard = np.r_[start[~hot], cut], np.r_[n[~hot], np.ones(len(cut), n.dtype)], np.r_[shard[~hot], own]
        _, inv, _ = c.distinct(self._two_names(start, n))
        return start, n, inv, shard

    def _two_names(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.stack([c.span_names(self.data, start, start + n + self.width - 1, seed) for seed in (6, 7)], 1)

    def lowest(self, start: np.ndarray, inv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One run and the smallest doc_id of each distinct run."""
        k = int(inv.max()) + 1 if len(inv) else 0
        one, low = np.zeros(k, np.int64), np.full(k, LAST_ID)
        one[inv] = np.arange(len(inv))
        np.minimum.at(low, inv, self.ids[self.doc(start)])
        return one, low


def by_shard(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs in order of their shards, and each shard's first and last."""
    order = np.argsort(of, kind="stable")
    lo = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0])
    return order, lo, np.r_[lo[1:], len(order)]


def with_counts(rows: pa.RecordBatch, keys: np.ndarray, counts: np.ndarray, least: int) -> pa.RecordBatch:
    """key_rows() whose `many` ends in (index, count) of the row's keys that have `least` runs or more."""
    out = []
    for blob, many in zip(rows.column("keys").to_pylist(), rows.column("many").to_pylist()):
        n = counts[np.searchsorted(keys, np.frombuffer(blob, np.uint64))]
        i = np.flatnonzero(n >= least)
        out.append(many + np.stack([i, n[i]], 1).astype(np.int32).tobytes())
    return rows.set_column(rows.schema.get_field_index("many"), "many", pa.array(out, pa.binary()))


def _answer(hot: int):
    """c.answer(1), and as kind 1 which keys have `hot` runs or more in all groups together."""
    plain = c.answer(1)

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        out = plain(t)
        keys = [np.frombuffer(x, np.uint64) for x in t.column("keys").to_pylist()]
        told = [np.frombuffer(x[(len(k) + 7) // 8 :], np.int32).reshape(-1, 2) for k, x in zip(keys, t.column("many").to_pylist())]
        some, inv, _ = c.distinct(np.concatenate([k[x[:, 0]] for k, x in zip(keys, told)]))
        big = some[np.bincount(inv, weights=np.concatenate([x[:, 1] for x in told]), minlength=len(some)) >= hot]
        if not len(big):
            return out
        bits = [np.isin(k, big) for k in keys]
        more = pa.table([t.column("g"), pa.array(np.ones(len(bits), np.int32)), t.column("b"), pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())], names=["g", "kind", "b", "bits"])
        return pa.concat_tables([out, more.filter(pa.array([bool(x.any()) for x in bits]))])

    return run


RUNS = "b int, g int, kind int, n binary, low binary, bytes binary"
_RUNS = pa.schema([("b", pa.int32()), ("g", pa.int32()), ("kind", pa.int32()), ("n", pa.binary()), ("low", pa.binary()), ("bytes", pa.binary())])


def sort_shard(n: np.ndarray, low: np.ndarray, raw: np.ndarray, width: int, memory: int = MEMORY) -> np.ndarray:
    """For every string of every run, the smallest doc_id of a run that has it."""
    length = n + width - 1
    ends = np.cumsum(length)
    size = len(raw) + len(n)
    kind = np.uint8 if not len(raw) or int(raw.max()) + SHIFT < 255 else np.uint16
    t = np.full(size + 1, SEPARATOR, kind)
    t[np.arange(len(raw)) + np.repeat(np.arange(len(n), dtype=np.int32), length)] = raw.astype(kind) + kind(SHIFT)
    t[size] = SENTINEL
    sa, shared = suffix_array(t, width, memory)
    base = np.cumsum(n) - n
    string = np.full(size + 1, -1, np.int32)  # of the places where a string starts, its number
    string[c.ragged(ends - length + np.arange(len(n)), n)] = np.arange(int(n.sum()))
    out = np.empty(int(n.sum()), np.int64)
    low = np.repeat(low, n)
    for lo, hi in stretches(shared, width):
        k = string[sa[lo:hi]]
        ok = k >= 0
        k, run = k[ok], np.cumsum(shared[lo:hi] < width)[ok]
        if not len(k):
            continue
        new = np.r_[True, run[1:] != run[:-1]]
        out[k] = np.minimum.reduceat(low[k], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def stretches(shared: np.ndarray, width: int, most: int = 1 << 20):
    """Parts of a suffix array that end where neighbours share less than `width`."""
    at = 0
    while at < len(shared):
        stop = at
        while True:
            lo, stop = max(stop, at + 1), min(len(shared), max(stop, at + 1) + most)
            cut = np.flatnonzero(shared[lo:stop] < width)
            if stop == len(shared) or len(cut):
                break
        stop = len(shared) if stop == len(shared) else lo + int(cut[-1])
        yield at, stop
        at = stop


def _shard(width: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        if t.column("b")[0].as_py() < 0:
            return pa.table([t.column("g"), t.column("kind"), t.column("b"), t.column("bytes")], names=["g", "kind", "b", "bits"])
        ns = [np.frombuffer(x, np.int16) for x in t.column("n").to_pylist()]
        n = np.concatenate(ns).astype(np.int64)
        low = np.frombuffer(b"".join(t.column("low").to_pylist()), np.int64)
        raw, _ = c.flat(t.column("bytes"))
        # equal runs of several groups are sorted once
        length = n + width - 1
        start = np.cumsum(length) - length
        _, inv, _ = c.distinct(np.stack([c.span_names(raw, start, start + length, s) for s in (6, 7)], 1))
        k = int(inv.max()) + 1
        one, least = np.zeros(k, np.int64), np.full(k, LAST_ID)
        one[inv] = np.arange(len(inv))
        np.minimum.at(least, inv, low)
        best = sort_shard(n[one], least, raw[c.ragged(start[one], length[one])], width)
        base = np.cumsum(n[one]) - n[one]
        hit = best[c.ragged(base[inv], n)] < np.repeat(low, n)
        at = np.cumsum([0] + [int(x.sum()) for x in ns])
        bits = [np.packbits(hit[i:j]).tobytes() for i, j in zip(at, at[1:])]
        return pa.table([t.column("g"), t.column("kind"), t.column("b"), pa.array(bits, pa.binary())], names=["g", "kind", "b", "bits"])

    return run


def _out(full: bool) -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + ([("kept", pa.binary()), ("spans", pa.list_(pa.int32()))] if full else []))


def cleaned(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs, its other columns as they are, without repeated strings; a character goes when all its bytes go, n_chars follows, and texts that become empty go."""
    carry = tuple(x for x in docs.columns if x not in ("doc_id", "text"))
    out = remove_repeats(docs, width, carry=carry).where("n_removed = 0 OR kept_text <> ''")
    text = F.when(F.col("was_null"), None).otherwise(F.col("kept_text"))
    new = {"text": text} | ({"n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars"))} if "n_chars" in carry else {})
    return out.select(*(new.get(x, F.col(x)).cast(docs.schema[x].dataType).alias(x) for x in docs.columns))


def remove_repeats(docs: DataFrame, width: int = WIDTH, texts: bool = True, carry: tuple[str, ...] | None = None, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with texts also kept (bytes) and spans (start, end, start, ...); with carry instead the carried columns, kept_text and was_null."""
    total = c.text_bytes(docs)
    g = c.grouped_by_text(docs, total, carry or ())
    texts = texts and carry is None
    buckets, shards = max(64, total // (16 << 20)), max(64, total // SHARD_BYTES)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<int>" if texts else "")
    arrow = _out(texts)
    if carry is not None:
        schema += ", kept_text string, was_null boolean" + "".join(f", `{x}` {docs.schema[x].dataType.simpleString()}" for x in carry)

    def send_anchors(t: pa.Table) -> pa.Table:
        keys, many, anchor = Group(t, width).anchor_keys()
        rows = c.key_rows(t.column("g")[0].as_py(), 0, keys, many, buckets)
        return pa.Table.from_batches([with_counts(rows, keys, np.bincount(anchor, minlength=len(keys)), min(FEW, hot_runs))])

    def send_runs(t: pa.Table, rows: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _RUNS.empty_table()
        x, own = Group(t, width), t.column("g")[0].as_py()
        keys, _, anchor = x.anchor_keys()
        hit = c.flags(rows, 0, keys, buckets)[anchor]
        out = {k: [] for k in _RUNS.names}
        note = [np.zeros(0, np.uint8)]
        if hit.any():
            start, n, inv, shard = x.runs(hit, keys[anchor], c.flags(rows, 1, keys, buckets)[anchor])
            one, low = x.lowest(start, inv)
            of = c.bucket_of(shard[one], shards).astype(np.int32)
            order, lo, hi = by_shard(of)
            for i, j in zip(lo, hi):
                pick = order[i:j]
                s, m = start[one[pick]], n[one[pick]]
                for k, v in zip(_RUNS.names, (int(of[pick[0]]), own, 1, m.astype(np.int16).tobytes(), low[pick].tobytes(), x.data[c.ragged(s, m + width - 1)].tobytes())):
                    out[k].append(v)
            note = [np.array([len(start)], np.int64), start.astype(np.int32), n.astype(np.int16), inv.astype(np.int32), of]
        for k, v in zip(_RUNS.names, (-1 - own, own, 2, b"", b"", b"".join(v.tobytes() for v in note))):
            out[k].append(v)
        return pa.table(out, schema=_RUNS)

    def removed(x: Group, rows: pa.Table) -> np.ndarray:
        """Mask of the bytes of the group's texts that go, for the smallest doc_id of each text."""
        kinds, bits = rows.column("kind").to_pylist(), rows.column("bits").to_pylist()
        note = bits[kinds.index(2)] if 2 in kinds else b""
        if not note:
            return np.zeros(len(x.data), bool)
        k = int(np.frombuffer(note, np.int64, 1)[0])
        start, n, inv = np.frombuffer(note, np.int32, k, 8).astype(np.int64), np.frombuffer(note, np.int16, k, 8 + 4 * k).astype(np.int64), np.frombuffer(note, np.int32, k, 8 + 6 * k).astype(np.int64)
        of = np.frombuffer(note, np.int32, -1, 8 + 10 * k)
        one, low = x.lowest(start, inv)
        order, lo, hi = by_shard(of)
        got = {b: v for kind, b, v in zip(kinds, rows.column("b").to_pylist(), bits) if kind == 1}
        mine = n[one]
        base = np.cumsum(mine) - mine
        less = np.zeros(int(mine.sum()), bool)  # a smaller doc_id than any of this run in this group has the string
        for i, j in zip(lo, hi):
            idx = c.ragged(base[order[i:j]], mine[order[i:j]])
            less[idx] = np.unpackbits(np.frombuffer(got[int(of[order[i]])], np.uint8), count=len(idx)).astype(bool)
        bad = less[c.ragged(base[inv], n)] | np.repeat(x.ids[x.doc(start)] > low[inv], n)
        return c.covered(c.ragged(start, n)[bad], width, len(x.data))

    def finish(t: pa.Table, rows: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table([]) if carry is not None else arrow.empty_table()
        x = Group(t, width)
        gone = removed(x, rows)
        if carry is not None and gone.any():  # whole characters only
            heads = np.flatnonzero((x.data & 0xC0) != 0x80)
            gone = np.repeat(np.logical_and.reduceat(gone, heads), np.diff(np.r_[heads, len(gone)]))
        n, raw = np.diff(x.off), x.data.tobytes()
        total = np.r_[0, np.cumsum(gone)]
        cut_n = total[x.off[1:]] - total[x.off[:-1]]
        kept, sha, spans, count = [], [], [], np.zeros(len(n), np.int64)
        for i, (a, b) in enumerate(zip(x.off[:-1].tolist(), x.off[1:].tolist())):
            d = np.flatnonzero(np.diff(np.r_[0, gone[a:b].astype(np.int8), 0])) if cut_n[i] else np.zeros(0, np.int64)
            count[i] = len(d) // 2
            kept.append(raw[a:b] if not len(d) else x.data[a:b][~gone[a:b]].tobytes())
            sha.append(hashlib.sha256(kept[-1]).hexdigest())
            spans.append(d.astype(np.int32))
        # a copy of a text that a smaller doc_id has loses all of it, unless it is too short to hold a string
        copy = (x.row_ids > x.ids[x.text]) & (n[x.text] >= width)
        none = hashlib.sha256(b"").hexdigest()
        of = x.text.tolist()
        cols = [t.column("doc_id"), pa.array(n[x.text]), pa.array(np.where(copy, n[x.text], cut_n[x.text])), pa.array(np.where(copy, 1, count[x.text])), pa.array([none if y else sha[i] for i, y in zip(of, copy)], pa.string())]
        if carry is not None or texts:
            mine = pa.array([b"" if y else kept[i] for i, y in zip(of, copy)], pa.binary())
        if carry is not None:
            return pa.table(dict(zip(arrow.names, cols)) | {"kept_text": mine.cast(pa.string()), "was_null": t.column("text").is_null()} | {k: t.column(k) for k in carry})
        more = [mine, pa.array([np.array([0, n[i]], np.int32) if y else spans[i] for i, y in zip(of, copy)], pa.list_(pa.int32()))] if texts else []
        return pa.Table.from_arrays(cols + more, schema=arrow)

    bits = g.groupBy("g").applyInArrow(send_anchors, c.KEYS).groupBy("b").applyInArrow(_answer(hot_runs), c.BITS)
    runs = g.groupBy("g").cogroup(bits.groupBy("g")).applyInArrow(send_runs, RUNS)
    back = runs.groupBy("b").applyInArrow(_shard(width), c.BITS)
    return g.groupBy("g").cogroup(back.groupBy("g")).applyInArrow(finish, schema)
