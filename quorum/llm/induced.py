"""Suffix sorting by external induction, to a bounded depth, with common-prefix values.

Suffixes at left-most S positions are sorted first; all others are induced from them.  Induction runs over one priority
queue per direction whose priority is (first symbol, order of arrival): entries carry the suffix and the prefix length
that it shares with the entry before it, which is one more than the least such value between the two suffixes that
induced them.  Queues work on whole blocks of entries and move to disk beyond their memory budget.

A text that with all its arrays (EACH bytes a symbol) fits the budget is sorted in memory: LMS substrings are named, and the string of names is
sorted in turn, induced again while names are few.  A larger one is sorted from disk: types, LMS positions, the sorted LMS suffixes and the result are
files that blocks pass through, and LMS suffixes, which need no names to be compared to the bounded depth, go through an
external merge sort.  Memory then follows the budget and not the text, which may be a memory map itself.

Files are scratch of one task, in the folders where Spark spills too, and go with it.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

SEPARATOR, SENTINEL, SHIFT = 1, 0, 2
BLOCK = 1 << 16
MEMORY = 256 << 20
EACH = 32
LEAST_ROWS = 1 << 13


def _scratch():
    """An open file without a name, where Spark has its spill files."""
    folder = os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0]
    return tempfile.TemporaryFile(prefix="suffixes-", dir=folder if os.path.isdir(folder) else None)


def _on_disk(n: int, kind) -> np.ndarray:
    """An array of n values in a scratch file."""
    kind = np.dtype(kind)
    f = _scratch()
    f.truncate(max(1, n) * kind.itemsize)
    return np.memmap(f, kind, "r+", shape=(max(1, n),))[:n]


class DiskQueue:
    """First in, first out for each symbol; beyond `memory` bytes, the fullest symbol's entries are appended to disk as one block.

    Popped entries stay, since the second pass reads the first one's backwards.
    """

    def __init__(self, symbols: int, memory: int = MEMORY):
        self.blocks: list[list] = [[] for _ in range(symbols)]
        self.held, self.most = np.zeros(symbols, np.int64), memory
        self.total = 0
        self.taken = [0] * symbols  # blocks that a pop has read
        self.file = None

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks[symbol].append((pos, lcp))
        self.held[symbol] += pos.nbytes + lcp.nbytes
        self.total += pos.nbytes + lcp.nbytes
        if self.total > self.most:
            while self.total > self.most // 2:  # the fullest first, so that few large blocks are written
                self.spill(int(self.held.argmax()))

    def _write(self, part: list) -> list:
        """Blocks in memory, one after another, as one on disk."""
        held = [x for x in part if isinstance(x[0], np.ndarray)]
        kept = [x for x in part if not isinstance(x[0], np.ndarray)]  # those came before
        if held:
            pos, lcp = (np.concatenate(x) for x in zip(*held))
            at = self.file.seek(0, os.SEEK_END)
            self.file.write(pos.tobytes())
            self.file.write(lcp.tobytes())
            kept.append((at, len(pos), pos.dtype))
        return kept

    def spill(self, symbol: int) -> None:
        if self.file is None:
            self.file = _scratch()
        q, k = self.blocks[symbol], self.taken[symbol]
        read = self._write(q[:k])
        q[:] = read + self._write(q[k:])
        self.taken[symbol] = len(read)
        self.total -= int(self.held[symbol])
        self.held[symbol] = 0

    def _load(self, x, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(x[0], np.ndarray):
            return x[0][lo:hi], x[1][lo:hi]
        at, n, kind = x
        hi = n if hi is None else min(hi, n)
        self.file.seek(at + lo * kind.itemsize)
        pos = np.frombuffer(self.file.read((hi - lo) * kind.itemsize), kind)
        self.file.seek(at + n * kind.itemsize + lo)
        return pos, np.frombuffer(self.file.read(hi - lo), np.uint8)

    @staticmethod
    def _size(x) -> int:
        return len(x[0]) if isinstance(x[0], np.ndarray) else x[1]

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks in order of arrival, including those that arrive meanwhile; small ones are joined up to BLOCK entries."""
        q = self.blocks[symbol]
        while self.taken[symbol] < len(q):
            x = q[self.taken[symbol]]
            if self._size(x) >= BLOCK:
                self.taken[symbol] += 1
                for k in range(0, self._size(x), BLOCK):
                    yield self._load(x, k, k + BLOCK)
                continue
            parts, n = [], 0
            while self.taken[symbol] < len(q) and n + self._size(q[self.taken[symbol]]) <= BLOCK:
                parts.append(self._load(q[self.taken[symbol]]))
                n += len(parts[-1][0])
                self.taken[symbol] += 1
            yield tuple(np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]

    def backwards(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of at most BLOCK entries, the last first; each in order of arrival."""
        for x in reversed(list(self.blocks[symbol])):
            for k in range((self._size(x) - 1) // BLOCK * BLOCK, -1, -BLOCK):
                yield self._load(x, k, k + BLOCK)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _words(t: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Four symbols from each position as one number; beyond `left` symbols the largest value, which puts a longer LMS substring before its prefix."""
    out = np.zeros(len(at), np.uint64)
    last = len(t) - 1
    for k in range(4):
        v = t[np.minimum(at + k, last)].astype(np.uint64)
        out = (out << np.uint64(16)) | np.where(left > k, v, np.uint64(0xFFFF))
    return out


def _dense(*keys: np.ndarray) -> np.ndarray:
    key = keys[0]
    for k in keys[1:]:
        key = (key.astype(np.uint64) << np.uint64(32)) | np.unique(k, return_inverse=True)[1].astype(np.uint64)
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def _names(t: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the LMS substrings, to the given depth."""
    left = np.minimum(np.r_[lms[1:] - lms[:-1] + 1, 1], depth)
    rank = _dense(_words(t, lms, left))
    alive, k = np.flatnonzero(left > 4), 4
    while len(alive):
        # rows that share a rank with a longer substring are told apart by the next four symbols
        group = np.zeros(int(rank.max()) + 1, bool)
        group[rank[alive]] = True
        rows = np.flatnonzero(group[rank])
        sub = _dense(rank[rows], _words(t, lms[rows] + k, left[rows] - k))
        scale = np.zeros(len(group), np.int64)  # distinct new ranks in each old one
        first = np.full(int(sub.max()) + 1, -1, np.int64)
        first[sub] = rank[rows]
        np.add.at(scale, first, 1)
        size = np.where(group, scale, 1)
        base = np.cumsum(size) - size
        lowest = np.full(len(group), np.iinfo(np.int64).max)
        np.minimum.at(lowest, first, np.arange(len(first)))
        new = base[rank]
        new[rows] = base[rank[rows]] + sub - lowest[rank[rows]]
        rank = new
        k += 4
        alive = alive[left[alive] > k]
    return rank


def _order(r: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a string of names, sorted to `depth` names: induced again while names are few, else by doubling."""
    if len(r) > 64 * (int(r.max()) + 1) and depth > 4 and int(r.max()) + SHIFT < 0xFFFF:  # as many names as _words() tells apart
        sa, _ = suffix_array(np.r_[r + SHIFT, SENTINEL].astype(np.uint16), depth)
        return sa[1:]
    rank, h = r, 1
    while h < depth and int(rank.max()) < len(r) - 1:
        nxt = np.zeros(len(r), np.uint64)
        nxt[: len(r) - h] = rank[h:].astype(np.uint64) + np.uint64(1)
        rank = np.unique((rank.astype(np.uint64) << np.uint64(32)) | nxt, return_inverse=True)[1].astype(np.int64)
        h *= 2
    return np.argsort(rank, kind="stable")


def _shared(t: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a[i] and b[i], at most depth; eight bytes of symbols at a time."""
    per = 8 // t.itemsize
    padded = np.concatenate([t, np.zeros(depth + 8, t.dtype)])
    word = np.ndarray((len(padded) - per,), np.uint64, padded.view(np.uint8).data, 0, (t.itemsize,))
    out = np.zeros(len(a), np.uint8)
    live, k = np.arange(len(a)), 0
    a, b = a.astype(np.int64), b.astype(np.int64)
    while k < depth and len(live):
        x = word[a + k] ^ word[b + k]
        same = x == 0
        low = x & (~x + np.uint64(1))  # the lowest bit that differs
        bit = np.log2(np.where(same, 1, low).astype(np.float64)).astype(np.int64)
        out[live] = np.minimum(k + np.where(same, per, bit // (8 * t.itemsize)), depth)
        live, a, b = live[same], a[same], b[same]
        k += per
    return out


def _run(t: np.ndarray, p: int, most: int) -> int:
    part = t[p : p + most]
    d = np.flatnonzero(part != part[0])
    return int(d[0]) if len(d) else len(part)


class _Induce:
    def __init__(self, t: np.ndarray, s_type: np.ndarray, want: bool, symbols: int, depth: int, memory: int):
        self.t, self.s, self.want, self.depth = t, s_type, want, depth
        self.queue = DiskQueue(symbols, memory)
        self.carry = np.zeros(symbols, np.uint8)  # least value since a symbol's last entry; 0 before the first
        self.seen = np.zeros(symbols, bool)

    def feed(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Entries in their order; lcp[i] is shared with the entry before."""
        q = pos - 1
        ok = np.flatnonzero((pos > 0) & (self.s[q] == self.want))
        low = lcp.min()
        carry = np.minimum(self.carry, low)
        if len(ok):
            ch = self.t[q[ok]]
            order = np.argsort(ch, kind="stable")
            at = ok[order]
            count = np.bincount(ch)
            i, size = 0, len(lcp)
            ends = np.zeros(len(ok) + 1, np.int64)
            for x in np.flatnonzero(count).tolist():
                m = int(count[x])
                idx = at[i : i + m]
                i += m
                np.add(idx, 1, out=ends[1 : m + 1])
                open_end = ends[m] < size
                seg = np.minimum.reduceat(lcp, ends[: m + open_end])
                got = np.minimum(seg[:m], self.depth - 1) + np.uint8(1)
                if self.seen[x]:
                    got[0] = min(int(seg[0]), int(self.carry[x]), self.depth - 1) + 1
                else:
                    got[0] = 0
                    self.seen[x] = True
                carry[x] = seg[m] if open_end else 255
                self.queue.push(x, q[idx], got)
        self.carry = carry


def _types(t: np.ndarray, new) -> np.ndarray:
    """Whether each suffix is smaller than the next one (S type), from the end in blocks."""
    n = len(t)
    s = new(n, bool)
    s[n - 1] = True
    after = True  # of the suffix behind the block
    for hi in range(n - 1, 0, -4 * BLOCK):
        lo = max(0, hi - 4 * BLOCK)
        part = t[lo : hi + 1]
        less, differ = part[:-1] < part[1:], part[:-1] != part[1:]
        k = hi - lo
        nxt = np.where(differ, np.arange(k), k)
        nxt = np.minimum.accumulate(nxt[::-1])[::-1]
        s[lo:hi] = np.r_[less, after][nxt]
        after = bool(s[lo])
    return s


def _lms(s: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of the S types that follow an L type, block by block."""
    for lo in range(0, len(s) - 1, 4 * BLOCK):
        part = s[lo : lo + 4 * BLOCK + 1]
        yield np.flatnonzero(part[1:] & ~part[:-1]) + lo + 1


def _prefixes(t: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The first `depth` symbols of suffixes, as byte strings that compare as the symbols do; past the end come zeros."""
    out = np.zeros((len(at), depth), t.dtype.newbyteorder(">"))
    last = len(t) - 1
    for k in range(depth):
        i = at + k
        out[:, k] = np.where(i <= last, t[np.minimum(i, last)], 0)
    return out.view(f"S{depth * t.itemsize}").ravel()


def _common(a: np.ndarray, b: np.ndarray, itemsize: int) -> np.ndarray:
    """Symbols that byte strings a[i] and b[i] share from the left."""
    width = a.dtype.itemsize
    if not len(a):
        return np.zeros(0, np.uint8)
    x = np.ascontiguousarray(a).view(np.uint8).reshape(-1, width) != np.ascontiguousarray(b).view(np.uint8).reshape(-1, width)
    first = np.where(x.any(1), x.argmax(1), width)
    return (first // itemsize).astype(np.uint8)


def _sorted_from_disk(t: np.ndarray, s: np.ndarray, depth: int, memory: int, kind) -> tuple[np.ndarray, np.ndarray]:
    """LMS suffixes sorted to `depth`, and what each shares with the one before: an external merge sort.

    Runs of prefixes are sorted in memory and written.  Ranges of keys, narrow enough for the budget, are then read from all runs
    at once; a prefix that is more frequent than that is a range of its own, whose suffixes need no order.
    """
    width = depth * t.itemsize
    rows = max(LEAST_ROWS, memory // (6 * width + 64))
    keys, places, m = [], [], 0

    def flush(parts):
        nonlocal m
        at = np.concatenate(parts)
        key = _prefixes(t, at, depth)
        order = np.argsort(key, kind="stable")
        k, p = _on_disk(len(at), f"S{width}"), _on_disk(len(at), kind)
        k[:], p[:] = key[order], at[order]
        keys.append(k)
        places.append(p)
        m += len(at)

    held, n = [], 0
    for part in _lms(s):
        for lo in range(0, len(part), rows):
            piece = part[lo : lo + rows]
            if n and n + len(piece) > rows:
                flush(held)
                held, n = [], 0
            held.append(piece)
            n += len(piece)
    if held:
        flush(held)
    seeds, shared = _on_disk(m, kind), _on_disk(m, np.uint8)
    step = max(1, m // (3 * (m // rows + 1)))
    cuts = np.unique(np.concatenate([k[::step] for k in keys])) if m else np.zeros(0, f"S{width}")
    begin, done, last = [0] * len(keys), 0, None

    def put(at: np.ndarray, key: np.ndarray):
        nonlocal done, last
        if not len(at):
            return
        before = np.r_[key[:1] if last is None else last, key[:-1]]
        got = _common(before, key, t.itemsize)
        if last is None:
            got[0] = 0
        seeds[done : done + len(at)], shared[done : done + len(at)] = at, got
        done, last = done + len(at), key[-1:].copy()

    def take(ends: list[int]):
        """All runs' rows up to their ends, in order."""
        size = sum(e - b for b, e in zip(begin, ends))
        if size <= rows:
            k = np.concatenate([np.asarray(x[b:e]) for x, b, e in zip(keys, begin, ends)])
            p = np.concatenate([np.asarray(x[b:e]) for x, b, e in zip(places, begin, ends)])
            order = np.argsort(k, kind="stable")
            put(p[order], k[order])
        else:  # between two neighbouring cuts only one key can be as frequent: it is split off
            low = min(x[b] for x, b, e in zip(keys, begin, ends) if b < e)
            mids = [b + int(np.searchsorted(x[b:e], low, "right")) if b < e else e for x, b, e in zip(keys, begin, ends)]
            if mids == ends:
                for x, p, b, e in zip(keys, places, begin, ends):
                    for i in range(b, e, rows):
                        put(np.asarray(p[i : min(e, i + rows)]), np.asarray(x[i : min(e, i + rows)]))
            else:
                halves = [b + (e - b) // 2 for b, e in zip(mids, ends)]
                widest = max(range(len(ends)), key=lambda i: ends[i] - mids[i])
                pivot = keys[widest][halves[widest]]
                splits = [mids, [b + int(np.searchsorted(x[b:e], pivot, "left")) for x, b, e in zip(keys, mids, ends)], [b + int(np.searchsorted(x[b:e], pivot, "right")) for x, b, e in zip(keys, mids, ends)], ends]
                for stop in splits:
                    take(stop)
                    begin[:] = stop
        begin[:] = ends

    for c in cuts:
        take([b + int(np.searchsorted(x[b:], c, "left")) for x, b in zip(keys, begin)])
    take([len(x) for x in keys])
    return seeds, shared


def _sorted_in_memory(t: np.ndarray, s: np.ndarray, depth: int, kind) -> tuple[np.ndarray, np.ndarray]:
    """LMS suffixes sorted to `depth`, and what each shares with the one before: by names and recursion."""
    lms = np.concatenate([np.zeros(0, np.int64), *_lms(s)])
    order = _order(_names(t, lms, depth), depth) if len(lms) > 1 else np.zeros(1, np.int64)
    seeds = lms[order].astype(kind)
    return seeds, np.r_[np.uint8(0), _shared(t, seeds[:-1], seeds[1:], depth)]


def suffix_array(t: np.ndarray, depth: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(positions, prefix shared with the one before, at most depth) of all suffixes of t, sorted to `depth` symbols.

    t ends in SENTINEL, its only 0.  Suffixes equal to that depth stand in any order.  Beyond the budget both results are maps of files.
    """
    n = len(t)
    kind = np.int32 if n < 1 << 31 else np.int64
    if n == 1:
        return np.zeros(1, kind), np.zeros(1, np.uint8)
    large = EACH * n > memory
    new = _on_disk if large else np.empty
    s = _types(t, new)
    symbols = int(t.max()) + 1
    seeds, seed_lcp = _sorted_from_disk(t, s, depth, memory // 4, kind) if large else _sorted_in_memory(t, s, depth, kind)
    count = np.zeros(symbols, np.int64)
    for k in range(0, len(seeds), BLOCK):
        count += np.bincount(t[seeds[k : k + BLOCK]], minlength=symbols)
    seed_at = np.r_[0, np.cumsum(count)]

    down = _Induce(t, s, False, symbols, depth, memory // 4)  # L types, ascending
    for x in range(symbols):
        last = None
        for pos, lcp in down.queue.pop(x):
            down.feed(pos, lcp)
            last = pos[-1]
        i, j = int(seed_at[x]), int(seed_at[x + 1])
        for k in range(i, j, BLOCK):
            pos, lcp = seeds[k : min(j, k + BLOCK)], seed_lcp[k : min(j, k + BLOCK)]
            if k == i:
                lcp = np.array(lcp)
                lcp[0] = 0 if last is None else min(_run(t, int(last), depth), _run(t, int(pos[0]), depth))
            down.feed(pos, lcp)
    del seeds, seed_lcp

    up = _Induce(t, s, True, symbols, depth, memory // 4)  # S types, descending; values are shared with the entry above
    sa, shared = new(n, kind), new(n, np.uint8)
    end = n
    below = 0
    for x in range(symbols - 1, -1, -1):
        above, first, above_l = None, True, False
        if x == SENTINEL:
            sa[0], shared[0] = n - 1, 0
            up.queue.blocks[x] = []
            break
        for pos, lcp in up.queue.pop(x):
            up.feed(pos, lcp)
            m = len(pos)
            sa[end - m : end] = pos[::-1]
            # lcp[k] is shared with the entry above, so it belongs to that entry as 'shared with the one before'
            if not first:
                shared[end] = lcp[0]
            shared[end - m + 1 : end] = lcp[1:][::-1]
            end, first, above = end - m, False, pos[-1]
        for pos, lcp in down.queue.backwards(x):
            m = len(pos)
            join = 0 if above is None else below if above_l else min(_run(t, int(above), depth), _run(t, int(pos[-1]), depth))
            up.feed(pos[::-1], np.r_[np.uint8(join), lcp[1:][::-1]])
            sa[end - m : end] = pos
            if above is not None:
                shared[end] = join
            shared[end - m + 1 : end] = lcp[1:]
            below, above_l = lcp[0], True
            end, above = end - m, pos[0]
        if above is not None:
            shared[end] = 0
    down.queue.close()
    up.queue.close()
    return sa, shared
