"""Shared pieces: whole texts as flat byte arrays, content hashes, grouping of documents, counting of keys.

The exact deduplicators share one exchange.  Documents are dealt to *groups* of a few MB.  A group sends each
bucket one blob of its distinct keys (so a key that a third of all rows hold arrives once per group), the bucket
answers with one bit per key, and the group's texts, still in the same shuffle output, meet those bits.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

GROUP_BYTES = 3 << 20
SLICE_BYTES = 1 << 18
U = np.uint64
_M1, _M2, _BASE = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15 | 3)


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder.  Only a local master, as in tests, may name none; on a cluster its executors share no other folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        top = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{top}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def plainly(stage: Callable[[DataFrame], DataFrame], docs: DataFrame) -> DataFrame:
    """stage(docs) for a stage that keeps all columns, with columns other than a document's under names that clash with nothing."""
    names = {c: f"_extra{i}" for i, c in enumerate(docs.columns) if c not in DOCUMENT}
    out = stage(docs.withColumnsRenamed(names)) if names else stage(docs)
    return out.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def text_bytes(df: DataFrame, col: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(F.col(col))).alias("b")).first()["b"] or 0)


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if off is not None and len(off) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def cuts(lengths: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer row stands alone."""
    lo, got = 0, 0
    for i, n in enumerate(lengths):
        if got and got + n > limit:
            yield lo, i
            lo, got = i, 0
        got += int(n)
    if lo < len(lengths):
        yield lo, len(lengths)


_trim: list = []


def trim() -> None:
    """Gives memory that freed arrays and batches have left in this worker back to the system, where the libraries can."""
    if not _trim:
        import ctypes

        try:
            _trim.append(ctypes.CDLL("libc.so.6").malloc_trim)
        except (OSError, AttributeError):
            _trim.append(lambda _: 0)
    pa.default_memory_pool().release_unused()
    _trim[0](0)


def slices(batches: Iterator[pa.RecordBatch], col: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = pc.fill_null(pc.binary_length(b.column(col)), 0).to_numpy(zero_copy_only=False)
        for lo, hi in cuts(n, limit):
            yield b.slice(lo, hi - lo)
        trim()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def mixed(x: int) -> int:
    return int(mix(np.array([x], np.uint64))[0])


LONG_SPAN = 128


def span_names(data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit name of the bytes of each span: eight bytes after another go through a mixer, spans of over LONG_SPAN bytes through xxh3."""
    n = e - s
    out = np.full(len(s), mixed(seed + 77), np.uint64) ^ (n.astype(np.uint64) * _BASE)
    if not len(s):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), np.uint64, padded.data, 0, (1,))
    short = n <= LONG_SPAN
    live = np.flatnonzero(short) if not short.all() else None
    at, left = (s, n) if live is None else (s[live], n[live])
    while len(at):
        v = lanes[at] & _FIRST[np.minimum(left, 8)]
        if live is None:
            out = mix(out * _BASE ^ v)
            live = np.arange(len(s))
        else:
            out[live] = mix(out[live] * _BASE ^ v)
        go = left > 8
        live, at, left = live[go], at[go] + 8, left[go] - 8
    if not short.all():
        import xxhash

        raw = memoryview(data)
        for i in np.flatnonzero(~short).tolist():
            out[i] = xxhash.xxh3_64_intdigest(raw[s[i] : e[i]], seed + 1)
    return out


_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first bytes of a lane


class Windows:
    """Names of windows of a value sequence: windows of 1, 2, 4, ... values are named from two halves, each through a mixer, and any
    window from the two largest of those that cover it, with its length."""

    def __init__(self, values: np.ndarray, width: int, seed: int = 0):
        self.levels, step = [mix(values * _BASE + U(mixed(seed + 5)))], 1
        while 2 * step <= width:
            h = self.levels[-1]
            self.levels.append(mix(h[: max(0, len(h) - step)] * _BASE ^ (h[step:] + U(mixed(seed + step)))))
            step *= 2

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Lengths lie between 0 and the width."""
        if isinstance(length, int):
            k = length.bit_length() - 1
            h = self.levels[k]
            return mix(h[start] * U(length | 1) ^ (h[start + length - (1 << k)] + U(length)))
        out = np.full(len(start), _M1, np.uint64)
        for k, h in enumerate(self.levels):
            rows = np.flatnonzero((length >> k) == 1)
            if len(rows):
                a, n = start[rows], length[rows]
                m = n.astype(np.uint64)
                out[rows] = mix(h[a] * (m | U(1)) ^ (h[a + n - (1 << k)] + m))
        return out


def text_names(data: np.ndarray, off: np.ndarray, lower: bool = False) -> np.ndarray:
    """128 bits (two columns) of each text's word sequence, from its words joined by one blank."""
    import xxhash

    raw = data.tobytes()
    if lower:
        raw = raw.lower()  # of bytes: A to Z only
    got = b"".join(xxhash.xxh3_128_digest(b" ".join(raw[a:b].split())) for a, b in zip(off[:-1].tolist(), off[1:].tolist()))
    return np.frombuffer(got, np.int64).reshape(-1, 2)


_byte_values: dict[int, np.ndarray] = {}


def byte_values(seed: int) -> np.ndarray:
    if seed not in _byte_values:
        _byte_values[seed] = mix(np.arange(1, 257, dtype=np.uint64) * _BASE + U(seed))
    return _byte_values[seed]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document ordinals of the words [^\\x20\\x09-\\x0D]+ ; no word crosses a document."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
    return span_names(data, s, e, seed)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + length[i] - 1 of all i, one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - length), length)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the positions inside [s, s + width) for any of the starts."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1) if len(starts) < 64 else d.__iadd__(np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int32))
    ends = starts + width
    d -= np.bincount(ends, minlength=n + 1)[: n + 1].astype(np.int32) if len(ends) else 0
    return np.cumsum(d[:n]) > 0


# ---------------------------------------------------------------- groups and buckets


def grouped(docs: DataFrame, total: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(g, doc_id, text) and the carried columns, dealt out by g.  Used several times in one plan, its exchange runs once."""
    n = max(1, math.ceil(total / GROUP_BYTES))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (32 << 20)))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    return d.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartition(parts, "g")


HOT_BYTES = 8 << 20
HOT_TEXTS = 1_000_000


def grouped_by_text(docs: DataFrame, total: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """As grouped(), but copies of a text share a group, so that a group reads each text once.

    Copies of one text that together exceed HOT_BYTES, or a millionth of the corpus if that is more, are split over several groups
    by their ids; so at most HOT_TEXTS hashes are broadcast.
    """
    n = max(1, math.ceil(total / GROUP_BYTES))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (32 << 20)))
    most = max(HOT_BYTES, total // HOT_TEXTS)
    h = F.xxhash64(F.col("text").cast("string"))
    hot = docs.groupBy(h.alias("h")).agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("bytes")).where(F.col("bytes") > most)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry).withColumn("h", h).join(F.broadcast(hot), "h", "left")
    sub = F.when(F.col("bytes").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("bytes") / most))).otherwise(0)
    return d.withColumn("g", F.pmod(F.xxhash64("h", sub), F.lit(n)).cast("int")).drop("h", "bytes").repartition(parts, "g")


def in_order(t: pa.Table) -> pa.Table:
    """A group's rows in an order that the contents fix, whatever order a shuffle read them in."""
    if t.num_rows < 2:
        return t
    ids = t.column("doc_id").fill_null(0).to_numpy()
    if t.column("doc_id").null_count or len(np.unique(ids)) < len(ids):
        rows = sorted(range(t.num_rows), key=lambda i: ((v := t.column("doc_id")[i].as_py()) is not None, v or 0, (w := t.column("text")[i].as_py()) is not None, w or ""))
        return t.take(pa.array(rows))
    return t.take(pa.array(np.argsort(ids)))


KEYS = "b int, g int, kind int, keys binary, many binary"
BITS = "g int, kind int, b int, bits binary"


def key_rows(g: int, kind: int, keys: np.ndarray, many: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket from sorted distinct keys (one or two 64-bit columns) and their 'more than once here'."""
    first = keys if keys.ndim == 1 else keys[:, 0]
    b = bucket_of(first, buckets)
    order = np.argsort(b, kind="stable")
    b, keys, many = b[order], keys[order], many[order]
    lo = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    hi = np.r_[lo[1:], len(b)]
    return pa.record_batch(
        [
            pa.array(b[lo].astype(np.int32)), pa.array(np.full(len(lo), g, np.int32)), pa.array(np.full(len(lo), kind, np.int32)),
            pa.array([keys[i:j].tobytes() for i, j in zip(lo, hi)], pa.binary()), pa.array([np.packbits(many[i:j]).tobytes() for i, j in zip(lo, hi)], pa.binary()),
        ],
        names=["b", "g", "kind", "keys", "many"],
    )


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> U(20)) % U(buckets)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the index of each input key among them, and counts; keys have one or two columns."""
    if keys.ndim == 1:
        u, inv, n = np.unique(keys, return_inverse=True, return_counts=True)
        return u, inv, n
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    k = keys[order]
    new = np.r_[True, (k[1:] != k[:-1]).any(1)] if len(k) else np.zeros(0, bool)
    inv = np.empty(len(k), np.int64)
    inv[order] = np.cumsum(new) - 1
    return k[new], inv, np.bincount(inv, minlength=int(new.sum()))


def answer(width: int) -> Callable[[pa.Table], pa.Table]:
    """For one bucket: which keys come from two groups, or more than once from one."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        blobs = t.column("keys").to_pylist()
        keys = np.frombuffer(b"".join(blobs), np.uint64)
        keys = keys.reshape(-1, width) if width > 1 else keys
        sizes = np.array([len(x) // (8 * width) for x in blobs])
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(t.column("many").to_pylist(), sizes)]).astype(bool)
        _, inv, n = distinct(keys)
        again = n > 1
        again |= np.bincount(inv, weights=many, minlength=len(n)) > 0
        hit = again[inv]
        at = np.r_[0, np.cumsum(sizes)]
        bits = [np.packbits(hit[i:j]).tobytes() for i, j in zip(at, at[1:])]
        return pa.table([t.column("g"), t.column("kind"), t.column("b"), pa.array(bits, pa.binary())], names=["g", "kind", "b", "bits"])

    return run


def flags(rows: pa.Table, kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bits that came back, as a mask over the sorted distinct keys that this group sent."""
    out = np.zeros(len(keys), bool)
    b = bucket_of(keys if keys.ndim == 1 else keys[:, 0], buckets)
    order = np.argsort(b, kind="stable")
    at = np.searchsorted(b[order], np.arange(buckets + 1, dtype=np.uint64)) if len(b) < buckets * 50 else np.r_[0, np.cumsum(np.bincount(b.astype(np.int64), minlength=buckets))]
    for k, x, bits in zip(rows.column("kind").to_pylist(), rows.column("b").to_pylist(), rows.column("bits").to_pylist()):
        if k == kind:
            i, j = at[x], at[x + 1]
            out[order[i:j]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(j - i)).astype(bool)
    return out


def per_doc(ids: pa.Array, **cols) -> pa.Table:
    return pa.table({"doc_id": ids, **cols})
