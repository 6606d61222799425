"""Packing documents into sequences: shortest-pack-first over the length histogram.

A document's ids (and an end id) are cut into pieces of the sequence length and a rest.  The histogram of piece
lengths, at most `size` rows whatever the corpus, goes to the driver, which places lengths longest first: each time into the packing
patterns with the most room (the shortest packs) that it fits, splitting a pattern's count where fewer pieces are left
than packs.  Pieces get ranks within their length, and a pattern's slots take pieces by rank.

Null and empty texts are the end id alone.  Repeated rows are packed each for itself; pieces that agree in doc_id, start and checksum are
told apart by nothing, so which of them takes which slot is open.  A text of any length is read in slices of whole texts and cut into pieces.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common as c
from .bpe import encoded, vocabulary

SIZE = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(n: int, size: int = SIZE) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    return [size] * (n // size) + [n % size] * (n % size > 0)


def pieces(docs: DataFrame, size: int = SIZE, ids: bool = False, path: str | None = None, special: bool = True) -> DataFrame:
    """The pieces of all documents; with ids also their ids.  Special tokens that a text spells are the library's, unless `special` is false."""
    path = path or vocabulary()
    schema = PIECES + (", ids array<int>" if ids else "")

    def run(batches):
        for _, b, _, _, tokens, at in encoded(batches, path, special=special):
            doc = b.column("doc_id").to_pylist()
            cols = [[] for _ in range(6)]
            ends = np.array([END_ID], np.int32)
            for d, i, j in zip(doc, at.tolist(), at[1:].tolist()):
                own = np.concatenate([tokens[i:j], ends]).astype("<u4")
                s = 0
                for n in cut(len(own), size):
                    for v, x in zip(cols, (d, s, n, zlib.crc32(own[s : s + n].tobytes()), len(own), own[s : s + n].astype(np.int32) if ids else None)):
                        v.append(x)
                    s += n
            arrays = [pa.array(v, pa.int64()) for v in cols[:5]] + ([pa.array(cols[5], pa.list_(pa.int32()))] if ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

    return docs.selectExpr("CAST(doc_id AS LONG) doc_id", "CAST(text AS STRING) text").mapInArrow(run, schema)


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of packing patterns that hold exactly the histogram's pieces."""
    room: dict[int, list[list]] = defaultdict(list)  # room left -> [count, lengths]
    spaces: list[int] = []
    done = []

    def put(space, count, lengths):
        if space == 0:
            done.append((count, lengths))
            return
        if not room[space]:
            spaces.append(space)
            spaces.sort()
        room[space].append([count, lengths])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = spaces[-1] if spaces and spaces[-1] >= length else size
            if space == size:
                fit = size // length
                full, rest = divmod(left, fit)
                if full:
                    put(size - fit * length, full, (length,) * fit)
                if rest:
                    put(size - rest * length, 1, (length,) * rest)
                left = 0
                continue
            count, lengths = room[space].pop()
            if not room[space]:
                spaces.remove(space)
            used = min(count, left)
            if used < count:
                put(space, count - used, lengths)
            put(space - length, used, (*lengths, length))
            left -= used
    for space in spaces:
        done += [tuple(x) for x in room[space]]
    return done


def slots(pats: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence and offset of every slot that takes it, in order of rank."""
    out: dict[int, list] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    seq = 0
    for count, lengths in pats:
        o = 0
        for n in lengths:
            out[n].append((taken[n], seq, o))
            taken[n] += count
            o += n
        seq += count
    return {n: tuple(np.array(x, np.int64) for x in zip(*v)) for n, v in out.items()}


def ranked(p: DataFrame, total: int) -> DataFrame:
    """p with a rank from 0 within each length; a frequent length is spread over many windows."""
    spread = max(16, math.ceil(total / 100_000))
    p = p.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(spread)).cast("int"))
    n = p.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = n.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    return p.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "salt")


def pack(p: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces (read from a table) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `size` rows at most
    table = slots(patterns(histogram, size))
    keep = [f.name for f in p.schema]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in p.schema) + ", sequence_id long, offset long"

    def run(batches):
        for b in batches:
            length, rank = (b.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                first, start, at = table[int(n)]
                rows = np.flatnonzero(length == n)
                k = np.searchsorted(first, rank[rows], "right") - 1
                seq[rows], off[rows] = start[k] + rank[rows] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    return ranked(p, sum(histogram.values())).select(*keep, "rank").mapInArrow(run, schema)
