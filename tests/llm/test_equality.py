"""Texts built to collide under polynomial hashes stay different; near-duplicates are found at the threshold."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quorum.llm import bpe, common as c, order_minhash, packing, quality, substring_dedup
from quorum.llm.common import stored


def thue(n, a, b):
    """The Thue-Morse string of n letters and its complement."""
    s = "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))
    return s, "".join(b if x == a else a for x in s)


def test_names_tell_thue_morse_apart():
    for n in (1024, 2048, 4096):
        for a, b in ("ab", "xy"):
            s, t = thue(n, a, b)
            d = np.frombuffer((s + t).encode(), np.uint8)
            x = c.span_names(d, np.array([0, n]), np.array([n, 2 * n]), 0)
            assert x[0] != x[1]
            v = c.mix(d.astype(np.uint64))
            w = c.Windows(v, n, 3)
            assert len(set(w.of(np.array([0, n]), n).tolist())) == 2
            assert (w.of(np.array([0, n]), np.array([n, n])) == w.of(np.array([0, n]), n)).all()


def test_windows_of_any_length():
    r = np.random.default_rng(1)
    v = r.integers(0, 3, 400).astype(np.uint64)
    w = c.Windows(v, 20, 7)
    seen = {}
    for n in range(1, 21):
        for i, name in enumerate(w.of(np.arange(400 - n + 1), np.full(400 - n + 1, n)).tolist()):
            assert seen.setdefault(name, v[i : i + n].tobytes()) == v[i : i + n].tobytes()
    assert len(seen) == len({v[i : i + n].tobytes() for n in range(1, 21) for i in range(400 - n + 1)})


def test_operators_on_thue_morse(spark):
    s, t = thue(1024, "a", "b")
    ws, wt = (" ".join(x) for x in thue(1024, "a", "b"))
    df = spark.createDataFrame([(1, s), (2, t), (3, ws), (4, wt), (5, s + "\n" + t)], "doc_id long, text string")
    got = {r.doc_id: r.decoded_sha256 for r in bpe.digests(df, bpe.vocabulary(bpe.RANKS)).collect()}
    for r in df.collect():
        assert got[r.doc_id] == hashlib.sha256(r.text.encode()).hexdigest()
    near = {r.doc_id: r.class_id for r in order_minhash.classes(df).collect()}
    assert len({near[1], near[2], near[5]}) == 3
    b = quality.base(*c.flat(df.toArrow().column("text").combine_chunks()))
    assert b["n_dup_lines"].tolist() == [0] * 5
    words = [r.text.split() for r in df.collect()]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want.append(sum(gone))
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(df, texts=False).collect()}
    assert [got[i] for i in range(1, 6)] == want


def test_windows_of_different_words_stay(spark):
    """Windows that share their core but not their edges are different."""
    r = random.Random(3)
    mid = [f"m{i}" for i in range(20)]
    texts = [" ".join([f"a{r.random()}" for _ in range(r.randint(8, 12))] + mid + [f"b{r.random()}" for _ in range(12)]) for _ in range(20)]
    texts += [" ".join([f"c{i}" for i in range(8)] + mid + [f"d{i}" for i in range(7)])] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in substring_dedup.remove_repeats(df, texts=False).collect()}
    assert [got[i] for i in range(20)] == [0] * 20 and got[20] == got[21] == 35


# ---------------------------------------------------------------- near-duplicates


def kmers(text):
    w = text.lower().split()
    k = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    n, out = Counter(), []
    for x in k:
        out.append((x, n[x]))
        n[x] += 1
    return out


def alike(a, b):
    """m / (n1 + n2 - m) of the longest common subsequence of labelled k-mers (labels are unique, so it is an increasing run)."""
    from bisect import bisect_left

    at = {x: i for i, x in enumerate(b)}
    tails = []
    for x in a:
        if x in at:
            k = bisect_left(tails, at[x])
            tails[k : k + 1] = [at[x]]
    m = len(tails)
    return m / (len(a) + len(b) - m) if a and b else 0.0


def edited(r, words, share):
    """words with a share of 5-word windows touched by single-word changes."""
    out = list(words)
    for i in r.sample(range(len(words)), max(1, int(len(words) * share / 5))):
        out[i] = f"changed{r.random()}"
    return out


@pytest.mark.parametrize("length", [120, 600, 6000])
def test_recall_at_the_threshold(spark, length):
    """Planted pairs of similarity 0.80 to 0.85, also of more k-mers than a sketch has bins."""
    r = random.Random(length)
    rows, pairs = [], []
    while len(pairs) < (30 if length < 5000 else 8):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(length)]
        a, b = " ".join(base), " ".join(edited(r, base, r.uniform(0.08, 0.12)))
        if 0.80 <= alike(kmers(a), kmers(b)) <= 0.85:
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), a), (len(rows) + 1, b)]
    got = {x.doc_id: x.class_id for x in order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)
    assert len(set(got.values())) == len(pairs) + sum(got[a] != got[b] for a, b in pairs)


def test_classes_equal_brute_force(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    labs = [kmers(x["text"] or "") for x in t]
    parent = list(range(len(t)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(t)):
        for j in range(i):
            if not labs[i] and not labs[j] or min(len(labs[i]), len(labs[j])) >= 0.8 * max(len(labs[i]), len(labs[j])) and labs[i] and alike(labs[i], labs[j]) >= 0.8:
                parent[find(i)] = find(j)
    want = {}
    for i, x in enumerate(t):
        want.setdefault(find(i), []).append(x["doc_id"])
    got = {}
    for r in order_minhash.classes(spark.createDataFrame([(x["doc_id"], x["text"]) for x in t], "doc_id long, text string")).collect():
        got.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(k == min(v) for k, v in got.items())


def test_classes_of_clashing_ids(spark):
    r = random.Random(2)
    a, b, d = (" ".join(f"t{r.random()}" for _ in range(30)) for _ in range(3))
    got = order_minhash.classes(spark.createDataFrame([(None, a), (1, b), (1, d), (2, b), (None, d + " x")], "doc_id long, text string")).collect()
    assert len(got) == 5 and len({x.class_key for x in got}) == 3
    assert sorted((x.doc_id or 0, x.class_id or 0) for x in got) == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)]
    out = order_minhash.one_each(spark.createDataFrame([(None, a), (1, b), (1, d), (2, b)], "doc_id long, text string"))
    assert sorted((x.doc_id or 0, x.text) for x in out.collect()) == sorted([(0, a), (1, b), (1, d)])


# ---------------------------------------------------------------- packing


def test_packing_equals_the_library(spark):
    import zlib

    import public_tokenizers as P
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(x["doc_id"], x["text"]) for x in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "hi <|endoftext|> there<|endoftext|>"), (10**6 + 3, "x " * 5000)]
    got = packing.pack(stored(packing.pieces(spark.createDataFrame(rows, "doc_id long, text string")))).collect()
    by_doc, by_seq = {}, {}
    for x in got:
        by_doc.setdefault(x.doc_id, []).append(x)
        by_seq.setdefault(x.sequence_id, []).append(x)
    for d, text in rows:
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for x in sorted(by_doc[d], key=lambda x: x.start):
            assert (x.start, x.doc_tokens) == (at, len(ids))
            assert x.ids_crc32 == zlib.crc32(ids[at : at + x.length].tobytes())
            at += x.length
        assert at == len(ids)
    for v in by_seq.values():
        at = 0
        for x in sorted(v, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 2048
    total = sum(x.length for x in got)
    assert len(by_seq) * 2048 <= total * 1.02 + 2048
    plain = packing.pieces(spark.createDataFrame([(1, "hi <|endoftext|> there")], "doc_id long, text string"), special=False).first()
    assert plain.doc_tokens == 10
