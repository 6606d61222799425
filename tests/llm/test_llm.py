import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quorum.llm import common as c
from quorum.llm import bpe, flac, html_main, induced, langid, order_minhash, packing, quality, substring_dedup, suffix_dedup, warc
from quorum.llm.common import stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, kept string"


def word(r):
    return "".join(r.choice(["an", "the", "or", "in", "re", "sh", "é"]) for _ in range(r.randint(1, 4)))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    base = [" ".join(word(r) for _ in range(r.randint(30, 120))) for _ in range(12)]
    texts = base + base[:3] + [base[4] + " tail words here", "x " * 200, "", "   ", None, "tiny", "a" * 300, base[0][:400] + "\n" + base[7], "z" + base[5][40:] + " 'tis <|endoftext|> \n\n ''s"]
    out = [(i, t, ["en", "fr"][i % 2], "s", len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    return out + [out[2], (None, base[1], "en", "s", 1, "clash", "clash")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_substring_dedup(spark, docs, rows):
    seen = Counter(tuple(w[i : i + 35]) for w in (words(r[1]) for r in rows) for i in range(len(w) - 34))
    want = []
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want.append((r[0], len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    got = [tuple(r)[:4] for r in substring_dedup.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_suffix_dedup(spark, docs, rows):
    big = 2**63 - 1
    keyed = [(big if r[0] is None else r[0], (r[1] or "").encode(), r[0]) for r in rows]
    first = {}
    for k, b, _ in sorted(keyed):
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], k)
    want = []
    for k, b, ident in keyed:
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                gone[i : i + 50] = [True] * 50
        want.append((ident, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    got = [tuple(r)[:5] for r in suffix_dedup.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    clean = suffix_dedup.cleaned(docs.drop("g", "kept"))
    assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars"] and clean.count() > 10


def test_suffix_dedup_hot_anchor(spark):
    r = random.Random(8)
    passage = "".join(word(r) + " " for _ in range(30))
    texts = ["".join(word(r) + " " for _ in range(20)) + passage + "".join(word(r) + " " for _ in range(20)) for _ in range(300)] + ["short"]
    g = suffix_dedup.Group(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), 50)
    keys, _, anchor = g.anchor_keys()
    n = np.bincount(anchor)
    hit = (n > 1)[anchor]
    most = []
    for hot in (n > len(anchor), n >= 20):
        start, length, inv, shard = g.runs(hit, keys[anchor], hot[anchor])
        one, _ = g.lowest(start, inv)
        assert set(c.ragged(start, length)) == set(c.ragged(g.start[hit], g.n[hit]))
        most.append(np.unique(shard[one], return_counts=True)[1].max())
    assert most[0] >= 200 and most[1] <= 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, hot = (sorted(tuple(x)[:5] for x in suffix_dedup.remove_repeats(docs, hot_runs=k).collect()) for k in (1 << 20, 4))
    seen, want = {}, []
    raw = [t.encode() for t in texts]
    for b in raw:
        gone = bytearray(len(b))
        mine = [b[i : i + 50] for i in range(len(b) - 49)]
        for i, x in enumerate(mine):
            if x in seen:
                gone[i : i + 50] = b"\1" * 50
        seen.update(dict.fromkeys(mine))
        want.append(sum(gone))
    assert got == hot and [x[2] for x in hot] == want and sum(want) > 0


def test_order_of_many_names():
    r = np.random.default_rng(3).integers(0, 70_000, 64 * 70_001 + 10)
    r[:70_000] = np.arange(70_000)
    sa = induced._order(r, 5)[: 4_000_000 : 1000]
    assert (np.diff(r[sa]) >= 0).all()


@pytest.mark.parametrize("memory, rows", [(64, 16), (64, 1 << 13), (4096, 16), (1 << 20, 16)])
def test_suffix_array(monkeypatch, memory, rows):
    monkeypatch.setattr(induced, "LEAST_ROWS", rows)
    r = random.Random(1)
    for _ in range(150):
        t = [r.randint(1, r.choice([1, 3, 200])) + 1 for _ in range(r.randint(0, 50))]
        t, depth = np.array(t + t[: len(t) // 3] + [0], r.choice([np.uint8, np.uint16])), r.choice([3, 50])
        sa, shared = induced.suffix_array(t, depth, memory)
        x = t.tolist()
        keys = [tuple(x[i : i + depth]) for i in sa]
        assert sorted(sa.tolist()) == list(range(len(x))) and keys == sorted(keys)
        for i in range(1, len(sa)):
            assert shared[i] == next((k for k, (p, q) in enumerate(zip(keys[i - 1], keys[i])) if p != q), min(len(keys[i - 1]), len(keys[i])))


def test_suffix_array_beyond_memory():
    """Shards of 64 times the budget (with their arrays 2,000 times) sort within memory that does not grow with them."""
    import tracemalloc

    rng = np.random.default_rng(0)
    peaks = []
    for n in (1 << 20, 4 << 20):
        t = np.r_[rng.integers(97, 123, n).astype(np.uint8), np.uint8(0)]
        t[n // 2 : n // 2 + n // 4] = t[: n // 4]
        tracemalloc.start()
        sa, shared = induced.suffix_array(t, 50, 1 << 16)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 12 << 20 and peaks[1] < 1.3 * peaks[0]
    at = rng.integers(1, len(sa) - 1, 3000)
    raw = t.tobytes()
    for i in at.tolist():
        a, b = (raw[sa[k] : sa[k] + 50] for k in (i - 1, i))
        assert a <= b and shared[i] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert np.bincount(np.asarray(sa), minlength=len(t)).max() == 1


@pytest.mark.parametrize("memory", [1 << 12, 1 << 28])
def test_sort_shard(memory):
    r = random.Random(memory)
    runs = ["".join(r.choice("ab") for _ in range(r.randint(9, 14))) for _ in range(300)]
    n, low = np.array([len(x) - 8 for x in runs]), np.array([r.randint(0, 50) for _ in runs])
    best = {}
    for x, i in zip(runs, low.tolist()):
        for k in range(len(x) - 8):
            best[x[k : k + 9]] = min(i, best.get(x[k : k + 9], 99))
    got = suffix_dedup.sort_shard(n, low, np.frombuffer("".join(runs).encode(), np.uint8), 9, memory)
    assert got.tolist() == [best[x[k : k + 9]] for x in runs for k in range(len(x) - 8)]
    cuts = list(suffix_dedup.stretches(np.array([0, 9, 9, 3, 9, 9, 9, 2, 9]), 9, most=2))
    assert cuts[0][0] == 0 and cuts[-1][1] == 9 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:])) and {a for a, _ in cuts} <= {0, 3, 7}


def test_flac(docs, rows):
    rng = np.random.default_rng(0)
    payloads = [rng.integers(0, 256, 1152).astype(np.uint8), np.full(576, 7, np.uint8), np.cumsum(rng.integers(-2, 3, 576)).astype(np.uint8), (128 + 60 * np.sin(np.arange(576) / 9)).astype(np.uint8)]
    media = flac.encode(payloads)
    assert flac.decode(media)[0].tobytes() == b"".join(p.tobytes() for p in payloads)
    bad = bytearray(media[0])
    bad[300] ^= 1
    with pytest.raises(flac.Damaged):
        flac.decode([bytes(bad)])
    got = {(r.doc_id, r.payload_sha256, r.payload_bytes, r.tail_crc32, r.n_bytes) for r in flac.digests(flac.store(docs)).collect()}
    want = set()
    for r in rows:
        b = (r[1] or "").encode()
        p = b + b"\xff" * ((-len(b)) % 576 if b else 576)
        want.add((r[0], hashlib.sha256(p).hexdigest(), len(p), zlib.crc32(p[-32:]), len(b)))
    assert got == want
    one = flac.blocks(flac.store(docs.where("doc_id = 0"))).collect()
    assert [r.sample_offset for r in one] == [576 * i for i in range(len(one))]


def test_media_table_takes_little_more_than_its_texts(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    media = stored(flac.store(docs))
    assert sum(os.path.getsize(f.removeprefix("file://")) for f in media.inputFiles()) <= 1.2 * os.path.getsize(path)
    want = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in media.collect():
        assert flac.decode([bytes(r.media)])[0].tobytes()[: r.n_bytes] == want[r.doc_id]


def test_stored_frames_are_predicted_where_that_saves_most():
    text = np.random.default_rng(1).integers(97, 123, 576).astype(np.uint8)
    slope = (np.arange(576) // 6 + 32).astype(np.uint8)
    kinds = lambda bits: [m[42 + len(flac._header(0))] >> 1 for m in flac.encode([text, slope, np.full(576, 255, np.uint8)], bits)]
    stored_kinds, plain_kinds = kinds(flac.STORED_BITS), kinds(8)
    assert stored_kinds == [1, plain_kinds[1], 0] and min(plain_kinds[:2]) > 1


def test_bpe(docs, rows):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect()}
    want = set()
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        want.add((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == want
    back = {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back[3] == rows[3][1]


def test_near_dedup(spark):
    r = random.Random(3)
    base = [word(r) + str(i) for i in range(100)]
    near, far = base[:50] + ["changed"] + base[51:], [word(r) + str(i) for i in range(900, 1000)]
    rows = [(5, " ".join(base)), (3, " ".join(near)), (7, " ".join(base)), (9, " ".join(far)), (1, None), (2, ""), (4, "only three words"), (4, "only three words"), (None, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in order_minhash.classes(df).collect()}
    assert got == {5: 3, 3: 3, 7: 3, 9: 9, 1: 1, 2: 1, 4: 4, None: 3}
    assert sorted(x.doc_id for x in order_minhash.one_each(df).collect()) == [1, 3, 4, 9]
    assert order_minhash.classes(df.limit(0)).count() == 0


def test_one_each_of_null_and_repeated_ids(spark):
    r = random.Random(12)
    a, b, d, e = (" ".join(word(r) + str(r.randint(0, 999)) for _ in range(60)) for _ in range(4))
    rows = [(1, a, "s"), (2, b, "s"), (2, d, "s"), (2, d, "s"), (3, d + " more", "s"), (5, a + " more", "s"), (5, e, "s"), (None, e, "s"), (None, b, "s"), (None, "alone here", "s"), (None, "alone here", "s")]
    out = order_minhash.one_each(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted((x.doc_id or 0, x.text) for x in out.collect()) == sorted([(1, a), (2, b), (2, d), (5, e), (0, "alone here")])
    assert out.columns == ["doc_id", "text", "source"]


@pytest.mark.parametrize("large", [1, 5, 40])
def test_pairs_in_blocks(spark, large):
    """A bucket's blocks find the pairs that the whole bucket finds, each once."""
    r = np.random.default_rng(2)
    base = r.integers(1, 256, order_minhash.BINS).astype(np.uint8)
    rows = []
    for i in range(60):
        oph = np.where(r.random(order_minhash.BINS) < r.choice([0.0, 0.1, 0.5]), r.integers(1, 256, order_minhash.BINS), base).astype(np.uint8)
        sig = r.integers(100, 110, order_minhash.SKETCHES)
        sig[1] = 7  # the signature that the bucket stands for; some pairs share the one before, and with it a bucket that reports them
        rows.append((7, i, int(i if i > 25 else 0 if i > 10 else 100), int(r.integers(80, 130)), bytearray(oph.tobytes()), bytearray(sig.tobytes()), 60))
    left = spark.createDataFrame(rows, "key long, rep long, comp long, n long, oph binary, sig binary, size long")
    pairs = lambda n: sorted(map(tuple, order_minhash._blocks(left, n).groupBy("key", "i", "j").applyInArrow(order_minhash._pairs_across, "a long, b long").collect()))
    want = pairs(60)
    assert len(want) > 50 and pairs(large) == want


def test_packing(docs, rows):
    got = packing.pack(stored(packing.pieces(docs, size=64)), size=64).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in by.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 64
    assert sum(r.length for r in got if r.doc_id == 0) == next(r.doc_tokens for r in got if r.doc_id == 0)
    r = random.Random(2)
    hist = Counter(r.randint(1, 2048) for _ in range(5000))
    back = Counter()
    for n, lengths in packing.patterns(hist):
        assert sum(lengths) <= 2048
        for x in lengths:
            back[x] += n
    assert back == hist


def test_quality(spark, docs, rows):
    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(24)], "doc_id long, quality int")
    got = quality.judged(docs, quality.fit_on(docs, labels)).collect()
    assert len(got) == len(rows)
    r = next(x for x in got if x.doc_id == 16)
    assert (r.n_words, r.word_chars, r.n_repeat_words, r.base_failed, r.kept) == (200, 200, 200, True, False)
    assert all(x.base_failed and not x.kept for x in got if x.doc_id in (17, 18, 19))
    assert quality.judged(docs.limit(0), quality.fit([], np.zeros(0))).count() == 0
    p, b = "p q\np q\n\n#*a", quality.base(np.frombuffer(b"p q\np q\n\n#*a", np.uint8), np.array([0, len("p q\np q\n\n#*a")]))
    assert (p and b["n_dup_lines"][0], b["n_symbols"][0]) == (1, 2)


def test_language(spark):
    r = random.Random(1)
    kinds = {"aa": ["lorem", "dolor", "amet"], "bb": ["kiwi", "zebra", "yak"]}
    rows = [(i, " ".join(r.choice(kinds[k]) for _ in range(20)), k) for i in range(120) for k in [sorted(kinds)[i % 2]]] + [(900, None, "aa"), (901, "12 34", "bb"), (902, "zebra yak", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {x.doc_id: x for x in langid.identified(df, langid.fit(df)).collect()}
    assert all(out[i].lang_pred == k for i, _, k in rows[:120])
    assert (out[900].lang_pred, out[901].lang_pred, out[902].lang_pred, out[900].score) == ("und", "und", "bb", 0.0)
    assert langid.identified(df, langid.fit(df.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_warc(spark):
    big = "y" * 150
    pages = spark.createDataFrame([(4, "http://a/1", big), (2, "http://a/2\n", big), (3, None, "short"), (5, "u", "short"), (6, "u", None), (None, "u", big), (2, "http://a/2\n", big)], "page_id long, url string, html string")
    arch = stored(warc.write(pages))
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to, r.payload_digest == hashlib.sha256(big.encode()).hexdigest()) for r in warc.read(arch).collect())
    assert got == sorted([(4, 150, "revisit", 2, True), (2, 150, "response", None, True), (2, 150, "response", None, True), (3, 5, "response", None, False), (5, 5, "response", None, False), (6, 0, "response", None, False), (0, 150, "response", None, True)])
    recs = [warc.member(warc.record(i, "u", b"p%d" % i * 50, hashlib.sha256(b"p%d" % i * 50).hexdigest(), None)) for i in range(6)]
    raw = bytearray(b"".join(recs))
    start = len(recs[0]) + len(recs[1])
    raw[start + 30] ^= 0xFF
    out = warc.salvage(bytes(raw) + b"junk")
    assert len(out.records) == 5 and out.gaps == [(start, start + len(recs[2])), (len(raw), len(raw) + 4)]
    plain = warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert len(warc.salvage(b"xx" + plain + plain[:-9] + plain).records) == 2


def test_html(spark):
    shell = "<nav>menu</nav><div>Site name</div>{}<div>All rights</div>"
    pages = spark.createDataFrame([(1, "http://h/a/1", shell.format("<p>One &amp; two</p>")), (2, "http://h/a/2", shell.format("<p>Three<br>four</p>")), (3, "http://h/z/9", "<article><h1>T</h1>x</article><footer>f</footer>"), (4, None, None), (4, None, None)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_main.extract(pages).collect()}
    assert got == {1: ("One & two", 9), 2: ("Three four", 10), 3: ("T\n\nx", 4), 4: ("", 0)}
    assert html_main.extract(pages).count() == 5


def test_html_differences_articles(spark):
    shell = "<p>Lead of {0}</p><article><h1>Title {0}</h1><p>Read our app</p><p>Long text of page {0}</p></article>"
    same = "<article><p>One article under two addresses</p></article>"
    pages = spark.createDataFrame([(1, "http://h/a/1", shell.format("one")), (2, "http://h/a/2", shell.format("two")), (3, "http://i/a/1", same), (4, "http://i/a/2", same)], "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in html_main.extract(pages).collect()}
    assert got[1] == ["Lead of one", "Title one", "Read our app", "Long text of page one"] and got[2] == ["Lead of two", "Title two", "Read our app", "Long text of page two"]
    assert got[3] == got[4] == ["One article under two addresses"]


@pytest.mark.parametrize("f", [substring_dedup.remove_repeats, suffix_dedup.remove_repeats, bpe.digests])
def test_empty_tables(docs, f):
    assert f(docs.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    rows = [(i, " ".join(word(r) + word(r) for _ in range(80)) + ".", "en", "s", 1) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s", 1) for i in range(5)] + [(200, None, None, None, None), (201, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in out} == set(range(40))
