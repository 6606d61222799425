"""Operators against plain versions of themselves on the smallest tables."""

import hashlib
import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from quorum.llm import bpe, flac, html_main, langid, quality, warc
from quorum.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def test_base_rules(spark, rows):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in quality.judged(d, quality.fit_on(d, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    for x in rows + [{"doc_id": None, "text": None}]:
        if x["doc_id"] is None:
            continue
        t, g = x["text"] or "", got[x["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [y for y in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        seen = {}
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        hit = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        bad = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == (len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), bad)
        assert not (g.base_failed and g.kept)


def test_quality_scores(spark, rows):
    """The model's score from dictionaries of n-grams of words and code points."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    m = quality.fit_on(d, spark.read.parquet(f"{SF}/labels.parquet"))
    some = [x for x in rows if x["text"]][:20] + [{"doc_id": -1, "text": "ééé ßßß 中文 ééé"}]
    for x in some:
        raw = np.frombuffer(x["text"].encode(), np.uint8)
        z = m.bias
        for idx, doc in quality.features(raw, np.array([0, len(raw)])):
            assert (doc == 0).all()
            if len(idx):
                z += quality.SCALE * float(np.mean(m.weights[idx], dtype=float))
        assert abs(quality.scores(raw, np.array([0, len(raw)]), m)[0] - z) < 1e-6
    chars = [i for i, _ in quality.features(np.frombuffer("éé".encode(), np.uint8), np.array([0, 4]))]
    assert [len(i) for i in chars] == [1, 0, 2, 0] and chars[2][0] == chars[2][1]  # one feature per character, not per byte


def test_quality_keeps_the_good(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = quality.fit_on(d, labels.where("doc_id % 2 = 1"))
    got = quality.judged(d, odd).join(labels.where("doc_id % 2 = 0"), "doc_id").where("NOT base_failed").select("kept", "quality").collect()
    good = [r.kept for r in got if r.quality]
    assert len(good) > 30 and sum(good) >= 0.95 * len(good)


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identified(d.select("doc_id", "text"), langid.fit(d)).join(d.select("doc_id", "lang"), "doc_id").where(~langid.in_learning() & (langid.F.col("lang").isNotNull())).collect()
    sure = [r for r in got if r.lang_pred != "und"]
    assert len(sure) > 200 and sum(r.lang_pred == r.lang for r in sure) >= 0.97 * len(sure)
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identified(spark.createDataFrame([(1, "same text"), (1, "same text")], "doc_id long, text string"), langid.fit(d)).distinct().count() == 1


def test_language_scores(spark, rows):
    """A text's probability from a plain sum over its n-grams."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    m = langid.fit(d)
    for x in [x for x in rows if x["text"]][:10]:
        raw = np.frombuffer(x["text"].encode(), np.uint8)
        idx, _, letters = langid.grams(raw, np.array([0, len(raw)]))
        best, p = langid.predict(raw, np.array([0, len(raw)]), m)
        z = [(sum(float(m.table[i, j]) for i in idx) / max(1, len(idx)) + m.bias[j]) / m.temperature for j in range(len(m.langs))]
        e = [math.exp(v - max(z)) for v in z]
        if letters[0]:
            assert best[0] == int(np.argmax(z)) and abs(p[0] - max(e) / sum(e)) < 1e-6


# ---------------------------------------------------------------- media


def flac_decode(media):
    """A plain decoder, bit by bit, of any mono stream of 8 bits: all subframes, partitions and escape codes."""
    bits = np.unpackbits(np.frombuffer(media, np.uint8))
    pos = 42 * 8
    total = int.from_bytes(media[18:26], "big") & (1 << 36) - 1

    def take(n):
        nonlocal pos
        v = 0
        for b in bits[pos : pos + n].tolist():
            v = v << 1 | b
        pos += n
        return v

    def signed(n):
        v = take(n)
        return v - (1 << n) if v >> (n - 1) else v

    out = []
    while len(out) < total:
        assert take(14) == 0b11111111111110
        take(2)
        size = {1: 192, 2: 576, 3: 1152}[take(4)]
        take(4)
        assert take(4) == 0
        take(4)
        lead = take(8)
        more = 0 if lead < 128 else 7 - (lead ^ 0xFF).bit_length()
        for _ in range(more):
            take(8)
        take(8)
        take(1)
        kind = take(6)
        take(1)
        if kind == 0:
            x = [signed(8)] * size
        elif kind == 1:
            x = [signed(8) for _ in range(size)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [signed(8) for _ in range(order)]
            coef, shift = [(), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)][order] if kind < 32 else (), 0
            if kind >= 32:
                precision = take(4) + 1
                shift = take(5)
                coef = [signed(precision) for _ in range(order)]
            wide = 4 + take(2)
            parts = 1 << take(4)
            for p in range(parts):
                k = take(wide)
                for _ in range(size // parts - (order if p == 0 else 0)):
                    q = 0
                    while not take(1):
                        q += 1
                    u = q << k | (take(k) if k else 0)
                    x.append((u >> 1 ^ -(u & 1)) + (sum(a * x[-1 - j] for j, a in enumerate(coef)) >> shift))
        out += x
        pos = (pos + 7) // 8 * 8 + 16
    return bytes(v + 128 for v in out)


def test_media_by_another_decoder(spark, rows):
    some = [(x["doc_id"], x["text"]) for x in rows[:12]] + [(-1, None), (-2, "ab" * 3000), (-3, "é\n" * 400)]
    df = spark.createDataFrame(some, "doc_id long, text string")
    media = stored(flac.store(df))
    got = {r.doc_id: r for r in flac.digests(media).collect()}
    blob = {r.doc_id: bytes(r.media) for r in media.collect()}
    for i, t in some:
        b = (t or "").encode()
        p = b + b"\xff" * ((-len(b)) % 576 if b else 576)
        assert flac_decode(blob[i]) == p
        s = [v - 128 for v in p]
        feature = f"n={len(s)};sum={sum(s)};energy={sum(v * v for v in s)};crossings={sum((a < 0) != (c < 0) for a, c in zip(s, s[1:]))};peak={max(map(abs, s))}"
        assert (got[i].media_sha256, got[i].media_bytes, got[i].feature) == (hashlib.sha256(blob[i]).hexdigest(), len(blob[i]), feature)
    pcm = flac.blocks(media.where("doc_id = -2")).orderBy("sample_offset").collect()
    assert b"".join(bytes(r.pcm) for r in pcm) == ("ab" * 3000).encode() + b"\xff" * (-6000 % 576)
    assert all(blob[-2][r.byte_offset : r.byte_offset + 2] == b"\xff\xf8" for r in pcm)


def test_header_inside_a_frame():
    """The next frame's header, spelled by the samples of the one before, is not taken for it."""
    rng = np.random.default_rng(9)
    p = rng.integers(0, 256, 1152).astype(np.uint8)
    h = np.frombuffer(flac._header(1), np.uint8) ^ 128
    p[100 : 100 + len(h)] = h
    media = flac.encode([p])
    assert media[0].find(flac._header(1)) < 42 + 576 and flac.decode(media)[0].tobytes() == p.tobytes()


# ---------------------------------------------------------------- archives


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_salvage_of_versions_and_members(spark):
    body = b"q" * 120
    one = warc.record(1, "u", body, sha(body), None)
    old = one.replace(b"WARC/1.1", b"WARC/1.0")
    assert [len(warc.salvage(x).records) for x in (one, old, warc.member(one + old), warc.member(old) + one)] == [1, 1, 2, 2]
    assert all(not warc.salvage(x).gaps for x in (one, old, warc.member(one + old), warc.member(old) + one))
    bad = one.replace(b"X-Page-Id: 1", b"X-Page-Id: z")
    got = warc.salvage(bad + old)
    assert len(got.records) == 1 and got.gaps == [(0, len(bad))]
    half = warc.member(one + bad + old)
    got = warc.salvage(half + warc.member(one))
    assert len(got.records) == 3 and got.gaps == [(0, len(half))]
    assert warc.salvage(b"").records == [] and warc.salvage(b"\x1f\x8b\x08").gaps == [(0, 3)]


def test_revisits_are_verified(spark):
    body = b"q" * 120
    recs = [warc.record(1, "u", body, sha(body), None), warc.record(2, "u", body, sha(body), 1), warc.record(3, "u", body, sha(b"other"), 1), warc.record(4, "u", body, sha(body), 9)]
    arch = spark.createDataFrame([(7, bytearray(b"".join(map(warc.member, recs)) + b"tail"))], "archive long, bytes binary")
    scanned = stored(warc.scan(arch))
    assert sorted(r.page_id for r in warc.records(scanned).collect()) == [1, 2]
    log = {(r.gap_start, r.page_id) for r in warc.quarantined(scanned).collect()}
    assert {p for _, p in log} == {None, 3, 4} and len(log) == 3
    assert [r.payload for r in warc.read(arch).orderBy("page_id").collect()] == [bytearray(body), None]


# ---------------------------------------------------------------- pages


def lcs_shared(a, b):
    """Lengths by the plain table; which lines of a one alignment takes depends on ties, their number does not."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_lines_against_the_table():
    r = np.random.default_rng(5)
    for _ in range(300):
        a, b = (r.integers(0, r.integers(2, 9), r.integers(0, 40)).tolist() for _ in range(2))
        got = html_main.shared_lines(a, b)
        assert got == sorted(set(got)) and len(got) == lcs_shared(a, b)
        it = iter(b)
        assert all(any(a[i] == y for y in it) for i in got)
    n = 20_000  # memory stays small: two pages of many shared lines
    import tracemalloc

    x = r.integers(0, 50, n).tolist()
    tracemalloc.start()
    assert len(html_main.shared_lines(x, x)) == n
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


class Plain(HTMLParser):
    """The standard library's parser as a second one: blocks of text, and whether each stands in the article or in an element that never holds main text."""

    BLOCKS = {"p", "div", "li", "ul", "nav", "article", "footer", "header", "h1", "h2", "h3", "aside", "section", "body", "html", "head", "form"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.parts, self.open = [], [], []
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            tags = [t for t, _ in self.open]
            self.out.append((text, "article" in tags, bool({"nav", "footer", "header", "aside", "form", "head"} & set(tags)) or any(dict(a).get("class") == "ad" for _, a in self.open)))

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        if tag in self.BLOCKS | {"script", "style", "title"}:
            self.cut()
        if tag not in ("br", "meta", "link", "img"):
            if tag == "p" and self.open and self.open[-1][0] == "p":
                self.open.pop()
            self.open.append((tag, attrs))

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.cut()
        at = [i for i, (t, _) in enumerate(self.open) if t == tag]
        if at:
            del self.open[at[-1] :]

    def handle_data(self, data):
        if not self.open or self.open[-1][0] not in ("script", "style", "title"):
            self.parts.append(data)


def test_pages_against_brute_force(spark):
    """A second parser, all pairs of neighbours by sorting on one machine, a table for the longest common subsequence: equal texts."""
    path = "/root/testdata/sf0.01/pages.parquet"
    page = {}
    for x in pq.read_table(path).to_pylist():
        rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", x["url"] or "")
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        page[x["page_id"]] = (m[1].lower(), m[2], Plain(x["html"] or "").out)
    first = {}
    for host, p, lines in page.values():
        key = host, tuple(t for t, _, _ in lines)
        first[key] = min(first.get(key, p), p)
    order = sorted((host, p, lines) for (host, lines), p in first.items())
    at = {(h, lines): i for i, (h, _, lines) in enumerate(order)}
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    got = {r.page_id: r for r in html_main.extract(spark.read.parquet(path)).collect()}
    assert set(got) == set(page)
    paired = 0
    for i, (h, _, lines) in page.items():
        texts = [t for t, _, _ in lines]
        j = at[h, tuple(texts)]
        near = [(common(order[j][1].split("/"), order[k][1].split("/")), -n, order[k][2]) for n, k in enumerate((j - 1, j + 1)) if 0 <= k < len(order) and order[k][0] == h]
        other = max(near)[2] if near else ()
        paired += bool(near)
        article = [t for t, inside, bad in lines if inside and not bad]
        outside = [t for t, inside, bad in lines if not inside and not bad]
        assert article  # every page of this table declares one, so its lines all come back
        kept = got[i].text.split("\n\n")
        extra = [t for t in outside if t not in other]
        assert kept == [t for t, inside, bad in lines if not bad and (inside or t in extra)]
        assert got[i].n_chars == len(got[i].text)
    assert paired > 50


def test_pages_are_their_documents(spark):
    """Articles come out whole: every page's text is some document's, but for the title line before it and white space."""
    docs = {"".join((r.text or "").split()) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = html_main.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    assert len(got) == 250
    for r in got:
        assert "".join(r.text.split("\n\n", 1)[1].split()) in docs, r.page_id


def test_editions_keep_their_text(spark):
    body = "".join(f"<p>Paragraph {i} of a text that two addresses hold, with words of its own.</p>" for i in range(6))
    other = "".join(f"<p>Another text, line {i}, of quite some length to make up a page of its own.</p>" for i in range(6))
    rows = [(1, "http://h/a/1", body), (2, "http://h/a/2", body + "<p>Correction added later.</p>")]
    rows += [(3, "http://i/a/1", f"<p>Site of many things</p>{body}"), (4, "http://i/a/2", f"<p>Site of many things</p>{body}<p>Correction.</p>"), (5, "http://i/a/3", f"<p>Site of many things</p>{other}")]
    rows += [(6, "http://j/1", "<article><p>Shared words.</p><div class='related'>Related and shared.</div><div class='share'>The share of each page.</div><label>Kept</label></article>")]
    rows += [(7, "http://j/2", "<article><p>Shared words.</p><div class='related'>Related and shared.</div><div class='share'>Another one.</div></article>")]
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = "\n\n".join(f"Paragraph {i} of a text that two addresses hold, with words of its own." for i in range(6))
    assert got[1] == text and got[2] == text + "\n\nCorrection added later."
    assert got[4] == text + "\n\nCorrection."  # its other neighbour shows what is the site's
    assert got[3] == "Site of many things\n\n" + text  # it has no other
    assert got[5].startswith("Another text, line 0")
    assert got[6] == "Shared words.\n\nThe share of each page.\n\nKept" and got[7] == "Shared words.\n\nAnother one."


def test_marks_by_whole_tokens(spark):
    def unmarked(page):
        return [t for t, k in zip(*html_main.lines(page)) if not k & (html_main.ELEMENT | html_main.CLASS)]

    body = "<p>Body text of the page, which is long enough to be most of it.</p>"
    for mark in ('class="layout has-sidebar"', 'class="post no-ads"', 'id="search-results"', 'class="legal-news"', 'class="sidebar"'):
        assert unmarked(f"<div {mark}>{body}</div><p>x</p>")[0].startswith("Body text")
    assert unmarked(f'<div class="sidebar">menu</div>{body}<div class="post-comments"><p>first!</p></div><div class="site-footer">c</div><div class="cookie-notice">ok</div>') == ["Body text of the page, which is long enough to be most of it."]
    assert unmarked(f"<nav>{body * 9}</nav><p>short</p>") == ["short"]
    assert unmarked(f'<article><p>short</p></article><div class="comments">{body * 9}</div>') == ["short"]
    assert unmarked("<article>teaser</article><div>long body</div>") == ["teaser", "long body"]


def test_copies_give_the_same_result(spark):
    a = "<div><p>Site</p><p>{0}</p></div>"
    rows = [(1, "http://h/a/1", a.format("one")), (2, "http://h/a/2", a.format("one")), (3, "http://h/b/3", a.format("three")), (4, "http://h/a/1", a.format("one")), (None, "http://h/a/9", a.format("one")), (5, "http://lone/x", a.format("five")), (5, "http://lone/x", a.format("five"))]
    got = html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, "one"), (1, "one"), (2, "one"), (3, "three"), (4, "one"), (5, "Site\n\nfive"), (5, "Site\n\nfive")]


def test_ids_of_all_documents(rows):
    import base64

    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc, lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [x["text"] or "" for x in rows] + ["", " ", "\n\n \t x", "it's we'll they've  'tis ''s", "a<|endoftext|>b <|endoftext|>", "中文 é́ 　x १२३", "x" * 3000]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(b) for b in raw])]
    for e, want in ((bpe.Encoder(P.path(bpe.RANKS)), enc.encode_ordinary), (bpe.Encoder(P.path(bpe.VOCABULARY), True), lambda t: lib.encode(t, add_special_tokens=False).ids)):
        ids, at = e.encode(data, off)
        assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [want(t) for t in texts]
        assert e.decode(ids).tobytes() == data.tobytes()


@pytest.mark.parametrize("part, long", [(9, 1 << 23), (9, 3), (64, 3)])
def test_long_texts_in_parts(monkeypatch, part, long):
    import random

    import public_tokenizers as P

    r = random.Random(part)
    texts = ["".join(r.choice("ab'sS tTrelvd \n\té1.,!") for _ in range(r.randint(1, 200))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(b) for b in raw])]
    e = bpe.Encoder(P.path(bpe.RANKS))
    want = e.encode(data, off)
    monkeypatch.setattr(bpe, "PART", part)
    monkeypatch.setattr(bpe, "LONG", long)
    got = bpe.Encoder(P.path(bpe.RANKS)).encode(data, off)
    assert all((a == b).all() for a, b in zip(got, want))
