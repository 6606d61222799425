"""Hard negatives, secret scans and conversation repair: SQL on small tables, brute force, edge cases."""

import hashlib
import random
import re
from itertools import product

import duckdb
import pytest

from quorum.llm import conversations, hard_negatives, queries, secret_scan

SF = "/root/testdata/sf0.001"


def same(spark, name, table, frame):
    """The query's rows over a frame, and the oracle's over the same rows."""
    con = duckdb.connect()
    con.register(table, frame.toArrow())
    want = con.sql(queries.oracle_sql()[name])
    return sorted(map(str, want.fetchall())), want.columns


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_secret_scan", "op13_conversations"])
def test_oracles(spark, name):
    got = queries.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


# ---------------------------------------------------------------- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, score string, anchor int"


def mined(spark, rows):
    df = spark.createDataFrame(rows, VECTORS)
    return sorted(map(tuple, hard_negatives.mine(hard_negatives.shifted(hard_negatives.usable(df), 7, 10)).collect()), key=str)


def brute(rows):
    import math

    live = [(i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y, *_ in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(live):
        if i is None or i % 50:
            continue
        others = sorted((-sum(p * q for p, q in zip(v, w)), j is None, j or 0, z == y) for b, (j, w, z) in enumerate(live) if b != a)
        for s, none, j, _ in [o for o in others if o[3]][:5]:
            near = [o for o in others if not o[3] and 50 * -s <= 100 * -o[0] <= 95 * -s][:3]
            out += [(i, None if none else j, r + 1, None if o[1] else o[2], -s, -o[0]) for r, o in enumerate(near)]
    return sorted(out, key=str)


def test_hard_negatives_edges(spark, monkeypatch):
    rnd = random.Random(3)
    vec = lambda n=4: [rnd.choice([-2.0, -0.5, 0.25, 1.0, 3.0]) for _ in range(n)]
    rows = [(i % 120, vec(), i % 10 % 3, "x", 1) for i in range(400)]  # repeated ids, many ties
    rows += [(50, [1.0, 1.0, 1.0, 1.0], 1, None, None)] * 3 + [(None, vec(), 1, None, None), (None, vec(), 2, None, None)]
    rows += [(100, None, 1, "", 0), (100, [1.0, None, 1.0, 1.0], 1, "", 0), (100, [float("nan"), 1.0, 1.0, 1.0], 1, "", 0), (100, [float("inf")] * 4, 1, "", 0), (100, vec(), None, "", 0)]
    rows += [(150, vec(7), 1, "", 0), (3, vec(2), 1, "", 0), (5, [], 0, "", 0), (200, [], 0, "", 0), (250, vec(9), 77, "", 0)]
    want = brute(rows)
    assert len(want) > 50 and mined(spark, rows) == want
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 300)  # several blocks of anchors, candidates few at a time
    assert mined(spark, rows) == want
    assert mined(spark, []) == []


def test_hard_negatives_beyond_float64(spark):
    """Scores over 2^53, where a product of doubles would round."""
    rows = [(50, [400000.5, 1.0], 1, "", 0), (1, [400000.0, 3.0], 1, "", 0), (2, [300000.0, 0.00390625], 2, "", 0), (3, [300000.0, 0.0078125], 2, "", 0)]
    got = mined(spark, rows)
    assert got == brute(rows) and got[0][4] > 1 << 53


# ---------------------------------------------------------------- secret scans


def test_secret_edges(spark):
    rnd = random.Random(8)
    some = ["password: abcdefghijkl", "token=secret: abcdefghijklmn", "TOKEN = 'ABC.def=ghi-jkl' x", "AKIA" * 5, "xAKIA1234567890ABCD", "f" * 16 + " " + "0" * 15, "KkKey apiKey:" + "a" * 12, "é" * 5 + "deadbeef" * 3 + "🙂" + "passwd=" + "Q" * 12, "\n", " "]
    docs = [(i, "".join(rnd.choice(some) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randrange(1, 6))), "r") for i in range(200)]
    docs += [(None, None, None), (None, "x", None), (5, "", None), (5, "secret=0123456789ab", None), (5, "secret=0123456789ab", None), (9, "9f" * 200_000 + " token: " + "z" * 50_000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, kind string")
    got = secret_scan.scanned(df)
    want, columns = same(spark, "op12_secret_scan", "documents", df)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == want
    assert secret_scan.scanned(df.limit(0)).count() == 0
    pattern = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r["base_sha256"])
    for i, text, _ in docs[:5] + docs[6:200]:
        if i in (5, 9):
            continue
        all_ = [(m.start(), 0, m.end()) for m in pattern.finditer(text) if len(m.group(1)) >= 12]
        all_ += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
        all_ += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
        line = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(all_))
        assert by[i] == [hashlib.sha256(line.encode()).hexdigest()], (text, line)


def test_random_strings_are_told_from_others(spark):
    """Random strings of several encodings and lengths are found but for a small share; paths, sequences and joined words are not."""
    rnd = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    prose = " ".join(r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").limit(40).collect())
    words = [w for w in re.findall("[a-z]+", prose) if len(w) > 3]
    docs, planted, clean = [], {}, set()
    for i in range(300):
        n = rnd.choice([20, 24, 32, 40, 64])
        if i % 3 == 0:
            x = "".join(rnd.choice(letters) for _ in range(n))
        elif i % 3 == 1:
            x = "".join(rnd.choice("0123456789ABCDEF") for _ in range(n))
        else:
            x = "".join(rnd.choice(words).title() for _ in range(n // 5)) + rnd.choice(["", "7", "2024"])
            x = x if len(x) >= 24 else x + "".join(rnd.choice(words).title() for _ in range(4))
            clean.add(i)
        planted[i] = f"random:4:{4 + len(x)}"
        docs.append((i, f"see {x} end"))
    docs += [(1000 + i, f"in /usr/local/share/site-packages/module{i} and abcdefghijklmnopqrstuvwxyz0123456789") for i in range(20)]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scanned(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    hits = sum(planted[i] in got[i].split(",") for i in planted if i not in clean)
    assert hits >= 0.95 * 200
    assert sum(planted[i] in got[i].split(",") for i in clean) <= 0.1 * len(clean)
    assert not any(got[i] for i in got if i >= 1000)


# ---------------------------------------------------------------- conversations


def enumerated(signature):
    """All edits of a short signature, up to as many inserts as could help."""
    best = None
    for parts in product(("", "I", "II"), repeat=len(signature) + 1):
        for edits in product("DKR", repeat=len(signature)):
            cost, roles, ok = 2 * sum(map(len, parts)), "", True
            audit = ""
            for i, letter in enumerate((*signature, None)):
                for _ in parts[i]:
                    roles += "?"
                audit += parts[i]
                if letter is None:
                    break
                e = edits[i]
                audit += e
                cost += {"D": 3, "K": 0, "R": 2}[e] + (e != "D" and letter.isupper())
                if letter == "x" and e != "D":
                    ok = False
                if e != "D":
                    roles += "?" if e == "R" else letter.lower()
            rest = roles[1:] if roles[:1] == "s" else roles
            fits = ok and (not roles or (len(rest) >= 2 and len(rest) % 2 == 0 and all(c == "?" or c == "ua"[j % 2] for j, c in enumerate(rest))))
            if fits and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_signatures_against_all_edits():
    rnd = random.Random(1)
    some = ["", *"suaoSUAOx", *("".join(rnd.choice("suaoSUAOx") for _ in range(rnd.randrange(2, 5))) for _ in range(120))]
    for s in some:
        assert conversations.solve(s) == enumerated(s), s


def test_long_signatures_are_one_whole():
    """Products of pieces equal a pass over all rows, whatever the length."""
    rnd = random.Random(2)
    for n in (63, 64, 65, 130, 700):
        s = "".join(rnd.choice("suaoUAx") for _ in range(n))
        state = {0: (0, "")}
        for letter in s:
            new = {}
            for a, (c, e) in state.items():
                for (x, b), (c2, e2) in conversations._leaf(letter).items():
                    if x == a:
                        got = (c + c2, e + e2)
                        new[b] = min(new.get(b, got), got)
            state = new
        assert conversations.solve(s) == min((c + conversations.CLOSING[b][0], e + conversations.CLOSING[b][1]) for b, (c, e) in state.items())


def test_conversation_edges(spark):
    rnd = random.Random(6)
    texts = [None, "", " \t\n", "Yes.", "No", "Well?  \n", "ok!\x0b", " ", "long. " * 5000]
    rows = [(rnd.choice([None, 1, 2, 3, 40]), rnd.choice([None, *range(-3, 30)]), rnd.choice([None, "user", "assistant", "system", "tool", ""]), rnd.choice(texts), "x", 1) for _ in range(400)]
    rows += [(77, 1, "user", "Hi.", "x", 1)] * 5 + [(i, 0, "user", "Hi.", "x", 1) for i in range(100, 140)] + [(i, None, None, None, None, None) for i in range(200, 220)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, pos int")
    damaged = conversations.damaged(df)
    got = conversations.digests(damaged, conversations.audited(damaged))
    want, columns = same(spark, "op13_conversations", "conversations", df.select("conv_id", "turn", "role", "text"))
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == want
    empty = conversations.damaged(df.limit(0))
    assert conversations.digests(empty, conversations.audited(empty)).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There?"), (1, 2, "assistant", "Yes."), (1, 3, "assistant", "Yes."), (2, 0, "assistant", "")]
    found = conversations.as_found(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = [tuple(r) for r in conversations.repaired(found, conversations.audited(found)).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, "K", 0, "user", "Hi."), (1, 1, "I", None, "assistant", ""), (1, 2, "K", 1, "user", "There?"), (1, 3, "K", 2, "assistant", "Yes."), (1, None, "D", 3, "assistant", "Yes."), (2, None, "D", 0, "assistant", "")], key=str)
