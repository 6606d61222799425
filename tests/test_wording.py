"""Wording with typos, names inside labels, and the q-gram index against all pairs."""

import random

import pytest

from quorum.operators import wording

# A feed's labels, and what they stand for
CODES = {
    "passing yards": "PASS_YDS", "passing tds": "PASS_TD", "passing interceptions": "PASS_INT", "rushing yards": "RUSH_YDS", "rushing tds": "RUSH_TD", "receiving yards": "REC_YDS", "receiving tds": "REC_TD",
    "receptions": "REC", "sacks": "SACK", "interceptions": "INT", "tackles assists": "TACKLES", "receiving rushing yards": "BOTH_YDS", "rushing receiving yards": "BOTH_YDS", "receiving rushing tds": "BOTH_TD",
}
ALIASES = {"td": "tds", "int": "interceptions", "ints": "interceptions", "inds": "interceptions", "reception": "receptions", "assist": "assists", "yard": "yards"}
MARKERS = ["passing", "rushing", "receiving", "receptions", "sacks", "interceptions", "tackles"]


def test_labels(spark):
    want = {
        "Receiving Yards": "REC_YDS", "Receiving Yrads": "REC_YDS", "Receiving Yrards": "REC_YDS", "Passing Interceptions": "PASS_INT", "Passing INT's": "PASS_INT", "Passing IND's": "PASS_INT", 'Passing TD"s': "PASS_TD",
        "Receiving TD;s": "REC_TD", "Rushing TD's": "RUSH_TD", "Receptions": "REC", "Reception": "REC", "Tackles & Assists": "TACKLES", "Tackles & Assist": "TACKLES", "Sacks": "SACK", "Interceptions": "INT",
        "Receiving & Rushing Yards": "BOTH_YDS", "Total Rushing & Receiving Yards": "BOTH_YDS", "Receiving & Rushing TD's": "BOTH_TD", "Recieving  yards": "REC_YDS", "Pasing Yards": "PASS_YDS",
        "???": None, "": None, "Punting Yards": None, None: None,
    }
    got = spark.createDataFrame([(k,) for k in want], "t string").select("t", wording.coded("t", CODES, ALIASES, ("total",)).alias("c")).collect()
    assert {r.t: r.c for r in got} == want


def test_names_inside_labels(spark):
    rows = [
        ("UNKNOWN", "De'Von Achane MIA -Total Receiving & Rushing Yards", None, "De'Von Achane", "BOTH_YDS"), ("UNKNOWN", "Hunter Henry NE Total Receiving Yards", None, "Hunter Henry", "REC_YDS"),
        (None, "Travis Kelce KC- Total Receiving TD's", None, "Travis Kelce", "REC_TD"), ("unknown ", "Jayden Daniels WSH - Rushing Yards", "??", "Jayden Daniels", "RUSH_YDS"),
        ("UNKNOWN", "Javonte Williams DAL - Recieving & Rushing Yrads", None, "Javonte Williams", "BOTH_YDS"), ("DJ MOORE", "anything", "Y", "DJ MOORE", "REC_YDS"), ("A B", "Knitting", None, "A B", None),
        ("UNKNOWN", "???", None, None, None), ("UNKNOWN", "Total Sacks", None, None, None), (None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, player string, label string, short string")
    got = {r.i: (r.player, r.stat) for r in wording.recovered(df, "player", "label", "short", CODES, {"Y": "REC_YDS"}, ALIASES, MARKERS).collect()}
    assert got == {i: r[3:] for i, r in enumerate(rows) if r[3]}


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, last = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(last[j] + 1, d[-1] + 1, last[j - 1] + (x != y)))
    return d[-1]


@pytest.mark.parametrize("letters", ["ab", "abcdefghij"])
def test_index_against_all_pairs(spark, letters):
    rnd = random.Random(len(letters))
    word = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    names = sorted({word(rnd.randrange(1, 14)) for _ in range(150)} | {"é" + word(5) for _ in range(3)})

    def typo(w):
        for _ in range(rnd.randrange(4)):
            i = rnd.randrange(len(w) + 1)
            w = rnd.choice([w[:i] + rnd.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rnd.choice(letters) + w[i + 1 :]])
        return w

    asked = sorted({typo(rnd.choice(names)) for _ in range(150)} | {word(7), ""})
    got = {r.t: (r.name, r.edits) for r in wording.nearest_names(spark.createDataFrame([(x,) for x in [*asked, *asked[:9], None]], "t string"), "t", spark.createDataFrame([(x,) for x in [*names, names[0], None]], "name string"), "name").collect()}
    assert set(got) == set(asked)
    for t in asked:
        most = 0 if len(t) <= 3 else 1 if len(t) <= 6 else 2
        near = sorted((e, n) for n in names if (e := edits(t, n)) <= most)
        want = (near[0][1], near[0][0]) if near and (len(near) == 1 or near[1][0] > near[0][0]) else (None, None)
        assert got[t] == want, (t, near[:3])
