"""Awards, records set, tidbits and cards of pairs against plain computations."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quorum.operators import reports
from quorum.operators.reports import Award, Stat

SCHEMA = "season int, period int, team string, opponent string, score double, against double, outcome int, extra double"


@pytest.fixture(scope="module")
def games():
    rnd = random.Random(5)
    out = []
    for p in range(40):
        teams = list("abcdef")
        rnd.shuffle(teams)
        for a, b in zip(teams[::2], teams[1::2]):
            if p > 30 and "f" in (a, b):
                continue  # a team that left
            s, t = float(rnd.randrange(90, 110)), float(rnd.randrange(90, 110))
            o = (s > t) - (s < t)
            out += [(p // 10, p, a, b, s, t, o, None if rnd.random() < 0.2 else float(rnd.randrange(3))), (p // 10, p, b, a, t, s, -o, None)]
    return out


def test_awards(spark, games):
    of = [Award("most score", "score"), Award("least score", "score", high=False), Award("high", "score", "row"), Award("low", "score", "row", False), Award("now", "score", "newest"), Award("wins", "outcome", "sum"), Award("extra", "extra", "row"), Award("low extra", "extra", "sum", False)]
    df = spark.createDataFrame(games, SCHEMA)
    got = {(r.season, r.award): (r.value, r.leaders) for r in reports.awards(df, "team", "period", of, ("season",)).collect()}
    whole = {r.award: (r.value, r.leaders) for r in reports.awards(df, "team", "period", of).collect()}

    def plain(rows):
        last, out = max(r[1] for r in rows), {}
        for a in of:
            i, per = {"score": 4, "outcome": 6, "extra": 7}[a.measure], defaultdict(list)
            for r in rows:
                if r[i] is not None and (a.how != "newest" or r[1] == last):
                    per[r[2]].append(r[i])
            pick = max if a.high else min
            values = {t: round({"sum": sum, "mean": lambda v: sum(v) / len(v)}.get(a.how, pick)(v), 9) for t, v in per.items()}
            if values:
                best = pick(values.values())
                out[a.name] = (best, ", ".join(sorted(t for t, v in values.items() if v == best)))
        return out

    assert whole == plain(games)
    for s in range(4):
        assert {k[1]: v for k, v in got.items() if k[0] == s} == plain([g for g in games if g[0] == s])
    assert any(", " in v[1] for v in got.values())  # ties are there
    assert reports.awards(df.limit(0), "team", "period", of).count() == 0
    with pytest.raises(ValueError):
        reports.awards(df, "team", "period", [of[0], of[0]])


def test_records_set(spark, games):
    stats = [Stat("score", 3, 2, 1, 0), Stat("extra", 5, 0, 2, 2)]
    df = spark.createDataFrame(games, SCHEMA)
    got = sorted(tuple(r) for r in reports.records_set(df, "team", "season", stats, F.col("period") >= 30).collect())
    want = []
    ended = {t: {g[0] for g in games if g[2] == t} for t in "abcdef"}
    for s in stats:
        i = {"score": 4, "extra": 7}[s.name]
        rows = [g for g in games if g[i] is not None]
        for end, sign, league, own in (("top", 1, s.top, s.franchise_top), ("low", -1, s.low, s.franchise_low)):
            for g in rows:
                better = [h for h in rows if sign * h[i] > sign * g[i]]
                if g[1] >= 30 and len(better) < league:
                    want.append(("league", s.name, end, len(better) + 1, g[2], g[i]))
                mine = sum(h[2] == g[2] for h in better)
                if g[1] >= 30 and mine < own and len(ended[g[2]]) > 1 and 3 in ended[g[2]]:
                    want.append(("franchise", s.name, end, mine + 1, g[2], g[i]))
    assert got == sorted(want) and {w[0] for w in want} == {"league", "franchise"}
    plan = reports.records_set(df, "team", "season", stats, F.col("period") >= 30)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # a task passes on but its own best rows
    assert reports.records_set(df.limit(0), "team", "season", stats, F.lit(True)).count() == 0


def test_tidbits(spark):
    rows = [(1, "a", 5.0, 2.0), (1, "b", 5.0, 2.0), (1, "c", 1.0, None), (1, "d", 1.0, None), (2, "a", None, None)]
    df = spark.createDataFrame(rows, "week int, team string, x double, y double")
    got = {(r.week, r.measure): (r.best, r.best_value, r.worst, r.worst_value) for r in reports.tidbits(df, ["week"], "team", ["x", "y"], ("x",)).collect()}
    assert got == {(1, "x"): ("a", 5.0, "c", 1.0), (1, "y"): ("b", 2.0, "a", 2.0)}


def test_pair_cards(spark, games):
    df = spark.createDataFrame(games, SCHEMA)
    divisions = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2), ("f", 2)], "team string, division int")
    got = {(r.team, r.opponent): r for r in reports.pair_cards(df, "season", "period", divisions).collect()}
    assert set(got) == {(g[2], g[3]) for g in games}
    for (a, b), r in got.items():
        met = [g for g in games if (g[2], g[3]) == (a, b)]
        now = [g for g in games if g[0] == 3 and g[2] == a]
        assert (r.games, r.wins, r.losses, r.ties) == (len(met), *(sum(g[6] == o for g in met) for o in (1, -1, 0)))
        assert (r.last_period, r.last_score, r.last_against) == (met[-1][1], met[-1][4], met[-1][5])
        assert r.margin == pytest.approx(sum(g[4] - g[5] for g in met) / len(met)) and r.win_pct == r.wins / r.games
        assert (r.won, r.lost, r.tied) == tuple(sum(g[6] == o for g in now) for o in (1, -1, 0)) and r["of"] == {"a": 3, "b": 3, "c": 3, "d": 2, "f": 2}.get(a)
        assert r.opp_won == got[b, a].won and r.opp_place == got[b, a].place
    assert {got[k].place for k in got if k[0] in "abc"} == {1, 2, 3} and got["e", "a"].place is None
