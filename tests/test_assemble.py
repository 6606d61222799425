"""Pipelines in one call, boards, charts and staff, against plain computations and edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quorum.operators import assemble, board, features, usage
from quorum.operators.assemble import Sources

STATS = ["a", "b", "c"]
SRC = Sources("one", "two", ("book",), ("own",), {"one": 0.5, "two": 0.25, "book": {"a": 0.25}, "own": 0.5}, ("a",))
RULES = [("BASE", "a", 1.0), ("BASE", "b", 2.0), ("X", "a", 0.0), ("X", "c", 3.0)]


def _plain(players, est, identities):
    """Every line and its points, by plain loops."""
    rows = {}
    for p, team, slot in players:
        for s in STATS:
            v = {k: max((e[3] for e in est if e[:3] == (p, s, k) and e[3] is not None), default=None) for k in SRC.all}
            if s == "a" and v["one"] is not None and v["two"] is not None and v["one"] > 1.75 * v["two"] and v["one"] > 40:
                v["one"] /= 2
            gone = {k: x is None for k, x in v.items()}
            v["two"] = v["one"] if v["two"] is None else v["two"]
            both = [x for x in (v["one"], v["two"]) if x is not None]
            mean = sum(both) / len(both) if both else None
            v["book"] = mean if v["book"] is None else v["book"]
            w = {k: (x.get(s, 0.0) if isinstance(x, dict) else x) for k, x in SRC.weights.items()}
            den = sum(w[k] for k in SRC.all if not gone[k])
            v["true"] = sum(v[k] * w[k] for k in SRC.all if not gone[k]) / den if den else sum((v[k] or 0.0) * w[k] for k in SRC.all)
            rows[p, s] = v | {"gone": gone, "mean": mean}
    for l, r in identities:
        for team in {t for _, t, _ in players if t}:
            of = [p for p, t, _ in players if t == team]
            x, y = (sum(rows[p, s]["true"] for p in of) for s in (l, r))
            if x > 0 and y > 0:
                for p in of:
                    rows[p, l]["true"] *= (x + y) / 2 / x
                    rows[p, r]["true"] *= (x + y) / 2 / y
    rule, out = {(a, b): c for a, b, c in RULES}, {}
    for p, _, slot in players:
        for k in (*SRC.all, "mean", "true"):
            priced = [(rows[p, s][k], rule.get((slot, s), rule.get(("BASE", s)))) for s in STATS]
            known = [x for x, c in priced if c is not None and x is not None]
            out[p, k] = sum((x or 0.0) * c for x, c in priced if c is not None) if known else None
        spoke = [k for k in SRC.all if any(not rows[p, s]["gone"][k] and rows[p, s][k] != 0 for s in STATS) and out[p, k] is not None]
        out[p, "n"] = len(spoke)
        out[p, "floor"] = min(out[p, k] for k in spoke) if len(spoke) > 1 else None
    return out


@pytest.fixture(scope="module")
def league():
    rnd = random.Random(8)
    players = [(i, rnd.choice(["s", "t", None]), rnd.choice(["BASE", "X"])) for i in range(40)] + [(99, "u", "BASE")]  # 99: no estimate at all
    est = [(i, s, k, rnd.choice([None, 0.0, float(rnd.randrange(1, 120))])) for i in range(42) for s in [*STATS, "zz"] for k in (*SRC.all, "stranger") if rnd.random() < 0.7]
    return players, est + est[:20]  # repeated rows, unknown players, stats and sources


def _frames(spark, league):
    players, est = league
    p = spark.createDataFrame([(*r, "pos", float(r[0])) for r in players], "id int, team string, slot string, pos string, official double")
    return p, spark.createDataFrame(est, "id int, stat string, source string, value double"), spark.createDataFrame(RULES, "slot string, stat string, points double")


def test_season_projections(spark, league):
    p, e, rules = _frames(spark, league)
    want = _plain(*league, [("a", "b")])
    x = assemble.season_projections(p, e, ["id"], STATS, SRC, [("a", "b")], rules, "slot", "BASE", "team", "pos", "own")
    got = {r.id: r for r in x.collect()}
    assert set(got) == {r[0] for r in league[0]}
    for i, r in got.items():
        for k in (*SRC.all, "true"):
            assert r[f"{k}_points"] == (None if want[i, k] is None else pytest.approx(want[i, k], abs=1e-6)), (i, k)
        assert r.n_sources == want[i, "n"] and r.floor == (None if want[i, "floor"] is None else pytest.approx(want[i, "floor"]))
        assert r.pos_rank == (None if r.true_points is None else 1 + sum(round(o.true_points, 9) > round(r.true_points, 9) for o in got.values() if o.true_points is not None))
        assert r.model_delta == (None if r.own_points is None else r.pos_rank - r.model_rank)
    assert got[99].n_sources == 0 and got[99].one_points is None and got[99].true_points == 0
    with pytest.raises(ValueError):
        assemble.reconciled(x, "team", [("a", "b"), ("b", "c")])
    assert assemble.season_projections(p.limit(0), e, ["id"], STATS, SRC, [("a", "b")], rules, "slot", "BASE", "team", "pos").count() == 0
    assert assemble.season_projections(p, e.limit(0), ["id"], STATS, SRC, [], rules, "slot", "BASE", "team", "pos").where("n_sources = 0").count() == len(league[0])


def test_clean_lineups(spark, league):
    p, e, rules = _frames(spark, league)
    want = _plain(*league, [])
    got = {r.id: r for r in assemble.clean_lineups(p, e, ["id"], STATS, SRC, rules, "slot", "BASE", "official", "official", ["pos"]).collect()}
    for i, r in got.items():
        shift = None if want[i, "one"] is None else i - want[i, "one"]
        for k in (*SRC.all, "mean", "true"):
            v = None if shift is None or want[i, k] is None else want[i, k] + shift
            assert r[f"{k}_points"] == (None if v is None else pytest.approx(v, abs=1e-6))
        assert r.one_rank == (None if shift is None else 1 + len({o.id for o in got.values() if o.one_points is not None and o.id > i}))
    assert len(got) == len(league[0])


def test_board(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["QB", "RB"]), float(rnd.randrange(50, 300)) if i % 9 else None, rnd.choice(["x", "y", None]), 1.0 if i % 5 else None) for i in range(60)]
    pj = spark.createDataFrame(rows, "id int, pos string, points double, team string, espn double")
    mk = spark.createDataFrame([(i, float(min(i * 3, 100)), i, None if i % 2 else 5.0, 1.0, "shadow") for i in range(55)], "id int, adp double, place int, auction_value double, suggested_value double, pos string")
    slots = spark.createDataFrame([("QB", 1), ("RB", 2)], "slot string, count int")
    byes = spark.createDataFrame([("x", 7)], "team string, bye int")
    ids = spark.createDataFrame([(3, "g3")], "id int, gsis string")
    make = lambda p, m: board.build(p, m, slots, {}, 4, ident="id", group="pos", points="points", team="team", opinions=("espn",), streamed=("RB",), byes=byes, ids=ids)
    got = {r.id: r for r in make(pj, mk).collect()}
    assert len(got) == 60 and got[3].gsis == "g3" and got[4].gsis is None
    tiers = {r.id: r.tier for r in board.assign_tiers(pj, "pos", "points", ["id"]).collect()}
    for i, pos, points, team, espn in rows:
        r = got[i]
        assert r.pos == pos and r.bye == (7 if team == "x" else None) and r.tier == tiers.get(i) and r.is_streamed == (pos == "RB")
        assert r.missing == (points is None or espn is None) and r.auction == (None if i >= 55 else 1.0 if i % 2 else 5.0) and r.replacement_rank == {"QB": 4, "RB": 8}[pos]
        assert r.plateau == 99 and r.priced == (i < 55 and min(i * 3, 100) < 99) and (r.value is None) == (not r.priced or pos == "RB" or points is None)
        assert r.price_rank == (i + 1 if r.priced else None)
    assert make(pj.limit(0), mk).count() == 0
    assert {r.priced for r in make(pj, mk.limit(0)).collect()} == {False}


def test_byes_of_aliases(spark):
    games = spark.createDataFrame([("LA", "WAS", 1), ("LA", "NY", 2), ("WAS", "NY", 3), ("SF", "NY", 1)], "home string, away string, week int")
    got = {r.team: r.bye for r in board.bye_periods(games, "home", "away", "week", {"LAR": "LA", "WSH": "WAS", "SFO": "SF", "NY": "LA"}).collect()}
    assert got == {"LA": 3, "WAS": 2, "LAR": 3, "WSH": 2, "NY": 3}  # SF misses two weeks
    assert {r.team: r.bye for r in board.bye_periods(games, "home", "away", "week").collect()} == {"LA": 3, "WAS": 2}
    assert board.bye_periods(games.limit(0), "home", "away", "week", {"a": "b"}).count() == 0


def test_depth_of_both_schemas(spark):
    coarse = spark.createDataFrame([(2024, "NO", "p1", "WR", " 2 ", 1), (2024, "NO", "p2", "WR", "x", 1), (2024, "NO", None, "WR", "1", 1), (2024, "NO", "p3", "RB", "5", 12)], "season int, club string, id string, position string, depth string, week int")
    fine = spark.createDataFrame([(2025, "NO", "q%d" % i, "WR", i, "2025-08-30") for i in range(1, 8)] + [(2025, "NO", "q1", "KR", 1, "2025-08-30"), (2025, "NO", "q9", "QB", 1, "2025-09-02"), (2025, "NO", "q8", "QB", None, "2025-08-30")], "season int, team string, id string, position string, place int, at string")
    x = usage.depth_charts(coarse, fine, "id", {"WR": 3})
    got = {(r.id, r.position): (r.depth_rank, r.as_of) for r in x.collect()}
    assert got == {("p1", "WR"): (2, "01"), ("p3", "RB"): (3, "12"), ("q1", "KR"): (1, "2025-08-30"), ("q9", "QB"): (1, "2025-09-02")} | {(f"q{i}", "WR"): (r, "2025-08-30") for i, r in zip(range(1, 8), (1, 1, 1, 2, 3, 3, 3))}
    f = usage.preseason_depth(x, "id", "season", "as_of", "team", "position", "depth_rank", usage.before_opening("as_of", "season"), ("WR", "RB", "QB"))
    assert {(r.season, r.id): (r.depth_rank, r.depth_group) for r in f.where("season = 2025").collect()} == {(2025, f"q{i}"): (r, 7) for i, r in zip(range(1, 8), (1, 1, 1, 2, 3, 3, 3))}
    assert [r.id for r in f.where("season = 2024").collect()] == ["p3"]  # weeks are all before the opening; the last counts
    assert usage.depth_charts(coarse.limit(0), fine.limit(0), "id", {"WR": 3}).count() == 0


def test_no_window_holds_a_season(spark):
    rows = [(s, "T%d" % (i % 2), "p%d" % (i % 5), "WR", i % 3 + 1, at) for s, dates in ((None, ["2020-01-01", None]), (2021, ["2021-10-01", "2021-11-01"]), (2022, ["2022-08-01", "2022-08-09", "2022-09-01"])) for at in dates for i in range(6)]
    x = spark.createDataFrame(rows, "season int, team string, id string, position string, depth_rank int, as_of string")
    f = usage.preseason_depth(x, "id", "season", "as_of", "team", "position", "depth_rank", usage.before_opening("as_of", "season"))
    best = {"p0": (1, "T0", 3), "p1": (2, "T1", 2), "p2": (3, "T0", 3), "p3": (1, "T1", 2), "p4": (2, "T0", 3)}
    assert {(r.season, r.id): (r.depth_rank, r.depth_team, r.depth_group) for r in f.collect()} == {(s, k): v for s in (None, 2021, 2022) for k, v in best.items()}
    first = features.first_snapshot(x.select("season", F.month(F.col("as_of").cast("date")).alias("week")), "season", "week")
    assert sorted(map(tuple, first.distinct().collect()), key=str) == [(2021, 10), (2022, 8), (None, 1)] and first.count() == 6 + 6 + 12
    rosters = x.select("season", "team", "id", F.month(F.col("as_of").cast("date")).alias("week"), F.lit(2020).alias("entry"), F.lit("2000-01-01").cast("date").alias("born"))
    context = usage.roster_context(rosters, rosters.groupBy("id", "season").agg(F.max("team").alias("team")), "id", "season", "week", "team", "entry", "born")
    assert context.where("season = 2022").count() == 12 and context.where("season = 2022 AND prior_team IS NOT NULL").count() == 12
    for df in (f, first, context):
        assert not re.search(r"(min|max|count)\([^\n]*windowspecdefinition", df._jdf.queryExecution().toString())


def test_staff(spark):
    games = spark.createDataFrame([(2023, "A", "x"), (2023, "A", "y"), (2023, "A", "y"), (2023, "B", "w"), (2023, "B", "v"), (2024, "A", "y"), (2024, "B", "v")], "season int, team string, coach string")
    played = usage.season_staff(games, "season", "team", "coach", "games")
    assert {(r.season, r.team): (r.head_coach, r.games_coached, r.team_games, r.changed_midseason) for r in played.collect()} == {(2023, "A"): ("y", 2, 3, True), (2023, "B"): ("v", 1, 2, True), (2024, "A"): ("y", 1, 1, False), (2024, "B"): ("v", 1, 1, False)}
    live = spark.createDataFrame([(2024, "A", "z", "oc", "articles")], "season int, team string, head_coach string, offence string, source string")
    crawled = spark.createDataFrame([(2023, "A", "old"), (2024, "A", "not this")], "season int, team string, offence string")
    got = {(r.season, r.team): (r.head_coach, r.source, r.offence) for r in usage.merge_staff(played, live, crawled, "season", "team", ["offence"]).collect()}
    assert got == {(2023, "A"): ("y", "games", "old"), (2023, "B"): ("v", "games", None), (2024, "A"): ("z", "articles", "oc"), (2024, "B"): ("v", "games", None)}
