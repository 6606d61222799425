import datetime
import json

import pytest
from pyspark.sql import functions as F

from quorum.functions import distributions
from quorum.operators import model
from quorum.sources import landed, store
from quorum.streaming import incremental


def test_store_versions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "a"))
    one = spark.createDataFrame([(1, 2.0), (2, None)], "k int, v double")
    s.write(2024, "x", board=one)
    held = s.read(2024, "x", "board")
    s.write(2024, "x", board=one.where("k = 1"), other=one)
    assert held.count() == 2 and s.read(2024, "x", "board").count() == 1  # a reader keeps what it holds
    meta = s.meta(2024, "x")
    assert meta["number"] == 2 and meta["artifacts"]["other"]["coverage"] == {"k": 1.0, "v": 0.5}
    s.write(2023, "x", board=one)
    assert s.leagues() == [(2023, "x"), (2024, "x")]
    assert s.required([2023, 2024], "x", "board").count() == 3 and s.seasons("other").count() == 2
    with pytest.raises(FileNotFoundError):
        s.required([2022], "x", "board")
    assert len(s.sweep(2024, "x", keep=1)) == 2 and s.read(2024, "x", "board").count() == 1
    assert not s.stale(2024, "x", 5) and s.stale(1999, "x", 5)
    c = {r.artifact: r for r in store.catalogue(spark, str(tmp_path / "a")).collect()}
    assert c["board"].seasons == 2 and c["other"].seasons == 1 and c["board"].bytes > 0
    path = f"{s.folder(2023, 'x')}/{s.meta(2023, 'x')['artifacts']['board']['file']}"
    assert store.footprint(spark, path) == (2, ["k", "v"])


def test_mirror_and_checksums(spark, tmp_path):
    src, dst = tmp_path / "src", tmp_path / "dst"
    (src / "d").mkdir(parents=True)
    (src / "d" / "a.txt").write_text("a")
    (src / "b.txt").write_text("b")
    assert store.mirror(spark, str(src), str(dst)) == []
    a, b = store.checksums(spark, str(src)), store.checksums(spark, str(dst))
    assert store.verify(a, b).count() == 0 and store.fingerprint(a) == store.fingerprint(b)
    (dst / "b.txt").write_text("c")
    (dst / ".b.txt.crc").unlink(missing_ok=True)  # a local file system's own checksum
    assert [r.name for r in store.verify(a, store.checksums(spark, str(dst))).collect()] == ["b.txt"]


def test_dated_and_checked(spark, tmp_path):
    df = spark.createDataFrame([(1, 1), (2, 2)], "k int, week int")
    store.snapshot(df, str(tmp_path / "s"), "2024-01-02")
    store.snapshot(df.limit(1), str(tmp_path / "s"), "2024-01-09")
    assert store.latest_snapshot(spark.read.parquet(str(tmp_path / "s"))).count() == 1
    with pytest.raises(ValueError):
        store.snapshot(df, str(tmp_path / "s"), "2024-1-2")
    assert store.checked(df, ["k"], week="week").count() == 2
    with pytest.raises(ValueError):
        store.checked(df, ["k"], week="week", weeks=(2, 5))


def test_csv_registry(spark, tmp_path):
    p = str(tmp_path / "r")
    store.write_csv(spark.createDataFrame([(1, None), (2, "x")], "k int, slot string"), p)
    got = store.registry(spark, p, "k int, slot string", "slot", "BASE")
    assert got is store.registry(spark, p, "k int, slot string", "slot", "BASE")
    assert {tuple(r) for r in got.collect()} == {(1, "BASE"), (2, "x")}
    assert dict(store.csv(spark, p).dtypes)["k"] == "int"


def test_market_entries(spark):
    line = {"seasonId": 2024, "statSourceId": 1, "statSplitTypeId": 0, "appliedTotal": 99.5, "stats": {"210": 16.0, "3": 250.0}}
    rows = [{"id": 1, "onTeamId": 4, "draftAuctionValue": 0, "keeperValue": -1, "player": {"id": 7, "fullName": "A", "eligibleSlots": [0, 20], "stats": [line]}}, {"id": 2, "onTeamId": 0, "draftAuctionValue": 12, "keeperValue": 3, "player": {"id": 8, "fullName": "B", "eligibleSlots": [], "stats": []}}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows + rows[:1]], "j string")
    got = {r.player_id: r for r in store.market_entries(df, "j", 2024, {"yards": "3"}).collect()}
    assert len(got) == 2 and (got[7].auction_value, got[7].keeper_value, got[7].points, got[7].games, got[7].yards) == (None, None, 99.5, 16.0, 4000.0)
    assert (got[8].auction_value, got[8].keeper_value, got[8].points, got[8].games) == (12.0, 3.0, 0.0, None)


def test_landed(spark):
    j = {"season": 2024, "injuries": [{"team": "T", "injuries": [{"athlete": {"id": 1, "displayName": "A"}, "status": "Out", "date": "2024-08-01T10:00Z", "shortComment": "n", "details": {"returnDate": "2024-09-09", "type": "x"}}, {"athlete": {"id": 2, "displayName": "B"}, "status": "Q", "date": "soon"}]}]}
    got = {r.player_id: r for r in landed.injuries(spark.createDataFrame([(json.dumps(j),)], "j string"), "j").collect()}
    assert got[1].return_date == datetime.date(2024, 9, 9) and got[2].return_date is None and got[2].reported is None
    d = {"season": 2020, "picks": [{"overall": 1, "round": 1, "team": 3, "owners": "x", "player": 9, "bid": 0.0, "keeper": False}, {"overall": 2, "round": 1, "team": 4, "owners": '["y", "z"]', "player": 8, "bid": 5.0, "keeper": True}]}
    assert [(r.owner, r.bid) for r in landed.draft_history(spark.createDataFrame([(json.dumps(d),)], "j string"), "j").orderBy("overall").collect()] == [("x", None), ("y", 5.0)]
    h = spark.createDataFrame([(1, "<TABLE><tr><th>A</th><td> <i>b</i>  c</td></tr></TABLE>"), (2, "none"), (3, None)], "p int, h string")
    assert [tuple(r) for r in landed.html_rows(h, "h", ["p"]).collect()] == [(1, 0, ["A", "b c"])]


def test_infobox(spark):
    t = "{{Infobox\n| name = [[A B|Ann]]<ref>x</ref>\n| empty =\n}}"
    assert tuple(store.infobox(spark.createDataFrame([(t,)], "t string"), "t", ["name", "empty", "none"]).select("name", "empty", "none").first()) == ("Ann", None, None)


def test_nightly_boards(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00")], "k int, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(src)
    stream = lambda: spark.readStream.schema("k int, at timestamp").parquet(src)
    incremental.nightly_boards(stream(), out, str(tmp_path / "c"), "at").awaitTermination()
    assert {(r.k, str(r.date)) for r in spark.read.parquet(out).collect()} == {(1, "2024-01-01"), (2, "2024-01-02")}
    incremental.latest_board(stream(), str(tmp_path / "l"), str(tmp_path / "c2"), ["k"], "at").awaitTermination()
    assert incremental.table(spark, str(tmp_path / "l"), ["k"], ["at"], "k int, at timestamp").count() == 2


def test_model_files_and_variance(spark, tmp_path):
    df = spark.createDataFrame([("a", float(x), 3.0 * x + 1e6) for x in range(50)], "g string, x double, y double")
    fit = model.fit(df, "g", ["x"], "y")
    model.save(fit, str(tmp_path / "m"))
    got = {r.term: r.value for r in model.load(spark, str(tmp_path / "m"), "g").collect()}
    assert abs(got["x"] - 3) < 1e-9 and abs(got["intercept"] - 1e6) < 1e-6
    v = spark.createDataFrame([(float(m), (2 * m + m * m / 4) ** 0.5) for m in range(1, 60)], "m double, r double")
    phi, inv = model.fit_variance(v, "m", "r")
    assert abs(phi - 2) < 1e-6 and abs(inv - 0.25) < 1e-6


def test_games_interval(spark):
    df = spark.createDataFrame([(0.0,), (8.5,), (17.0,), (None,)], "m double")
    got = [r[0] for r in df.select(distributions.games_interval("m", 17, 0.05, 0.5)).collect()]
    assert got[0] == 0 and 8 <= got[1] <= 9 and got[2] == 17 and got[3] is None


def test_streams_of_counts_and_first_rows(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, "2024-01-01 10:05:00", "a"), (1, "2024-01-01 10:05:00", "a"), (2, "2024-01-01 11:10:00", "a"), (3, "2024-01-01 10:50:00", "b")]
    spark.createDataFrame(rows, "k int, at string, kind string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(src)
    stream = lambda: spark.readStream.schema("k int, at timestamp, kind string").parquet(src)
    for name, df, mode in (("counts", incremental.windowed_counts(stream(), "at", "kind"), "complete"), ("first", incremental.first_seen(stream(), "at", ["k"]), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert {(str(r.start), r.kind, r.n) for r in spark.table("counts").collect()} == {("2024-01-01 10:00:00", "a", 2), ("2024-01-01 11:00:00", "a", 1), ("2024-01-01 10:00:00", "b", 1)}
    assert sorted(r.k for r in spark.table("first").collect()) == [1, 2, 3]


def test_data_moved_is_seen_while_writing(spark, tmp_path):
    """Equal to comparing the tables, in the job that writes: one scan, no join."""
    import random

    from quorum.operators import joins

    rnd, schema = random.Random(2), "k int, a double, b string, m map<string,int>"
    rows = [(i, rnd.choice([None, 1.5, i]) and float(rnd.choice([1.5, i])), rnd.choice([None, "x", ""]), {"n": i % 3}) for i in range(60)]

    def change(i):
        new = list(rows)
        if i == 1:
            rnd.shuffle(new)
        elif i == 2:
            new[5] = (5, 99.0, new[5][2], new[5][3])
        elif i == 3:
            new.pop()
        elif i == 4:  # two rows exchange a value
            new[0], new[1] = (0, 7.0, "x", {"n": 0}), (1, 8.0, "x", {"n": 1})
        elif i == 5:
            new[9] = (9, new[9][1], None if new[9][2] is not None else "", new[9][3])
        return new

    for i in range(6):
        s, df, new = store.Store(spark, f"{tmp_path}/{i}"), spark.createDataFrame(rows, schema), spark.createDataFrame(change(i), schema)
        assert s.write(2024, "x", board=df) == {"board": True}
        plain = [x.drop("m") for x in (df, new)]
        assert s.write(2024, "x", board=new.repartition(1 + i)) == {"board": joins.data_moved(*plain, ["k"], ["a", "b"]).first().fresh}
        assert s.write(2024, "x", board=new) == {"board": False}
    assert s.write(2024, "x", board=new.union(new)) == {"board": True}  # repeated rows do not cancel
    spark.range(9).write.parquet(f"{tmp_path}/p")
    seen, out = store.watched(spark.read.parquet(f"{tmp_path}/p"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "CollectMetrics" in plan and "Exchange" not in plan
    out.write.format("noop").mode("overwrite").save()
    assert store.checksum_of(seen).startswith("9:")
