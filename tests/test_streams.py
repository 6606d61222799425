"""Accumulating streams: equal to the batch operator over any order of arrival, replayed batches, compaction, expiry."""

import random

import pytest
from pyspark.sql import functions as F

from quorum.streaming import incremental

SCHEMA = "k int, g string, at int, v string"


def vals(df):
    return sorted(map(tuple, df.select("k", "g", "at", "v").collect()), key=str)


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    some = [(rnd.choice([None, *range(8)]), rnd.choice(["x", None]), rnd.choice([None, *range(6)]), rnd.choice([None, "a", "b"])) for _ in range(120)]
    return spark.createDataFrame(some, SCHEMA)


def start(spark, rows, tmp_path, files, name, expiry=None):
    rows.orderBy(F.rand(files)).repartition(files).write.mode("append").parquet(f"{tmp_path}/{name}-in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}-in")
    assert incremental.upsert_stream(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-cp", ["k", "g"], ["at"], expiry).awaitTermination(60)
    return incremental.table(spark, f"{tmp_path}/{name}", ["k", "g"], ["at"], SCHEMA)


def test_any_order_of_arrival(spark, rows, tmp_path):
    want = vals(incremental.newest(rows, ["k", "g"], ["at"]))
    assert len(want) == rows.select("k", "g").distinct().count()
    for files in (1, 3):
        assert vals(start(spark, rows, tmp_path, files, f"n{files}")) == want


def test_replayed_batches_and_compaction(spark, rows, tmp_path):
    path, args = f"{tmp_path}/n", (["k", "g"], ["at"], SCHEMA)
    want = vals(start(spark, rows, tmp_path, 3, "n"))
    last = spark.read.schema(SCHEMA).parquet(f"{path}/batch=000000002")
    incremental.put(f"{tmp_path}/copy")(last, 2)
    incremental.put(path)(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/copy/batch=000000002"), 2)  # as after a lost driver
    assert vals(incremental.table(spark, path, *args)) == want
    assert incremental.compact(spark, path, *args) == [] and vals(incremental.table(spark, path, *args)) == want
    more = spark.createDataFrame([(1, "x", 99, "new"), (77, "x", 0, "other")], SCHEMA)
    got = start(spark, more, tmp_path, 1, "n")
    want = vals(incremental.newest(rows.union(more), ["k", "g"], ["at"]))
    assert vals(got) == want
    assert len(incremental.compact(spark, path, *args)) == 3  # the batches that the first base holds
    assert vals(incremental.table(spark, path, *args)) == want


def test_bytes_follow_the_batch(spark, tmp_path):
    size = lambda p: sum(x.stat().st_size for x in p.rglob("*.parquet"))
    many = spark.range(20_000).selectExpr("CAST(id AS INT) AS k", "'x' AS g", "1 AS at", "sha(CAST(id AS STRING)) AS v")
    start(spark, many, tmp_path, 1, "n")
    start(spark, spark.createDataFrame([(5, "x", 2, "newer"), (6, "x", 0, "older")], SCHEMA), tmp_path, 1, "n")
    first, second = (size(tmp_path / f"n/batch=00000000{i}") for i in (0, 1))
    assert second < first / 50


def test_state_that_expires(spark, rows, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", incremental.ROCKS)
    try:
        for part in rows.randomSplit([0.4, 0.3, 0.3], 1):  # one run each
            kept = start(spark, part, tmp_path, 1, "t", expiry=3_600_000)
            gone = start(spark, part, tmp_path, 1, "s", expiry=1)  # forgotten at once
        want = vals(incremental.newest(rows, ["k", "g"], ["at"]))
        assert vals(kept) == want and vals(gone) == want
        log = [spark.read.parquet(f"{tmp_path}/{x}").count() for x in "ts"]
        assert len(want) <= log[0] < log[1]  # what is remembered is not said again
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
