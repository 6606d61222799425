"""Incremental forms of the batch operators as Structured Streaming queries.

Accumulations keep one row per key in Spark's state store.  A micro-batch appends the rows that it makes newest to a log of changes, so that
the bytes written follow the batch and not the table; the table is the newest row per key over the log, whatever the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from ..sources.store import Store

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ordered(df: DataFrame, keys: list[str], order: list[str]) -> list[str]:
    """Columns by which rows of a key compare: those of the order, then all others, so that no two different rows are equal."""
    return [*order, *(c for c in df.columns if c not in (*order, *keys))]


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The greatest row per key by `order`, nulls least, ties by the other columns: the same aggregate over a table and over a stream, where its buffers are the state."""
    cols = _ordered(rows, keys, order)
    return rows.groupBy(*keys).agg(F.max(F.struct(*cols)).alias("_row")).select(*keys, "_row.*").select(*rows.columns)


class Newest(StatefulProcessor):
    """newest() with state that expires: a key that is silent for `expiry` milliseconds is forgotten."""

    def __init__(self, cols: list[str], schema: StructType, expiry: int):
        self.cols, self.names, self.expiry = cols, schema.names, expiry
        self.schema = StructType([schema[c] for c in (*cols, *(c for c in schema.names if c not in cols))])

    def init(self, handle) -> None:
        self.state = handle.getValueState("newest", self.schema, self.expiry)

    def handleInputRows(self, key, rows, timerValues):
        def place(row) -> tuple:
            return tuple((v is not None, v) for v in row[: len(self.cols)])

        old = tuple(self.state.get()) if self.state.exists() else None
        best = old
        for r in rows:
            row = tuple(r[c] for c in self.schema.names)
            if best is None or place(row) > place(best):
                best = row
        if best != old:
            self.state.update(best)
            whole = dict(zip(self.schema.names, best))
            yield Row(**{c: whole[c] for c in self.names})

    def close(self) -> None:
        pass


def changes(stream: DataFrame, keys: list[str], order: list[str], expiry: int | None = None) -> DataFrame:
    """The rows that each micro-batch makes newest, for output mode update.  With `expiry` (milliseconds) state is bounded by the keys of that time; a key that
    comes back later is new again, which the log's readers settle.  Expiry takes the state store of RocksDB (`ROCKS` as spark.sql.streaming.stateStore.providerClass)."""
    if expiry is None:
        return newest(stream, keys, order)
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})  # a key with nulls as one string without
    return stream.withColumn("_key", key).groupBy("_key").transformWithState(Newest(_ordered(stream, keys, order), stream.schema, expiry), stream.schema, "Update", "ProcessingTime")


def _batch(path: str, number: int) -> str:
    return f"{path}/batch={number:09d}"


def put(path: str):
    """A sink: each micro-batch is a folder of the log under its number, so a replayed one replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_batch(path, number))

    return write


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], expiry: int | None = None) -> StreamingQuery:
    """Keeps the newest row per key; table() reads it.  What has arrived is taken in the source's batches, with `expiry` in one batch: state that expires by the
    clock makes Spark run empty batches after the last one, so taking all that is available would never end."""
    out = changes(stream, keys, order, expiry).writeStream.outputMode("update").foreachBatch(put(path)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if expiry is None else out.trigger(once=True)).start()


def _log(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """Folders that make up the table, and the number of the last batch among them."""
    names = Store(spark, path)._names(path)
    base = max((x for x in names if x.startswith("base=")), default=None)
    after = int(base[5:]) if base else -1
    later = [x for x in names if x.startswith("batch=") and int(x[6:]) > after]
    return [f"{path}/{x}" for x in ([base] if base else []) + later], max([after, *(int(x[6:]) for x in later)])


def table(spark: SparkSession, path: str, keys: list[str], order: list[str], schema: StructType | str) -> DataFrame:
    """The newest row per key of a log: one partial aggregate and one shuffle over what was appended since it was last compacted."""
    folders, _ = _log(spark, path)
    rows = spark.read.schema(schema)
    return newest(rows.parquet(*folders), keys, order) if folders else spark.createDataFrame([], schema)


def compact(spark: SparkSession, path: str, keys: list[str], order: list[str], schema: StructType | str) -> list[str]:
    """Writes the table as a new base, which counts once it is renamed, and removes the folders that the base before it has replaced; those that readers may
    still hold stay until the next call.  Returns what went."""
    store, (folders, last) = Store(spark, path), _log(spark, path)
    before = max((int(x[5:]) for x in store._names(path) if x.startswith("base=")), default=-1)
    if last > before:
        stage = f"{path}/_base={last:09d}"
        newest(spark.read.schema(schema).parquet(*folders), keys, order).write.mode("overwrite").parquet(stage)
        fs, p, jvm = store._fs(stage)
        if not fs.rename(p, jvm.org.apache.hadoop.fs.Path(f"{path}/base={last:09d}")):
            raise FileExistsError(f"{path} was compacted meanwhile")
    gone = [x for x in store._names(path) if x.startswith("batch=") and int(x[6:]) <= before or x.startswith("base=") and int(x[5:]) < before]
    for x in gone:
        fs, p, _ = store._fs(f"{path}/{x}")
        fs.delete(p, True)
    return gone


def windowed_counts(stream: DataFrame, at: str, key: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts per key and tumbling window; rows later than the watermark are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def first_seen(stream: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def latest_board(stream: DataFrame, path: str, checkpoint: str, keys: list[str], at: str) -> StreamingQuery:
    """The newest row per key of dated boards as they arrive: upsert_stream() by their date."""
    return upsert_stream(stream, path, checkpoint, keys, [at])


def nightly_boards(stream: DataFrame, path: str, checkpoint: str, at: str) -> StreamingQuery:
    """One dated partition a night: a batch replaces the partitions of the dates that it holds and leaves others alone."""

    def put(batch: DataFrame, _: int) -> None:
        batch.withColumn("date", F.to_date(at).cast("string")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
