"""Joins beyond the built-in ones: as-of, guarded against fan-out, in two stages, diffs and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, take: list[str], tie: str) -> DataFrame:
    """For each left row the right row of its key with the greatest time not after its own (greatest tie of equals).

    One shuffle: both sides are united and the last right row is carried forward, so no range join is needed.
    """
    row = F.struct(F.col(right_time).alias("_t"), F.col(tie).alias("_tie"), *take)
    r = right.select(F.col(by), F.col(right_time).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_order"), row.alias("_row"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_left"))
    x = left.select(F.col(by), F.col(left_time).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_order"), F.lit(None).cast(r.schema["_row"].dataType).alias("_row"), F.struct("*").alias("_left"))
    w = Window.partitionBy(by).orderBy("_at", "_side", F.col("_order").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return r.unionByName(x).withColumn("_last", F.last("_row", ignorenulls=True).over(w)).where("_side = 1").select("_left.*", *(F.col(f"_last.{c}").alias(c) for c in take))


def unique_keys(dim: DataFrame, key: str) -> DataFrame:
    """The rows whose key no other row has; ambiguous and null keys match nothing."""
    n = F.count("*").over(Window.partitionBy(key))
    return dim.where(F.col(key).isNotNull()).withColumn("_n", n).where("_n = 1").drop("_n")


def left_unique(left: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join that never adds rows."""
    return left.join(unique_keys(dim, key), key, "left")


def id_then_name(left: DataFrame, dim: DataFrame, ident: str, name: str, value: str) -> DataFrame:
    """value by id, or else by name; of a dim's rows with one id or name, the smallest value counts."""
    by_id = dim.where(F.col(ident).isNotNull()).groupBy(ident).agg(F.min(value).alias("_by_id"))
    by_name = dim.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(value).alias("_by_name"))
    return left.join(by_id, ident, "left").join(by_name, name, "left").withColumn(value, F.coalesce("_by_id", "_by_name")).drop("_by_id", "_by_name")


def full_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """added, removed or changed keys, with both values; null keys equal null keys."""
    o, n = old.select(*keys, F.col(value).alias("old_value"), F.lit(1).alias("_o")), new.select(*keys, F.col(value).alias("new_value"), F.lit(1).alias("_n"))
    on = reduce(lambda a, b: a & b, (o[k].eqNullSafe(n[k]) for k in keys))
    j = o.join(n, on, "full")
    what = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    return j.select(*(F.coalesce(o[k], n[k]).alias(k) for k in keys), "old_value", "new_value", what.alias("change")).where(F.col("change").isNotNull())


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old whose keys new lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def keep_recorded_at(old: DataFrame, new: DataFrame, content: list[str], stamp: str) -> DataFrame:
    """new with old's stamp on rows whose content did not change."""
    o = old.groupBy(*content).agg(F.min(stamp).alias("_old"))
    on = reduce(lambda a, b: a & b, (new[c].eqNullSafe(o[c]) for c in content))
    return new.join(o, on, "left").select(*(new[c] for c in new.columns if c != stamp), F.coalesce("_old", new[stamp]).alias(stamp))


def left_suffixed(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Left join; right columns that left has too get a suffix."""
    clash = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in keys}
    return left.join(right.withColumnsRenamed(clash), keys, "left")


def calendar_expansion(members: DataFrame, calendar: DataFrame, keys: list[str]) -> DataFrame:
    """Every member against every date of its group: many to many within a key."""
    return members.join(calendar, keys)


def without_latest(df: DataFrame, order: list[str]) -> DataFrame:
    """df without the rows of its greatest combination of columns."""
    last = df.agg(F.max(F.struct(*order)).alias("_last"))  # one row
    return df.crossJoin(last).where(~F.struct(*order).eqNullSafe(F.col("_last"))).drop("_last")


def data_moved(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row: keys whose values differ or that one side lacks, keys of both, and whether anything moved."""
    o, n = old.select(*keys, F.struct(*values).alias("_o")), new.select(*keys, F.struct(*values).alias("_n"))
    g = o.join(n, keys, "full").agg(F.count_if(~F.col("_o").eqNullSafe(F.col("_n"))).alias("moved"), F.count("*").alias("keys"))
    return g.withColumn("fresh", F.col("moved") > 0)
