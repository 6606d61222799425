"""Ranked boards: value over a replacement level, flexible openings, tiers, market comparison, budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from .handcuff import attach_handcuff
from .present import global_ranks
from .ranges import clusters
from .shape import constants


def flex_ranks(df: DataFrame, group: str, points: str, ident: str, slots: DataFrame, openings: int) -> DataFrame:
    """group, rank: dedicated places of each group (slots: group, dedicated) and its share of the open places, by points.

    Rows beyond a group's dedicated places compete for the openings; only groups in slots take part.
    """
    by = Window.partitionBy(group).orderBy(F.col(points).desc(), ident)
    # only `openings` rows of a group can win one, so the global order sees a bounded number of rows
    rest = df.join(slots, group).withColumn("_n", F.row_number().over(by)).where((F.col("_n") > F.col("dedicated")) & (F.col("_n") <= F.col("dedicated") + openings))
    won = rest.orderBy(F.col(points).desc(), ident).limit(openings).groupBy(group).agg(F.count("*").alias("_won"))
    return slots.join(won, group, "left").select(group, F.greatest(F.lit(1).cast("long"), F.col("dedicated").cast("long") + F.coalesce("_won", F.lit(0).cast("long"))).alias("rank"))


def starting_slots(slots: DataFrame, bench: tuple[str, ...] = ("BE", "IR")) -> DataFrame:
    """The slots (slot, count) that a line-up starts."""
    return slots.where(~F.col("slot").isin(*bench) & (F.col("count") > 0))


def replacement_ranks(df: DataFrame, group: str, points: str, ident: str, slots: DataFrame, flex: dict[str, list[str]], teams: int) -> DataFrame:
    """group, rank: how many of each group start in `teams` line-ups of the slots (slot, count).

    A flexible slot's openings go to the best of its eligible groups beyond their dedicated places, scaled up where the pool runs
    out and divided evenly where it has nobody; totals round half to even, and a group that rounds to none has no rank.
    """
    own = slots.where(~F.col("slot").isin(*flex)).groupBy(F.col("slot").alias(group)).agg((F.sum("count") * teams).alias("_ded"))
    parts = [own.select(group, F.col("_ded").cast("double").alias("_share"))]
    opened = {r["slot"]: teams * int(r["n"]) for r in slots.where(F.col("slot").isin(*flex)).groupBy("slot").agg(F.sum("count").alias("n")).collect()}  # a handful of slots
    by = Window.partitionBy(group).orderBy(F.col(points).desc(), ident)
    for slot, n in sorted(opened.items()):
        even = constants(df.sparkSession, [(g, n / len(flex[slot])) for g in flex[slot]], f"`{group}` string, _even double")
        x = df.where(F.col(group).isin(*flex[slot]) & F.col(points).isNotNull()).join(own, group, "left").withColumn("_beyond", F.row_number().over(by) - F.coalesce("_ded", F.lit(0)))
        won = x.where((F.col("_beyond") >= 1) & (F.col("_beyond") <= n)).orderBy(F.col(points).desc(), ident).limit(n).groupBy(group).agg(F.count("*").alias("_won"))
        filled = won.agg(F.coalesce(F.sum("_won"), F.lit(0)).alias("_filled"))
        share = F.when(F.col("_filled") == 0, F.col("_even")).otherwise(F.coalesce("_won", F.lit(0)) * (F.lit(float(n)) / F.nullif(F.col("_filled"), F.lit(0))))
        parts.append(even.join(won, group, "left").crossJoin(filled).select(group, share.alias("_share")))
    total = reduce(DataFrame.union, parts).groupBy(group).agg(F.bround(F.sum("_share"), 0).cast("long").alias("rank"))
    return total.where("rank >= 1")


def value_over_replacement(df: DataFrame, group: str, points: str, ranks: DataFrame) -> DataFrame:
    """points less the best points at or below the group's replacement rank (the lowest points where the group is short)."""
    pos = F.when(F.col(points).isNotNull(), F.rank().over(Window.partitionBy(group).orderBy(F.col(points).desc_nulls_last())))
    x = df.join(ranks, group, "left").withColumn("pos_rank", pos)
    w = Window.partitionBy(group)
    base = F.coalesce(F.max(F.when(F.col("pos_rank") >= F.coalesce("rank", F.lit(1)), F.col(points))).over(w), F.min(points).over(w))
    return x.withColumn("vor", F.col(points) - base)


def assign_tiers(df: DataFrame, group: str, points: str, keep: list[str]) -> DataFrame:
    """keep, group, points and tier, 1 the highest: exact one-dimensional k-means of each group (ranges.clusters), of which no task holds the rows."""
    x = df.select(*keep, group, points).where(F.col(points).isNotNull())
    cuts = clusters(x, group, points).select(F.col(group).alias("_g"), "cuts")
    tier = 1 + F.size(F.filter("cuts", lambda c: c > F.col(points).cast("double")))
    return x.join(cuts, F.col(group).eqNullSafe(F.col("_g"))).withColumn("tier", tier.cast("int")).drop("_g", "cuts")


def plateau(df: DataFrame, value: str, by: str, least: float = 0.05) -> DataFrame:
    """Per group the modal rounded value less one, where at least two rows and a share `least` have it (the smallest of equals)."""
    n = df.where(F.col(value).isNotNull()).groupBy(by, F.bround(value, 0).cast("long").alias("level")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    n = n.withColumn("_all", F.sum("n").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.col("n").desc(), "level")))
    return n.where("_rn = 1").where((F.col("n") >= 2) & (F.col("n") >= least * F.col("_all"))).select(by, (F.col("level") - 1).alias("plateau"), "n")


def missing_period(df: DataFrame, entity: str, period: str) -> DataFrame:
    """The one period of the calendar in which an entity has no row; entities that miss none or several give none."""
    seen = df.select(entity, period).distinct()
    grid = seen.select(entity).distinct().crossJoin(seen.select(period).distinct())
    gone = grid.join(seen, [entity, period], "left_anti")
    return gone.groupBy(entity).agg(F.count("*").alias("_n"), F.min(period).alias("missing")).where("_n = 1").drop("_n")


def bye_periods(games: DataFrame, home: str, away: str, period: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """team, bye: the one period in which a team is on neither side; aliases (another's spelling to the games') get their team's too, over a team of that name."""
    played = games.select(F.explode(F.array(home, away)).alias("team"), period)
    byes = missing_period(played, "team", period).select("team", F.col("missing").alias("bye"))
    if not aliases:
        return byes
    spelt = constants(games.sparkSession, sorted(aliases.items()), "alias string, team string").join(byes, "team").select(F.col("alias").alias("team"), "bye")
    return byes.join(spelt, "team", "left_anti").unionByName(spelt)


def build(projections: DataFrame, market: DataFrame, slots: DataFrame, flex: dict[str, list[str]], teams: int, *, ident: str, group: str, points: str, team: str, price: str = "adp", place: str = "place", auction: tuple[str, str] = ("auction_value", "suggested_value"), opinions: tuple[str, ...] = (), streamed: tuple[str, ...] = (), byes: DataFrame | None = None, ids: DataFrame | None = None, handcuffs: tuple[DataFrame, DataFrame, str] | None = None) -> DataFrame:
    """A draft board: one row per projection, with what the market, the schedule and the backfield say of it.

    projections: ident (unique), group, points, team, and columns of single opinions; market: ident (unique), price, place (another's ranking), two auction values;
    slots (slot, count) and flex (slot to its groups) of a line-up; byes: team, bye; ids: ident and whatever else the board carries over; handcuffs: strength by team,
    a fitted line, and the group it is of.

    Adds pos_rank, replacement_rank, startable, vor, vor_rank, tier, plateau (of the prices), priced, price_rank, is_streamed, value, rank_delta, pos_rank_delta,
    auction, missing (no opinion, or no points), bye, teams, and with handcuffs backfield_rank, handcuff_carries, handcuff_premium and handcuff_r2.  A market's columns
    that the projections have too are not taken; rows without points have no rank, tier or value.
    """
    known = set(projections.columns) - {ident}
    x = projections.join(market.select(*(c for c in market.columns if c not in known)), ident, "left")
    ranks = replacement_ranks(projections, group, points, ident, slots, flex, teams)
    x = value_over_replacement(x, group, points, ranks).withColumnRenamed("rank", "replacement_rank")
    level = plateau(market.select(price, F.lit(1).alias("_all")), price, "_all").select("plateau")
    x = x.join(level, F.lit(True), "left")  # one row at most
    priced = F.col(price).isNotNull() & F.coalesce(F.col(price) < F.col("plateau"), F.lit(True))
    x = x.withColumns({"priced": priced, "is_streamed": F.coalesce(F.col(group).isin(*streamed), F.lit(False)), "startable": F.col("replacement_rank").isNotNull()})
    x = market_comparison(x, "vor", price, place, group, "pos_rank", ident, F.col("priced"), F.col("is_streamed"), price_rank=True)
    x = x.join(assign_tiers(projections, group, points, [ident]).select(ident, "tier"), ident, "left")
    none = reduce(lambda a, b: a & b, (F.col(c).isNull() for c in opinions), F.lit(bool(opinions)))
    x = x.withColumns({"missing": none | F.col(points).isNull(), "auction": F.coalesce(*auction), "teams": F.lit(teams)})
    x = x.join(byes.withColumnRenamed("team", team), team, "left") if byes is not None else x.withColumn("bye", F.lit(None).cast("int"))
    x = x.join(ids, ident, "left") if ids is not None else x
    if handcuffs is None:
        return x
    strength, line, of = handcuffs
    return attach_handcuff(x, strength.withColumnRenamed("team", team), line, team, points, ident, F.col(group) == of)


def cash_value(df: DataFrame, by: str, value: str, ident: str, budget: float, spots: int, least: float = 1.0) -> DataFrame:
    """A group's budget over its best `spots` rows: each gets `least`, the rest goes by positive value."""
    w = Window.partitionBy(by)
    rn = F.row_number().over(w.orderBy(F.col(value).desc_nulls_last(), ident))
    x = df.withColumn("_in", rn <= spots).withColumn("_pos", F.when(F.col("_in"), F.greatest(F.col(value), F.lit(0.0))).otherwise(0.0))
    n, total = F.sum(F.col("_in").cast("int")).over(w), F.sum("_pos").over(w)
    cash = F.when(F.col("_in"), least + F.when(total > 0, F.col("_pos") / total).otherwise(0.0) * (budget - least * n))
    return x.withColumn("cash", cash).drop("_in", "_pos")


def agreement(df: DataFrame, delta: str, by: str, least: int = 8, spread: float = 0.5) -> DataFrame:
    """z-score of a disagreement within its group; null in groups too small or too even."""
    w = Window.partitionBy(by)
    n, sd = F.count(delta).over(w), F.stddev_samp(delta).over(w)
    return df.withColumn("z", F.when((n >= least) & (sd >= spread), (F.col(delta) - F.avg(delta).over(w)) / sd))


def market_comparison(df: DataFrame, value: str, price: str, place: str, group: str, pos_rank: str, ident: str, priced, streamed, price_rank: bool = False) -> DataFrame:
    """df with vor_rank, value (rank by price less rank by value, over priced rows that are not streamed), rank_delta, pos_rank_delta and, where asked for, price_rank.

    Positive says that the board rates a row higher than the market, or another's ranking (place), does.
    """
    ok = F.coalesce(priced & ~streamed, F.lit(False))
    more = {"price_rank": (F.when(F.coalesce(priced, F.lit(False)), F.col(price)), False)} if price_rank else {}
    x = global_ranks(df, ident, more | {"vor_rank": (F.col(value), True), "_adp": (F.when(ok, F.col(price)), False), "_vor": (F.when(ok, F.col(value)), True)})
    own = F.rank().over(Window.partitionBy(group).orderBy(F.col(place).asc_nulls_last()))
    x = x.withColumns({"value": F.col("_adp") - F.col("_vor"), "rank_delta": F.col(place) - F.col("vor_rank"), "pos_rank_delta": F.when(F.col(place).isNotNull(), own) - F.col(pos_rank)})
    return x.drop("_adp", "_vor")


def filtered(df: DataFrame, keep: dict[str, list] | None = None, without: list[str] | None = None, only: list[str] | None = None, most: dict[str, float] | None = None, search: tuple[str, str] | None = None) -> DataFrame:
    """The rows of a board that pass every filter that is set; columns that the board lacks, and empty selections, filter nothing.

    keep: column to the values that stay (unknown ones go); without: flags whose rows go (unknown ones stay); only: flags whose rows stay (unknown ones too); most: column
    to its greatest value (unknown ones stay); search: column and a text it contains, literally, in either case.  All are plain predicates, which reach the scan.
    """
    has = set(df.columns)
    tests = [F.col(c).isin(list(v)) for c, v in (keep or {}).items() if v and c in has]
    tests += [~F.coalesce(F.col(c), F.lit(False)) for c in without or [] if c in has]
    tests += [F.coalesce(F.col(c), F.lit(True)) for c in only or [] if c in has]
    tests += [F.col(c).isNull() | (F.col(c) <= v) for c, v in (most or {}).items() if v is not None and c in has]
    if search and search[1].strip() and search[0] in has:
        tests.append(F.contains(F.lower(search[0]), F.lit(search[1].strip().lower())))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df
