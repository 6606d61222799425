"""Board presentation: budgets, keepers, needs, outliers, targets, acquisitions, notes and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import written

MIN_BID = 1.0


def at_budget(df: DataFrame, price: str, budget: float, base: float = 200.0) -> DataFrame:
    """A market price as a share of its base budget, and in a budget of one's own."""
    share = F.col(price) / base
    return df.withColumns({"share": share, "dollars": share * budget})


def keeper_price(df: DataFrame, held: str, cost: str, least: float = MIN_BID) -> DataFrame:
    """What keeping costs the holder: the price paid, at least a minimum; free ones have none."""
    return df.withColumn("keeper_price", F.when(F.coalesce(F.col(held), F.lit(0)) != 0, F.greatest(F.coalesce(F.col(cost).cast("double"), F.lit(0.0)), F.lit(least))))


def rostered_counts(df: DataFrame, holder: str) -> DataFrame:
    return df.where(F.coalesce(F.col(holder), F.lit(0)) != 0).groupBy(holder).agg(F.count("*").alias("held"))


def keepers_pending(df: DataFrame, holder: str, keepers: int) -> DataFrame:
    """One row: whether some team holds more than may be kept, so that rosters are last season's."""
    return rostered_counts(df, holder).agg(F.coalesce(F.bool_or(F.col("held") > keepers) & F.lit(keepers > 0), F.lit(False)).alias("pending"), F.coalesce(F.max("held"), F.lit(0)).alias("most"))


def draftable_spots(slots: DataFrame, teams: int, never: tuple[str, ...] = ("IR", "")) -> DataFrame:
    """One row: the places that all teams together fill by drafting."""
    return slots.where(~F.trim("slot").isin(*never)).agg((F.coalesce(F.sum("count"), F.lit(0)) * teams).cast("long").alias("spots"))


def roster_needs(roster: DataFrame, team: str, position: str, slots: dict[str, int], flex: dict[str, list[str]]) -> DataFrame:
    """team, slot, open: places that a team's players leave open, dedicated ones filled first, then flexible ones in their order.

    Players of one position are alike here, so counts suffice: what a position has beyond its own places goes to its flexible
    slots one after another.
    """
    kinds = sorted({*(s for s in slots if s not in flex), *(p for s in flex for p in flex[s])})
    have = roster.groupBy(team).pivot(position, kinds).agg(F.count(F.lit(1)))
    x = have.select(team, *(F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(f"h_{i}") for i, k in enumerate(kinds)))
    open_places = []
    for i, k in enumerate(kinds):
        x = x.withColumns({f"o_{i}": F.greatest(F.lit(0), slots.get(k, 0) - F.col(f"h_{i}")), f"h_{i}": F.greatest(F.lit(0), F.col(f"h_{i}") - slots.get(k, 0))})
        open_places.append((k, f"o_{i}"))
    for j, slot in enumerate(s for s in flex if slots.get(s)):
        x = x.withColumn(f"f_{j}", F.lit(slots[slot]).cast("long"))
        for i, k in enumerate(kinds):
            if k in flex[slot]:
                taken = F.least(F.col(f"h_{i}"), F.col(f"f_{j}"))
                x = x.withColumns({f"h_{i}": F.col(f"h_{i}") - taken, f"f_{j}": F.col(f"f_{j}") - taken})
        open_places.append((slot, f"f_{j}"))
    rows = F.array(*(F.struct(F.lit(s).alias("slot"), F.col(c).cast("long").alias("open")) for s, c in open_places))
    return x.select(team, F.inline(rows)).where("open > 0")


def positions_needed(needs: DataFrame, team: str, flex: dict[str, list[str]]) -> DataFrame:
    """The positions that would fill an open place, sorted."""
    pairs = [F.lit(x) for s, ps in flex.items() for x in (s, ",".join(ps))]
    which = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("slot")), F.col("slot")) if pairs else F.col("slot")
    return needs.withColumn("p", F.explode(F.split(which, ","))).groupBy(team).agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("positions"))


def global_ranks(df: DataFrame, ident: str, ranks: dict[str, tuple[Column, bool]], ties: bool = True) -> DataFrame:
    """df with ranks over the whole table, out: (value, descending): the smallest of equals, or with ties=False by ident; null values have none.

    With ties a rank is one more than the rows of smaller values, so values are counted, not rows sorted: a value that a third of all rows hold is one count,
    and such values (at most four a shuffle partition) are looked up by a broadcast, the others by a join.  Without ties, rows are ranked inside value ranges.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = written(df.withColumns({f"_k_{o}": v for o, (v, _) in ranks.items()}))  # read for the counts and the ranks
    y, rows = x, x.count() if ties else 0
    for o, (_, desc) in ranks.items():
        y = _tied(x, y, rows, f"_k_{o}", o, desc, n, ident) if ties else _ordinal(y, f"_k_{o}", o, desc, n, ident)
    return y.drop(*(f"_k_{o}" for o in ranks))


def _cut(x: DataFrame, key: str, desc: bool, n: int) -> Column:
    """The number of a row's value range, in order.  Cuts are fixed on the driver, since a sketch may come out otherwise when it is made again; as doubles they
    only part the values, equal ones stay together."""
    at = x.agg(F.percentile_approx(F.col(key).cast("double"), [i / n for i in range(1, n)], 10000).alias("at")).first()["at"]
    cuts = sorted(set(at or []))
    above = sum(((F.col(key).cast("double") > c).cast("int") for c in cuts), F.lit(0))
    return F.lit(len(cuts)) - above if desc else above


def _tied(x: DataFrame, to: DataFrame, rows: int, key: str, out: str, desc: bool, n: int, ident: str) -> DataFrame:
    """to (the rows of x, with other ranks) with the rank of key; values are counted in x, so that no rank waits for another's joins."""
    counts = x.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_v")).agg(F.count("*").alias("_n"))
    counts = written(counts)
    counts = counts.withColumn("_part", _cut(counts, "_v", desc, n))
    sizes = counts.groupBy("_part").agg(F.sum("_n").alias("_rows"))
    before = sizes.select("_part", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range
    inside = Window.partitionBy("_part").orderBy(F.desc("_v") if desc else F.asc("_v")).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) + 1
    table = written(counts.join(F.broadcast(before), "_part").select("_v", "_n", rank.alias(out)))  # `before` has at most a row a partition
    most = rows // (4 * n) + 1
    hot = F.broadcast(table.where(F.col("_n") > most).select(F.col("_v").alias("_h"), F.col(out).alias("_hot")))  # fewer than 4 n values can hold so many rows
    cold = table.where(F.col("_n") <= most).select(F.col("_v").alias("_c"), F.lit(0).alias("_zero"), F.col(out).alias("_cold"))
    y = to.join(hot, F.col(key) == F.col("_h"), "left")
    done = F.col("_hot").isNotNull() | F.col(key).isNull()  # such rows find nothing, wherever they go, so they are spread
    y = y.withColumn("_salt", F.when(done, 1 + F.pmod(F.xxhash64(ident), F.lit(1 << 20)).cast("int")).otherwise(0))
    y = y.join(cold, (F.col(key) == F.col("_c")) & (F.col("_salt") == F.col("_zero")), "left")
    return y.withColumn(out, F.coalesce("_hot", "_cold")).drop("_h", "_hot", "_c", "_cold", "_zero", "_salt")


def _ordinal(x: DataFrame, key: str, out: str, desc: bool, n: int, ident: str) -> DataFrame:
    x = x.withColumn("_part", F.when(F.col(key).isNotNull(), _cut(x, key, desc, n)))
    sizes = x.where("_part IS NOT NULL").groupBy("_part").agg(F.count("*").alias("_rows"))
    before = sizes.select("_part", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc(key) if desc else F.asc(key), ident))
    return x.withColumn(out, own).join(F.broadcast(before), "_part", "left").withColumn(out, F.when(F.col(key).isNotNull(), F.col(out) + F.col("_before"))).drop("_part", "_before")


def outliers(df: DataFrame, z: str, ident: str, limit: int, by: str | None = None) -> DataFrame:
    """flag and place of the `limit` rows with the largest |z|, of the table or of each group."""
    if by is None:
        best = df.where(F.col(z).isNotNull()).select(ident, F.abs(z).alias("_a")).orderBy(F.col("_a").desc(), ident).limit(limit)
        best = best.withColumn("outlier_rank", F.row_number().over(Window.orderBy(F.col("_a").desc(), ident))).drop("_a")  # `limit` rows
        return df.join(best, ident, "left").withColumn("outlier", F.col("outlier_rank").isNotNull())
    rn = F.row_number().over(Window.partitionBy(by).orderBy(F.abs(z).desc_nulls_last(), ident))
    return df.withColumn("outlier_rank", F.when(F.col(z).isNotNull() & (rn <= limit), rn)).withColumn("outlier", F.col("outlier_rank").isNotNull())


def label_slots(df: DataFrame, by: str, y: str, ident: str) -> DataFrame:
    """Place of each flagged row among the flagged of its group by y, where labels are stacked."""
    rn = F.row_number().over(Window.partitionBy(by, "outlier").orderBy(F.col(y).asc_nulls_last(), ident))
    return df.withColumn("label_slot", F.when(F.col("outlier"), rn))


def agreement_summary(df: DataFrame, by: str, delta: str, z: str) -> DataFrame:
    d = F.col(delta)
    return df.groupBy(by).agg(F.count("*").alias("rows"), F.avg(d).alias("mean_delta"), F.stddev_samp(d).alias("sd_delta"), (F.avg((d > 0).cast("double")) * 100).alias("share_above"), F.bool_or(F.col(z).isNotNull()).alias("scored"))


def value_targets(df: DataFrame, lens: str, keep: Column, ident: str, limit: int) -> DataFrame:
    """The `limit` best rows by a lens, of those that may be taken."""
    return df.where(F.coalesce(keep, F.lit(False)) & F.col(lens).isNotNull()).orderBy(F.col(lens).desc(), ident).limit(limit)


def acquisitions(lineups: DataFrame, picks: DataFrame, by: list[str], item: str, points: str, starts: Column, owner: str) -> DataFrame:
    """Per team: points of what it drafted and of what it added, the drafted share, moves (added items, started or not), points a move.

    A team without picks has no drafted or added points.  The owner is the most frequent name, the smallest of equals.
    """
    drafted = picks.select(*by, item).distinct().withColumn("_drafted", F.lit(True))
    known = picks.select(*by).distinct().withColumn("_known", F.lit(True))
    x = lineups.join(drafted, [*by, item], "left").join(known, by, "left").withColumns({"_drafted": F.coalesce("_drafted", F.lit(False)), "_known": F.coalesce("_known", F.lit(False)), "_starts": F.coalesce(starts, F.lit(False))})
    moves = x.where("NOT _drafted").groupBy(*by).agg(F.count_distinct(item).alias("moves"))
    p = F.col(points)
    g = x.where("_starts").groupBy(*by).agg(F.mode(owner, deterministic=True).alias("owner"), F.bool_or("_known").alias("_known"), F.coalesce(F.sum(F.when(F.col("_drafted"), p)), F.lit(0.0)).alias("_d"), F.coalesce(F.sum(F.when(~F.col("_drafted"), p)), F.lit(0.0)).alias("_a"), F.sum(p).alias("total"))
    g = g.join(moves, by, "left").withColumns({"moves": F.coalesce("moves", F.lit(0)), "drafted": F.when(F.col("_known"), F.col("_d")), "added": F.when(F.col("_known"), F.col("_a"))})
    return g.withColumns({"share_drafted": F.when(F.col("total") > 0, 100 * F.col("drafted") / F.col("total")), "points_per_move": F.when(F.col("moves") > 0, F.col("added") / F.col("moves"))}).drop("_known", "_d", "_a")


def acquisition_averages(history: DataFrame, by: str, season: str, values: list[str]) -> DataFrame:
    """Means over a manager's seasons, under the last season's name."""
    return history.groupBy(by).agg(F.count_distinct(season).alias("seasons"), F.max_by("owner", season).alias("owner"), *(F.avg(v).alias(v) for v in values))


def notes(tendencies: DataFrame, board: DataFrame, name: str) -> DataFrame:
    """Traits without those about a favourite who is not on the board; `on_board` says whether he is."""
    there = board.select(F.col(name).alias("favourite")).where("favourite IS NOT NULL").distinct().withColumn("on_board", F.lit(True))
    x = tendencies.join(there, "favourite", "left").withColumn("on_board", F.coalesce("on_board", F.lit(False)))
    kept = F.when(F.col("on_board") | F.col("favourite").isNull(), F.col("traits")).otherwise(F.filter("traits", lambda t: ~F.lower(t).contains(F.lower("favourite"))))
    return x.withColumn("traits", kept).withColumn("description", F.concat(F.when(F.size("traits") > 0, F.concat_ws(" ", F.transform("traits", lambda t: F.concat(F.upper(F.substring(t, 1, 1)), t.substr(F.lit(2), F.length(t)), F.lit("."))))).otherwise(F.lit("No tendency about this board.")), F.lit(" ("), F.col("seasons").cast("string"), F.lit(" drafts)")))


def evidence(arm: str, points: str, thin: str, role: str = "withdrawn: backup") -> Column:
    """Why a model has its opinion, or none: ordered, the first that holds."""
    said = F.coalesce(F.col(thin), F.lit(""))
    return F.when(F.col(arm).isNull(), "not modelled").when(F.col(arm) == "abstain", "withdrawn: availability").when(F.col(points).isNull() & (said == role), role).when(F.col(points).isNull(), "withdrawn: injury").when(said != "", said).otherwise("clear")


def injury_code(status: str, codes: dict[str, str]) -> Column:
    """A short code; statuses without one stay as they are."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in codes.items() for x in kv)), F.col(status)), F.col(status))


def return_label(day: str, ending_after: str) -> Column:
    return F.when(F.col(day).isNull(), None).when(F.col(day) > F.lit(ending_after).cast("date"), "season").otherwise(F.date_format(day, "MMM dd"))
