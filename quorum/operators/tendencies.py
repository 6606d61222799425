"""Behaviour of actors against leave-one-out baselines of their peers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .shape import densify
from .windows import leave_one_out


def timing(df: DataFrame, actor: str, kind: str, season: str, at: str, last: int) -> DataFrame:
    """First time an actor takes each kind per season, `last` + 1 where never, against the mean of the season's others; then the mean deviation and the share of seasons on its side."""
    first = df.groupBy(season, actor, kind).agg(F.min(at).cast("double").alias("first"))
    grid = densify(first, df.select(season, actor).distinct(), df.select(kind).distinct(), [season, actor, kind], {"first": float(last + 1)})
    dev = grid.withColumn("dev", F.col("first") - leave_one_out("first", [season, kind])).where("dev IS NOT NULL")
    w = Window.partitionBy(actor, kind)
    mean = F.avg("dev").over(w)
    x = dev.withColumn("_mean", mean).withColumn("_same", (F.signum("dev") == F.signum("_mean")).cast("double"))
    return x.groupBy(actor, kind).agg(F.avg("dev").alias("mean_dev"), F.avg("_same").alias("consistency"), F.count("*").alias("seasons"))


def share_against_room(df: DataFrame, actor: str, kind: str, season: str, weight: str | None = None) -> DataFrame:
    """An actor's share of each kind per season (of rows, or of a weight) less the mean share of the season's others, averaged."""
    n = df.groupBy(season, actor, kind).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    grid = densify(n, df.select(season, actor).distinct(), df.select(kind).distinct(), [season, actor, kind], {"n": 0})
    x = grid.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(season, actor)))
    x = x.withColumn("delta", F.col("share") - leave_one_out("share", [season, kind]))
    return x.groupBy(actor, kind).agg(F.avg("share").alias("share"), F.avg("delta").alias("delta"))


def lean(df: DataFrame, actor: str, value: str, season: str) -> DataFrame:
    """Observed against expected counts of a value, with the binomial variance of every season: lift and z."""
    n = df.groupBy(season, actor).agg(F.count("*").alias("_n"))
    p = df.groupBy(season, value).agg(F.count("*").alias("_k")).withColumn("_p", F.col("_k") / F.sum("_k").over(Window.partitionBy(season)))
    got = df.groupBy(season, actor, value).agg(F.count("*").alias("_got"))
    x = n.join(p, season).join(got, [season, actor, value], "left")
    g = x.groupBy(actor, value).agg(F.sum(F.coalesce("_got", F.lit(0))).alias("observed"), F.sum(F.col("_n") * F.col("_p")).alias("expected"), F.sum(F.col("_n") * F.col("_p") * (1 - F.col("_p"))).alias("_var"))
    return g.where("observed > 0").select(actor, value, "observed", "expected", F.try_divide("observed", "expected").alias("lift"), F.when(F.col("_var") > 0, (F.col("observed") - F.col("expected")) / F.sqrt("_var")).alias("z"))


def loyalty(df: DataFrame, actor: str, item: str, season: str, least: int = 2) -> DataFrame:
    """Times an actor took an item over the seasons in which both were there."""
    a = df.groupBy(actor).agg(F.collect_set(season).alias("_a"))  # seasons: a short list
    i = df.groupBy(item).agg(F.collect_set(season).alias("_i"))
    t = df.groupBy(actor, item).agg(F.count_distinct(season).alias("times")).where(F.col("times") >= least)
    return t.join(a, actor).join(i, item).select(actor, item, "times", F.size(F.array_intersect("_a", "_i")).alias("chances")).withColumn("loyalty", F.col("times") / F.col("chances"))


def top_share(df: DataFrame, actor: str, season: str, value: str, k: int) -> DataFrame:
    """Share of an actor's spending on the k dearest items, averaged over seasons."""
    w = Window.partitionBy(season, actor).orderBy(F.col(value).desc())
    x = df.withColumn("_rn", F.row_number().over(w)).groupBy(season, actor).agg(F.sum(F.when(F.col("_rn") <= k, F.col(value))).alias("_top"), F.sum(value).alias("_all"))
    return x.groupBy(actor).agg(F.avg(F.try_divide("_top", "_all")).alias("concentration"))


def habits(df: DataFrame, actor: str, flag: str, season: str) -> DataFrame:
    """Rate of a flag (unknown rows do not count) against the mean rate of the season's others."""
    r = df.groupBy(season, actor).agg(F.avg(F.col(flag).cast("double")).alias("rate"))
    x = r.withColumn("room", leave_one_out("rate", [season]))
    return x.groupBy(actor).agg(F.avg("rate").alias("rate"), F.avg("room").alias("room"))


def traits(df: DataFrame, actor: str, kind: str, score: str, text, k: int = 3) -> DataFrame:
    """Up to k sentences per actor, at most one of a kind, strongest first."""
    one = Window.partitionBy(actor, kind).orderBy(F.abs(score).desc(), "_text")
    best = Window.partitionBy(actor).orderBy(F.abs(score).desc(), "_text")
    x = df.withColumn("_text", text).withColumn("_k", F.row_number().over(one)).where("_k = 1").withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= k)
    return x.groupBy(actor).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_text"))), lambda s: s["_text"]), "; ").alias("traits"))


def early_build(df: DataFrame, actor: str, kind: str, season: str, at: str, rounds: int) -> DataFrame:
    """share_against_room() of the first rounds' picks."""
    return share_against_room(df.where(F.col(at) <= rounds), actor, kind, season)


def auction_spend(df: DataFrame, actor: str, kind: str, season: str, price: str, k: int = 3) -> DataFrame:
    """Budget shares by kind against the room, with the share of the k dearest and the room's."""
    w = Window.partitionBy(season, actor).orderBy(F.col(price).desc())
    s = df.withColumn("_rn", F.row_number().over(w)).groupBy(season, actor).agg(F.sum(price).alias("_all"), F.sum(F.when(F.col("_rn") <= k, F.col(price))).alias("_top")).where("_all > 0")
    s = s.withColumn("top_share", F.col("_top") / F.col("_all")).withColumn("room_top_share", leave_one_out("top_share", [season]))
    top = s.groupBy(actor).agg(F.avg("top_share").alias("top_share"), F.avg("room_top_share").alias("room_top_share"))
    return share_against_room(df, actor, kind, season, weight=price).join(top, actor, "left")


def all_habits(df: DataFrame, actor: str, season: str, against: str, plain: list[str]) -> DataFrame:
    """Rate of one flag against the room (seasons without a room left out), and rates and counts of others; actors of either side."""
    r = df.where(F.col(against).isNotNull()).groupBy(season, actor).agg(F.avg(F.col(against).cast("double")).alias("rate"))
    x = r.withColumn("room", leave_one_out("rate", [season])).where("room IS NOT NULL")
    own = x.groupBy(actor).agg(F.avg("rate").alias(f"{against}_rate"), F.avg("room").alias(f"room_{against}_rate"))
    other = df.groupBy(actor).agg(*(F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in plain), *(F.count_if(F.col(c)).alias(f"{c}_n") for c in plain))
    return own.join(other, actor, "full").withColumn(f"{against}_delta", F.col(f"{against}_rate") - F.col(f"room_{against}_rate"))


# How far from the room a tendency has to be, what it rests on, and how much is said.
TIMING_DELTA, TIMING_CONSISTENCY, TIMING_SEASONS = 1.0, 0.6, 2
BUILD_DELTA, TEAM_Z = 0.08, 2.0
MOST_TRAITS, MOST_OF_KIND = 3, {"timing": 2}


def timing_traits(df: DataFrame, actor: str, kind: str, least: float = TIMING_DELTA) -> DataFrame:
    """Candidates (actor, kind, score, text) from timing(): kinds taken steadily earlier or later than the room does."""
    x = df.where((F.abs("mean_dev") >= least) & (F.col("seasons") >= TIMING_SEASONS) & (F.col("consistency") >= TIMING_CONSISTENCY))
    return x.select(actor, F.lit("timing").alias("kind"), (F.abs("mean_dev") / least).alias("score"), F.when(F.col("mean_dev") < 0, F.concat(F.lit("takes "), F.col(kind), F.lit(" early"))).otherwise(F.concat(F.lit("waits on "), F.col(kind))).alias("text"))


def build_traits(df: DataFrame, actor: str, kind: str, least: float = BUILD_DELTA) -> DataFrame:
    """Candidates from share_against_room() of the first rounds."""
    x = df.where(F.abs("delta") >= least)
    return x.select(actor, F.lit("build").alias("kind"), (F.abs("delta") / least).alias("score"), F.concat(F.when(F.col("delta") > 0, "leans on ").otherwise("skips "), F.col(kind), F.lit(" early")).alias("text"))


def team_traits(df: DataFrame, actor: str, kind: str, least: float = TEAM_Z) -> DataFrame:
    """Candidates from lean(): teams picked more often than chance."""
    return df.where(F.col("z") >= least).select(actor, F.lit("team").alias("kind"), (F.col("z") / least).alias("score"), F.concat_ws(" ", F.lit("has"), "observed", kind, F.lit("picks")).alias("text"))


def compose(candidates: DataFrame, seasons: DataFrame, actor: str, least: int = 2) -> DataFrame:
    """actor, seasons, traits, headline: per actor of `seasons` (actor, seasons) up to MOST_TRAITS sentences, strongest first, one of a kind but MOST_OF_KIND of some, or that there is
    nothing to say.  Scores are compared to 6 places, ties by kind and text."""
    s = F.round("score", 6).desc()
    of_kind = F.row_number().over(Window.partitionBy(actor, "kind").orderBy(s, "text"))
    caps = F.create_map(*(F.lit(v) for kv in MOST_OF_KIND.items() for v in kv))
    x = candidates.withColumn("_k", of_kind).where(F.col("_k") <= F.coalesce(F.try_element_at(caps, F.col("kind")), F.lit(1)))
    x = x.withColumn("_rn", F.row_number().over(Window.partitionBy(actor).orderBy(s, "kind", "text"))).where(F.col("_rn") <= MOST_TRAITS)
    text = F.concat(F.upper(F.substring("text", 1, 1)), F.col("text").substr(F.lit(2), F.length("text")), F.lit("."))
    said = x.groupBy(actor).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", text.alias("t")))), lambda r: r["t"]), " ").alias("_said"), F.min_by("kind", "_rn").alias("headline"))
    out = seasons.join(said, actor, "left")
    thin = F.col("seasons") < least
    traits = F.when(thin, "One draft on record: nothing here is a tendency yet.").when(F.col("_said").isNull(), F.concat(F.lit("Drafts near consensus over "), "seasons", F.lit(" drafts."))).otherwise(F.concat("_said", F.lit(" ("), "seasons", F.lit(" drafts)")))
    return out.select(actor, "seasons", traits.alias("traits"), F.when(~thin, F.col("headline")).alias("headline"))
