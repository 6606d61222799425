"""The usage model: season features from several pulls, priors, fits per group, predictions by arm, and what they leave open."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.distributions import games_interval
from ..functions.expr import clip, nan_to_null, safe_ratio, shrunk
from . import model
from .windows import beside, latest_per, with_group


def outer_totals(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Season totals of several pulls side by side; a key that one lacks has nulls there, and NaN is null."""
    out = reduce(lambda a, b: a.join(b, keys, "full"), frames)
    return out.withColumns({f.name: nan_to_null(F.col(f.name)) for f in out.schema if f.dataType.simpleString() in ("double", "float")})


def share_or_zero(part: str, whole: str) -> Column:
    """part / whole where whole is positive, 0 where it is not, null where it is unknown."""
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).when(F.col(whole).isNotNull(), 0.0)


def mean_production(df: DataFrame, by: list[str], pairs: dict[str, str]) -> DataFrame:
    """Games, and means of every actual column and its expected one."""
    return df.groupBy(*by).agg(F.count("*").alias("games"), *(F.avg(c).alias(f"{c}_pg") for kv in pairs.items() for c in kv))


def filtered_mean(df: DataFrame, by: list[str], value: str, played: str) -> DataFrame:
    """Mean of a share over the games with any play, and their number."""
    return df.where(F.col(played) > 0).groupBy(*by).agg(F.avg(value).alias(f"mean_{value}"), F.count("*").alias("games"))


def weighted_line(df: DataFrame, by: list[str], x: str, y: str, w: str, least: int) -> DataFrame:
    """by, intercept, slope, n: least squares weighted by w; none below `least` rows or where x does not vary."""
    ok = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (x, y, w)))
    p = Window.partitionBy(*by)
    a, b, k = F.col(x).cast("double"), F.col(y).cast("double"), F.col(w).cast("double")
    ok = ok.withColumns({"_mx": F.sum(k * a).over(p) / F.sum(k).over(p), "_my": F.sum(k * b).over(p) / F.sum(k).over(p)})  # centred, so that sums do not cancel
    g = ok.groupBy(*by).agg(F.count("*").alias("n"), F.max("_mx").alias("_mx"), F.max("_my").alias("_my"), F.sum(k * (a - F.col("_mx")) * (b - F.col("_my"))).alias("_xy"), F.sum(k * (a - F.col("_mx")) ** 2).alias("_xx"))
    g = g.where((F.col("n") >= least) & (F.col("_xx") > 0)).withColumn("slope", F.col("_xy") / F.col("_xx"))
    return g.select(*by, (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"), "slope", "n")


def fitted_prior(df: DataFrame, base: DataFrame, line: DataFrame, by: list[str], x: str, own: str, n: str, k: float) -> DataFrame:
    """Own rate drawn to a prior by k units: the group's line at x, within 0 and three times the group's rate, or that rate where there is no line."""
    d = df.join(base, by, "left").join(line.select(*by, "intercept", "slope"), by, "left")
    guess = F.col("intercept") + F.col("slope") * F.col(x)
    prior = F.coalesce(F.greatest(F.lit(0.0), F.least(guess, 3 * F.col("base_rate"))), F.col("base_rate"))
    prior = F.when(guess.isNotNull(), prior).otherwise(F.col("base_rate"))
    return d.withColumn("prior", prior).withColumn("rate", shrunk(own, n, "prior", k)).drop("intercept", "slope")


def shrunk_means(history: DataFrame, key: str, metrics: list[str], prefix: str, k: float) -> DataFrame:
    """key, seasons and each metric's mean over the key's rows, drawn to the mean of all rows by k seasons."""
    means = history.agg(*(F.avg(m).alias(f"_all_{m}") for m in metrics))
    g = history.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").cast("int").alias(f"{prefix}seasons"), *(F.avg(m).alias(m) for m in metrics)).crossJoin(means)
    n = F.col(f"{prefix}seasons").cast("double")
    return g.select(key, f"{prefix}seasons", *(((n * F.coalesce(m, f"_all_{m}") + k * F.col(f"_all_{m}")) / (n + k)).alias(f"{prefix}{m}") for m in metrics))


def recent_means(profile: DataFrame, team: str, season: str, target: int, window: int, metrics: list[str], prefix: str) -> DataFrame:
    """Means over a team's last `window` seasons before the target."""
    x = profile.where((F.col(season) < target) & (F.col(season) >= target - window))
    return x.groupBy(team).agg(F.count("*").cast("int").alias(f"{prefix}seasons"), *(F.avg(m).alias(f"{prefix}{m}") for m in metrics))


def attach_priors(df: DataFrame, priors: list[tuple[DataFrame, str]], metrics: list[str], prefixes: list[str], means: DataFrame) -> DataFrame:
    """df with each prior's metrics by its key; where a key is unknown the league's mean stands (means: one row)."""
    for prior, key in priors:
        df = df.join(prior, key, "left")
    df = df.crossJoin(means.select(*(F.col(m).alias(f"_all_{m}") for m in metrics)))
    return df.withColumns({f"{p}{m}": F.coalesce(f"{p}{m}", f"_all_{m}") for p in prefixes for m in metrics}).drop(*(f"_all_{m}" for m in metrics))


def lead(df: DataFrame, first: str, second: str, out: str) -> DataFrame:
    return df.withColumn(out, F.coalesce(first, second))


def roster_context(rosters: DataFrame, prior: DataFrame, ident: str, season: str, week: str, team: str, entry: str, born: str, opener: str = "09-01") -> DataFrame:
    """Each season's first roster with the team of the season before, whether it changed (unknown where there was none), rookies and ages."""
    first = with_group(rosters, season, _w=F.min(week)).where(F.col(week) == F.col("_w")).drop("_w")
    last = prior.select(ident, (F.col(season) + 1).alias(season), F.col(team).alias("prior_team"))
    x = first.join(last, [ident, season], "left")
    day = F.concat(F.col(season).cast("string"), F.lit(f"-{opener}")).cast("date")
    return x.withColumns({"team_changed": F.when(F.col("prior_team").isNotNull(), F.col(team) != F.col("prior_team")), "is_rookie": F.col(entry) >= F.col(season), "age": F.datediff(day, F.col(born)) / 365.25})


def depth_charts(coarse: DataFrame, fine: DataFrame, ident: str, starters: dict[str, int], most: int = 3) -> DataFrame:
    """season, team, ident, position, depth_rank, as_of: charts of two schemas on the coarser one's scale.

    coarse: season, club, ident, position, depth (text, 1 for every starter) and week; fine: season, team, ident, position, place (a strict order) and at.  A strict
    order is shifted so that all of a position's starters (else one) are first; ranks end at `most`.  as_of is text: a week of two digits, which sorts before all
    times, or the time.  Rows without an entity or a rank go.
    """
    week = F.col("week").cast("string")
    a = coarse.select("season", F.col("club").alias("team"), ident, "position", F.trim("depth").try_cast("int").alias("_rank"), F.when(F.length(week) < 2, F.lpad(week, 2, "0")).otherwise(week).alias("as_of"))
    first = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in starters.items() for v in kv)), F.col("position")), F.lit(1))
    b = fine.select("season", "team", ident, "position", F.when(F.col("place").isNotNull(), F.greatest(F.col("place").cast("int") - first + 1, F.lit(1))).alias("_rank"), F.col("at").cast("string").alias("as_of"))
    x = a.unionByName(b).where(F.col(ident).isNotNull() & F.col("_rank").isNotNull())
    return x.select("season", "team", ident, "position", F.least("_rank", F.lit(most)).alias("depth_rank"), "as_of")


def before_opening(as_of: str, season: str, opener: str = "09-01") -> Column:
    """Whether a chart is from before a season's opening day; charts of weeks are."""
    return (F.col(as_of) < F.concat(F.col(season).cast("string"), F.lit(f"-{opener}"))) | (F.col(as_of) < "1000")


def season_staff(games: DataFrame, season: str, team: str, coach: str, source: str) -> DataFrame:
    """A row per season and team: the coach of most games (the first by name of equals), of how many, and whether there was more than one."""
    n = games.groupBy(season, team, coach).agg(F.count("*").alias("_n"))
    key = F.struct((-F.col("_n")).alias("less"), F.col(coach))
    g = n.groupBy(season, team).agg(F.min(key).alias("_m"), F.sum("_n").alias("team_games"), F.count(coach).alias("_k"))
    return g.select(season, team, F.col(f"_m.{coach}").alias("head_coach"), (-F.col("_m.less")).alias("games_coached"), "team_games", (F.col("_k") > 1).alias("changed_midseason"), F.lit(source).alias("source"))


def merge_staff(played: DataFrame, live: DataFrame, crawled: DataFrame, season: str, team: str, roles: list[str]) -> DataFrame:
    """played with the rows that live has for the same season and team in their place, and roles (null so far) from crawled.

    A team that live could not resolve keeps its played row, and `source` says so; crawled has one row per season and team.
    """
    keys = [season, team]
    x = played.join(live.select(*keys), keys, "left_anti").unionByName(live, allowMissingColumns=True)
    c = crawled.select(*keys, *(F.col(r).alias(f"_{r}") for r in roles))
    return x.join(c, keys, "left").withColumns({r: F.coalesce(F.col(r), F.col(f"_{r}")) for r in roles}).drop(*(f"_{r}" for r in roles))


def preseason_depth(charts: DataFrame, ident: str, season: str, at: str, team: str, position: str, place: str, cutoff: Column, positions: tuple[str, ...] = ()) -> DataFrame:
    """Each season's last chart before the cutoff (its last of all where there is none): best place per entity, and how many share its team and position.

    Only then do `positions`, where given, choose its rows, so that someone listed elsewhere too keeps the place that matters.
    """
    early = F.coalesce(cutoff & F.col(at).isNotNull(), F.lit(False)).alias("_early")
    dates = charts.select(season, at, early).distinct()  # hashed, where the greatest text of all rows would be found by sorting them
    last = latest_per(dates, season, F.col("_early").desc(), F.col(at).desc_nulls_last()).select(season, F.col(at).alias("_last"))
    x = beside(charts, last, season).where(F.col(at) == F.col("_last"))
    x = x.where(F.col(position).isin(*positions)) if positions else x
    best = Window.partitionBy(season, ident).orderBy(place, team, position)
    x = x.withColumn("_rn", F.row_number().over(best)).where("_rn = 1")
    x = with_group(x, [season, team, position], _n=F.count("*").cast("int"))
    return x.select(season, ident, F.col(place).alias("depth_rank"), (F.col(place) == 1).alias("is_first"), F.col("_n").alias("depth_group"), F.col(team).alias("depth_team"))


def severity(column: str, order: dict[str, int]) -> Column:
    """Number of a status, 0 for others."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in order.items() for v in kv)), F.col(column)), F.lit(0))


def hop(df: DataFrame, pairs: DataFrame, source: str, target: str, keys: list[str], order: str) -> DataFrame:
    """df under another id; ids that stand for several are left out, and of rows that meet in one key the first by order stays."""
    p = pairs.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(source, target).distinct()
    one = p.withColumn("_n", F.count("*").over(Window.partitionBy(source))).where("_n = 1").drop("_n")
    w = Window.partitionBy(*keys, target).orderBy(order)
    return df.join(one, source).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def pick_bin(pick: Column, bounds: list[tuple[int, int]], without: str = "none") -> Column:
    """Label of the closed range that a draft pick lies in."""
    out = F.when(pick.isNull(), without)
    for low, high in bounds:
        out = out.when((pick >= low) & (pick <= high), f"{low}-{high}")
    return out.otherwise(without)


def bin_rates(df: DataFrame, by: list[str], part: str, whole: str, least: int = 5) -> DataFrame:
    """Mean of part / whole per bin, where at least `least` rows have a whole."""
    x = df.where(F.col(whole) > 0)
    return x.groupBy(*by).agg(F.avg(F.coalesce(F.col(part).cast("double"), F.lit(0.0)) / F.col(whole)).alias("rate"), F.count("*").alias("n")).where(F.col("n") >= least)


def pooled_rates(df: DataFrame, by: list[str], rates: dict[str, tuple[str, str]], least: float) -> DataFrame:
    """Ratios of sums per group; null where a denominator is below `least`."""
    sums = sorted({c for pair in rates.values() for c in pair})
    g = df.groupBy(*by).agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    return g.select(*by, *(F.when(F.col(f"_{d}") >= least, F.col(f"_{n}") / F.col(f"_{d}")).alias(k) for k, (n, d) in rates.items()))


def arm(prior: str, rookie: str, out: str) -> Column:
    """Which arm speaks: none for those who are out, the rookies' for those without a past, else the veterans'."""
    return F.when(F.coalesce(F.col(out), F.lit(False)), "abstain").when(F.coalesce(F.col(rookie), F.lit(False)), "rookie").when(F.col(prior).isNull(), "abstain").otherwise("veteran")


def predicted(df: DataFrame, by: str, volume: DataFrame, terms: list[str], games: DataFrame, game_terms: list[str], rookies: DataFrame, rookie_bin: str, rate: str, slate: float) -> DataFrame:
    """df (with usg_arm) with expected_games, volume and usg = games x volume x rate, at least 0; abstaining rows have none.

    Veterans' games and volume come from their lines; rookies take the bin's share of the slate and its volume (bin, rate, volume).
    """
    v = model.predict(df, volume, by, terms).withColumnRenamed("prediction", "_v")
    g = model.predict(v, games, by, game_terms).withColumnRenamed("prediction", "_g")
    x = g.join(rookies.select(rookie_bin, F.col("rate").alias("_rg"), F.col("volume").alias("_rv")), rookie_bin, "left")
    a = F.col("usg_arm")
    x = x.withColumns({"expected_games": F.when(a == "veteran", slate * clip(F.col("_g"), 0.0, 1.0)).when(a == "rookie", slate * F.col("_rg")), "volume": F.when(a == "veteran", F.col("_v")).when(a == "rookie", F.col("_rv"))})
    return x.withColumn("usg", F.col("expected_games") * F.col("volume") * F.col(rate)).drop("_v", "_g", "_rg", "_rv")


def to_slate(columns: list[str], games: str, slate: float) -> dict[str, Column]:
    """Values on a full slate; unknown where no games are expected."""
    factor = F.when(F.col(games) > 0, slate / F.col(games))
    return {c: F.col(c) * factor for c in columns}


def evidence(df: DataFrame, by: str, arm: str, volume: str, games: str, changed: str, thin: int, share: float = 0.25) -> DataFrame:
    """Reasons to doubt a veteran's line, joined by semicolons: few prior games, another team, volume below the group's quartile (nearest rank)."""
    vet = F.col(arm) == "veteran"
    w = Window.partitionBy(by, vet).orderBy(volume)
    n = F.count(volume).over(Window.partitionBy(by, vet))
    place = F.row_number().over(w)
    at = F.bround((n - 1) * share, 0).cast("int") + 1
    x = df.withColumn("_at", F.when(vet & (place == at), F.col(volume))).withColumn("_cut", F.max("_at").over(Window.partitionBy(by)))
    reasons = [("thin prior season", F.coalesce(F.col(games), F.lit(99)) < thin), ("changed teams", F.coalesce(F.col(changed), F.lit(False))), ("low prior volume", F.col(volume) < F.col("_cut"))]
    text = F.concat_ws("; ", *(F.when(vet & ok, label) for label, ok in reasons))
    return x.withColumn("usg_evidence", text).withColumn("usg_thin", F.col("usg_evidence") != "").drop("_at", "_cut")


def dispersion(df: DataFrame, by: str, expected: str, actual: str, slate: float) -> DataFrame:
    """by, rho: the intra-class correlation that a Beta-Binomial needs for the residuals' spread, by moments, within [0, 0.95]."""
    p = F.col(expected) / slate
    v = slate * p * (1 - p)
    g = df.where(F.col(expected).isNotNull() & F.col(actual).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.sum((F.col(actual) - F.col(expected)) ** 2).alias("_ss"), F.sum(v).alias("_v"))
    return g.select(by, "n", clip((safe_ratio("_ss", "_v") - 1) / (slate - 1), 0.0, 0.95).alias("rho"))


def calibration(df: DataFrame, by: list[str], expected: str, actual: str, slate: int, rho: float, lower: float = 0.1, upper: float = 0.9) -> DataFrame:
    """by, n, covered, below, above, coverage, nominal: how often the games played lie inside the Beta-Binomial interval of the games expected, against the share it was built for."""
    x = df.where(F.col(expected).isNotNull() & F.col(actual).isNotNull())
    x = x.withColumns({"_low": games_interval(expected, slate, rho, lower), "_high": games_interval(expected, slate, rho, upper)})
    y = F.col(actual)
    g = x.groupBy(*by).agg(F.count("*").alias("n"), F.count_if((y >= F.col("_low")) & (y <= F.col("_high"))).alias("covered"), F.count_if(y < F.col("_low")).alias("below"), F.count_if(y > F.col("_high")).alias("above"))
    return g.withColumns({"coverage": F.try_divide("covered", "n"), "nominal": F.lit(upper - lower)})


def holdout(df: DataFrame, season: str, by: str, xs: list[str], y: str, last: int) -> DataFrame:
    """The last seasons' rows with predictions of a fit that is blind to them."""
    top = df.agg(F.max(season).alias("_top"))
    x = df.crossJoin(top).withColumn("_held", F.col(season) > F.col("_top") - last).drop("_top")
    return model.predict(x.where("_held").drop("_held"), model.fit(x.where("NOT _held"), by, xs, y), by, xs)


def training_frame(features: DataFrame, outcomes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Features with the season's outcomes as y_ columns; rows without an outcome stay, with nulls."""
    return features.join(outcomes.select(*keys, *(F.col(v).alias(f"y_{v}") for v in values)), keys, "left")
