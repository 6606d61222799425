"""Readers of landed responses: nested JSON and HTML text in a column become rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BOX = "home LONG, away LONG, period LONG, lineups ARRAY<STRUCT<team: LONG, player: LONG, slot: STRING, points: DOUBLE, projected: DOUBLE, eligible: ARRAY<STRING>>>"
INJURIES = "season INT, injuries ARRAY<STRUCT<team: STRING, injuries: ARRAY<STRUCT<athlete: STRUCT<id: LONG, displayName: STRING>, status: STRING, date: STRING, shortComment: STRING, details: STRUCT<returnDate: STRING, type: STRING>>>>>"
DRAFT = "season INT, picks ARRAY<STRUCT<overall: INT, round: INT, team: LONG, owners: STRING, player: LONG, bid: DOUBLE, keeper: BOOLEAN>>"
ODDS = "event LONG, markets ARRAY<STRUCT<name: STRING, outcomes: ARRAY<STRUCT<side: STRING, line: DOUBLE, price: DOUBLE>>>>"


def box_scores(df: DataFrame, column: str) -> DataFrame:
    """A row per player and game from nested box scores."""
    x = df.select(F.from_json(column, BOX).alias("b")).select("b.home", "b.away", "b.period", F.explode("b.lineups").alias("l"))
    return x.select("home", "away", "period", "l.*")


def injuries(df: DataFrame, column: str) -> DataFrame:
    """A row per reported athlete; dates that do not parse are null."""
    x = df.select(F.from_json(column, INJURIES).alias("j")).select("j.season", F.explode("j.injuries").alias("t"))
    x = x.select("season", "t.team", F.explode("t.injuries").alias("i"))
    day = lambda c: F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")
    return x.select("season", "team", F.col("i.athlete.id").alias("player_id"), F.col("i.athlete.displayName").alias("name"), F.col("i.status").alias("status"), day(F.col("i.date")).alias("reported"), day(F.col("i.details.returnDate")).alias("return_date"), F.col("i.shortComment").alias("note"))


def draft_history(df: DataFrame, column: str, teams: str = "team") -> DataFrame:
    """A row per pick; owners may come as one name or as a list of names, of which the first counts; a bid of 0 is unknown."""
    x = df.select(F.from_json(column, DRAFT).alias("d")).select("d.season", F.explode("d.picks").alias("p")).select("season", "p.*")
    listed = F.try_element_at(F.from_json("owners", "array<string>"), F.lit(1))
    return x.withColumns({"owners": F.when(F.col("owners").startswith("["), listed).otherwise(F.col("owners")), "bid": F.when(F.col("bid") > 0, F.col("bid"))}).withColumnRenamed("owners", "owner").withColumnRenamed("team", teams)


def odds(df: DataFrame, column: str) -> DataFrame:
    """A row per outcome of every market."""
    x = df.select(F.from_json(column, ODDS).alias("o")).select("o.event", F.explode("o.markets").alias("m"))
    return x.select("event", F.col("m.name").alias("market"), F.inline("m.outcomes"))


def html_rows(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """keep, row, cells: the rows of the tables in a page, cells without markup; pages without tables give none."""
    rows = F.regexp_extract_all(F.col(column), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    x = df.select(*keep, F.posexplode(rows).alias("row", "_r"))
    cells = F.regexp_extract_all("_r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    return x.select(*keep, "row", F.transform(cells, lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, r"<[^>]*>", ""), r"\s+", " "))).alias("cells"))
