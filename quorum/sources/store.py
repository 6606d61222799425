"""The artifact store: season=/league= folders of Parquet, whose metadata is written last and marks them complete."""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..operators.windows import latest_per


def watched(df: DataFrame) -> tuple[Observation, DataFrame]:
    """df with metrics that the job which consumes it fills: rows, and checksums of their hashes that no order or partitioning of the rows changes.

    Columns count by name.  Two hashes, each summed in halves, tell changed rows, and repeated ones, which would cancel in an exclusive or.
    """
    def plain(c: str) -> Column:
        kind = df.schema[c].dataType.simpleString()
        return F.to_json(c) if "map<" in kind else F.col(f"`{c}`")

    # a null field hashes to nothing, so which fields are null goes in as well
    cols = [x for c in sorted(df.columns) for x in (plain(c), F.col(f"`{c}`").isNull())]
    one, two = F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)
    halves = {f"{n}{k}": F.sum(F.shiftrightunsigned(h, 32) if k else h.bitwiseAND(F.lit(0xFFFFFFFF))) for n, h in (("a", one), ("b", two)) for k in (0, 1)}
    seen = Observation()
    return seen, df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.coalesce(v, F.lit(0)).alias(k) for k, v in halves.items()))


def checksum_of(seen: Observation) -> str:
    got = seen.get
    return ":".join(f"{got[k]:x}" for k in ("rows", "a0", "a1", "b0", "b1"))


class Store:
    """Artifacts below a root that any Hadoop file system can hold.

    Every write adds files under new names and then a metadata file with the next number, which says which of them count; nothing
    that a reader may hold is replaced.  `sweep` removes what no metadata file names any more.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p, jvm

    def _names(self, path: str) -> list[str]:
        fs, p, _ = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def folder(self, season: int, league: str) -> str:
        return f"{self.root}/season={season}/league={league}"

    def write(self, season: int, league: str, **artifacts: DataFrame) -> dict[str, bool]:
        """New files first, metadata last; earlier artifacts keep their entries.  Returns which artifacts hold other rows than before, as the writing job itself saw them."""
        folder, meta = self.folder(season, league), self.meta(season, league) or {"artifacts": {}, "number": 0}
        moved = {}
        for name, df in artifacts.items():
            file = f"{name}-{uuid.uuid4().hex}.parquet"
            seen, out = watched(df)
            out.write.parquet(f"{folder}/{file}")
            old, new = meta["artifacts"].get(name, {}), checksum_of(seen)
            moved[name] = old.get("fingerprint") != new
            meta["artifacts"][name] = {"file": file, "fingerprint": new, **described(self.spark.read.parquet(f"{folder}/{file}"))}
        meta["written_at"] = datetime.now(timezone.utc).isoformat()
        meta["versions"] = {"spark": self.spark.version}
        meta["number"] += 1
        fs, p, jvm = self._fs(f"{folder}/meta-{meta['number']:09d}.json")
        stage = jvm.org.apache.hadoop.fs.Path(f"{folder}/_{uuid.uuid4().hex}")
        out = fs.create(stage, False)
        out.write(bytearray(json.dumps(meta, sort_keys=True).encode()))
        out.close()
        if not fs.rename(stage, p):
            raise FileExistsError(f"{p} was written meanwhile")
        return moved

    def meta(self, season: int, league: str) -> dict | None:
        """The newest metadata, or None where the store is incomplete."""
        folder = self.folder(season, league)
        found = [x for x in self._names(folder) if x.startswith("meta-")]
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{folder}/{found[-1]}").collect())) if found else None

    def sweep(self, season: int, league: str, keep: int = 2) -> list[str]:
        """Removes all but the last `keep` metadata files and the artifacts that none of those names; returns what went."""
        folder, names = self.folder(season, league), self._names(self.folder(season, league))
        metas = [x for x in names if x.startswith("meta-")]
        used = {v["file"] for m in metas[-keep:] for v in json.loads("\n".join(r.value for r in self.spark.read.text(f"{folder}/{m}").collect()))["artifacts"].values()}
        gone = metas[:-keep] + [x for x in names if x.endswith(".parquet") and x not in used]
        for x in gone:
            fs, p, _ = self._fs(f"{folder}/{x}")
            fs.delete(p, True)
        return gone

    def read(self, season: int, league: str, name: str) -> DataFrame:
        meta = self.meta(season, league)
        if not meta or name not in meta["artifacts"]:
            raise FileNotFoundError(f"season {season}, league {league} has no {name}; write it first")
        return self.spark.read.parquet(f"{self.folder(season, league)}/{meta['artifacts'][name]['file']}")

    def required(self, seasons: list[int], league: str, name: str) -> DataFrame:
        """An artifact of all the seasons named; one that lacks it is an error that says so."""
        frames = [self.read(s, league, name).withColumn("season", F.lit(s)) for s in seasons]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def leagues(self) -> list[tuple[int, str]]:
        """(season, league) of the complete stores."""
        out = []
        for s in self._names(self.root):
            for lg in self._names(f"{self.root}/{s}"):
                if s.startswith("season=") and lg.startswith("league="):
                    key = int(s.split("=")[1]), lg.split("=")[1]
                    if self.meta(*key):
                        out.append(key)
        return out

    def seasons(self, name: str) -> DataFrame:
        """An artifact of all complete stores, with season and league, ragged schemas united."""
        frames = [self.read(s, lg, name).withColumns({"season": F.lit(s), "league": F.lit(lg)}) for s, lg in self.leagues() if name in self.meta(s, lg)["artifacts"]]
        if not frames:
            raise FileNotFoundError(f"no complete store has {name}")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def age_minutes(self, season: int, league: str) -> float | None:
        meta = self.meta(season, league)
        return meta and (datetime.now(timezone.utc) - datetime.fromisoformat(meta["written_at"])).total_seconds() / 60

    def stale(self, season: int, league: str, minutes: float) -> bool:
        age = self.age_minutes(season, league)
        return age is None or age > minutes


def described(df: DataFrame) -> dict:
    """Rows (from footers), columns, and the share of known values of every number column: what a report needs without a load."""
    numbers = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float", "int", "bigint")]
    r = df.agg(F.count("*").alias("_rows"), *(F.count(c).alias(c) for c in numbers)).first()
    return {"rows": r["_rows"], "columns": len(df.columns), "schema": df.schema.simpleString(), "coverage": {c: round(r[c] / r["_rows"], 4) if r["_rows"] else None for c in numbers}}


def footprint(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Rows and column names of a Parquet table, both from its footers."""
    df = spark.read.parquet(path)
    return df.count(), df.schema.names


def dated(date: str) -> str:
    """A snapshot's key, if it is a date as YYYY-MM-DD."""
    if datetime.strptime(date, "%Y-%m-%d").strftime("%Y-%m-%d") != date:
        raise ValueError(f"{date} is no date as YYYY-MM-DD")
    return date


def snapshot(df: DataFrame, path: str, date: str) -> None:
    """Adds (or replaces) one dated partition."""
    df.withColumn("date", F.lit(dated(date))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def latest_snapshot(df: DataFrame, at: str = "date") -> DataFrame:
    last = df.agg(F.max(at).alias("_last"))  # one row
    return df.crossJoin(last).where(F.col(at) == F.col("_last")).drop("_last")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """Path below the root, size and SHA-256 of every file."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").split("/")[-1]
    return x.select(F.regexp_extract("path", rf"{re.escape(root)}/(.*)$", 1).alias("name"), "length", F.base64(F.unhex(F.sha2("content", 256))).alias("sha256"))


def fingerprint(sums: DataFrame) -> str:
    """One hash of all names and checksums, in the order of names."""
    listed = F.array_sort(F.collect_list(F.concat_ws(":", "name", "sha256")))  # a listing: a row a file
    return sums.agg(F.sha2(F.array_join(listed, "\n"), 256).alias("f")).first()["f"]


def verify(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Files whose checksums differ, are missing on a side, or are unknown (a missing checksum never matches)."""
    a, b = local.select("name", F.col("sha256").alias("l")), remote.select("name", F.col("sha256").alias("r"))
    return a.join(b, "name", "full").where(~F.coalesce(F.col("l") == F.col("r"), F.lit(False)))


def mirror(spark: SparkSession, source: str, target: str) -> list[tuple[str, str]]:
    """Copies every file that target lacks or has otherwise; failures are collected by name, not raised."""
    store = Store(spark, target)
    there = store._fs(target)
    empty = spark.createDataFrame([], "name string, sha256 string")
    remote = checksums(spark, target) if there[0].exists(there[1]) else empty
    failed = []
    for row in verify(checksums(spark, source), remote).where("l IS NOT NULL").select("name").collect():  # names of files that differ
        a, p, jvm = store._fs(f"{source}/{row['name']}")
        b, q, _ = store._fs(f"{target}/{row['name']}")
        try:
            jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, True, spark._jsc.hadoopConfiguration())
        except Exception as e:
            failed.append((row["name"], str(e).splitlines()[0]))
    return failed


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts by name across seasons: files, seasons, bytes and the newest change."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content")
    name = F.regexp_extract("path", r"league=[^/]+/([A-Za-z0-9_]+?)(-[0-9a-f]{32})?\.", 1)
    season = F.regexp_extract("path", r"season=(\d+)", 1)
    return x.select(name.alias("artifact"), season.alias("season"), "length", "modificationTime").where("artifact <> ''").groupBy("artifact").agg(F.count("*").alias("files"), F.count_distinct("season").alias("seasons"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("changed"))


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or a typed empty frame where it is absent."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # only absence is forgiven
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def checked(df: DataFrame, keys: list[str], season: str | None = None, week: str | None = None, weeks: tuple[int, int] = (1, 22)) -> DataFrame:
    """df, if it has rows, unique and known keys, one season, and weeks in their range."""
    if week is not None:
        out = df.where(~F.coalesce(F.col(week).between(*weeks), F.lit(False))).limit(1).count()
        if out:
            raise ValueError(f"weeks outside {weeks[0]} to {weeks[1]}")
    r = df.agg(F.count("*").alias("n"), F.count_distinct(F.struct(*keys)).alias("k"), F.count_if(F.expr(" OR ".join(f"`{k}` IS NULL" for k in keys))).alias("null"), F.count_distinct(season or F.lit(1)).alias("s")).first()
    if not r["n"] or r["k"] != r["n"] or r["null"] or r["s"] > 1:
        raise ValueError(f"{r['n']} rows, {r['k']} keys, {r['null']} null keys, {r['s']} seasons")
    return df


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table with a header; types are inferred where no schema is given."""
    return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None, nullValue="NA")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, nullValue="NA")


_registries: dict[tuple[str, int], DataFrame] = {}


def registry(spark: SparkSession, path: str, schema: str, slot: str, default: str) -> DataFrame:
    """A CSV registry, read again only after its files change; rows without a slot get the default one."""
    fs, p, _ = Store(spark, path)._fs(path)
    changed = max((x.getModificationTime() for x in fs.listStatus(p)), default=0)
    if (path, changed) not in _registries:
        _registries[path, changed] = csv(spark, path, schema).withColumn(slot, F.coalesce(slot, F.lit(default)))
    return _registries[path, changed]


MARKET = "id LONG, onTeamId LONG, draftAuctionValue DOUBLE, keeperValue DOUBLE, player STRUCT<id: LONG, fullName: STRING, eligibleSlots: ARRAY<INT>, stats: ARRAY<STRUCT<seasonId: INT, statSourceId: INT, statSplitTypeId: INT, appliedTotal: DOUBLE, stats: MAP<STRING, DOUBLE>>>>"


GAMES = "210"  # fixed value: the key of games played in a line's stats


def market_entries(df: DataFrame, column: str, season: int, per_game: dict[str, str] | None = None) -> DataFrame:
    """Nested market JSON to rows; 0 and -1 prices are unknown, a missing projection is 0, and per-game values (name: key) are times the games.

    Of entries with one player the first by price counts.
    """
    x = df.select(F.from_json(column, MARKET).alias("e"))
    price = lambda c: F.when(F.col(c) > 0, F.col(c))
    line = F.try_element_at(F.filter("e.player.stats", lambda s: (s["seasonId"] == season) & (s["statSourceId"] == 1) & F.coalesce(s["statSplitTypeId"] == 0, F.lit(True))), F.lit(1))
    games = F.try_element_at(line["stats"], F.lit(GAMES))
    more = {name: F.try_element_at(line["stats"], F.lit(key)) * games for name, key in (per_game or {}).items()}
    out = x.select(F.col("e.player.id").alias("player_id"), F.col("e.player.fullName").alias("player_name"), F.col("e.player.eligibleSlots").alias("eligible_slots"), F.col("e.onTeamId").alias("on_team_id"), price("e.draftAuctionValue").alias("auction_value"), price("e.keeperValue").alias("keeper_value"), F.coalesce(line["appliedTotal"], F.lit(0.0)).alias("points"), games.alias("games"), *(v.alias(k) for k, v in more.items()))
    return latest_per(out, "player_id", F.col("auction_value").desc_nulls_last(), F.col("player_name"), F.col("points").desc())


def infobox(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Fields of a wiki infobox: references and markup stripped, links resolved to their label."""
    c = F.regexp_replace(F.col(column), r"(?s)<ref[^>]*?/>|<ref.*?</ref>|<!--.*?-->", "")
    c = F.regexp_replace(c, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    return df.select("*", *(F.nullif(F.trim(F.regexp_extract(c, rf"(?m)^\s*\|\s*{k}\s*=[ \t]*(.*)$", 1)), F.lit("")).alias(k) for k in keys))
