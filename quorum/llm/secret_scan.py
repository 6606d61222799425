"""Secrets in texts: three fixed patterns, and strings that a battery of randomness tests cannot tell from random ones.

DataFrame functions only.  One scan of the texts finds all matches; each becomes a row of numbers (its distance from the match before it, its
length, and for candidate strings the encoding and a p-value), written once.  Places are running sums per document.

Candidates are runs of 20 or more characters of base64 or base64url with a digit or a capital after a small letter.  The smallest alphabet
that holds a candidate's characters is its encoding; three tests ask whether it is uniform over that alphabet: Pearson's statistic against
both tails (a string that is too even is a sequence), runs above and below the middle, and the correlation of neighbours.  The p-value is
three times the least of them.  Distinct candidates of one encoding and one octave of lengths form a family, in which the Benjamini-Hochberg
procedure rejects those that are not random: a family of long strings, whose tests see more, has its own threshold and sets none for short
ones.  What is not rejected is reported as `random`, unless a pattern's match covers it.

Null and empty texts have no spans.  Repeated rows and repeated or null ids are rows of their own.  Columns other than the two named are not
read; an empty table gives no row.  Texts and candidates of any length are read whole, and overlapping matches of different kinds all count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

# The patterns, with either case spelled out, and the lengths below which a match is dropped
WORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in WORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]{16,}", "random": "[A-Za-z0-9+/_-]{20,}={0,2}"}
KINDS = tuple(PATTERNS)
ASSIGNED, ACCESS = 12, 18

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: From the smallest: alphabets in the order of their symbols' values
ALPHABETS = {
    "hex": DIGITS + LOWER[:6], "HEX": DIGITS + UPPER[:6], "base32": UPPER + DIGITS[2:8], "base36": DIGITS + LOWER, "BASE36": DIGITS + UPPER,
    "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_",
}
RATE = 0.05
BINS = 1_000_000


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal for z >= 0 (Abramowitz and Stegun 26.2.17, error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    return F.exp(-z * z / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))


def two_sided(z: Column) -> Column:
    return 2 * upper_tail(F.abs(z))


def battery(body: str, alphabet: str, sides: str, n: str, k: str) -> dict[str, Column]:
    """Scores, normal where the string is random: uniformity (cube-root transform with the statistic's exact moments), runs, serial correlation."""
    b, a, n, k = F.col(body), F.col(alphabet), F.col(n).cast("double"), F.col(k).cast("double")
    counts = F.transform(F.split(a, ""), lambda c: F.length(b) - F.length(F.replace(b, c)))
    squares = F.aggregate(counts, F.lit(0).cast("long"), lambda s, c: s + c.cast("long") * c)
    freedom = n * (k - 1) / (n - 1)
    cube = F.pow((k / n * squares - n) / (k - 1), F.lit(1.0) / 3)
    uniform = (cube - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
    side = F.call_function("translate", b, a, F.col(sides))
    changes = (2 * F.length(side) - F.length(F.replace(side, F.lit("01"))) - F.length(F.replace(side, F.lit("10")))) / 2
    runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    values = F.transform(F.split(b, ""), lambda c: F.position(c, a) - (k + 1) / 2)
    pairs = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), lambda x, y: x * y)
    serial = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / ((k * k - 1) / 12) / F.sqrt(n - 1)
    return {"uniform": uniform, "runs": runs, "serial": serial}


def found(docs: DataFrame) -> DataFrame:
    """Rows of all matches in one scan; a document without any has one row of nulls.  r numbers the documents."""
    d = docs.select(F.monotonically_increasing_id().alias("r"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select("*", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in PATTERNS.items()))

    def rows(kind: int, name: str) -> Column:
        """The matches, each with the number of characters between it and the one before it, which are those of the text's other pieces."""
        m = F.col(f"m_{name}")
        pieces = F.slice(F.split("text", PATTERNS[name], -1), 1, F.size(m))
        some = F.transform(F.arrays_zip(m.alias("m"), F.transform(pieces, F.length).alias("gap")), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x["gap"].alias("gap"), x["m"].alias("value")))
        return F.when(F.size(m) > 0, some).otherwise(F.array().cast("array<struct<kind:int,at:int,gap:int,value:string>>"))

    e = d.select("r", "doc_id", F.explode_outer(F.concat(*(rows(i, k) for i, k in enumerate(KINDS)))).alias("x")).select("r", "doc_id", "x.*")
    value, random = F.col("value"), F.col("kind") == KINDS.index("random")
    named = F.when(random & value.rlike("[0-9]|[a-z][A-Z]"), F.rtrim(value, F.lit("=")))
    e = e.withColumn("body", named)
    code = F.coalesce(*(F.when(F.col("body").rlike(f"^[{a.replace('-', chr(92) + '-')}]+$"), k) for k, a in ALPHABETS.items()))
    e = e.withColumn("encoding", code)
    alphabet = F.coalesce(*(F.when(F.col("encoding") == k, a) for k, a in ALPHABETS.items()))
    e = e.withColumn("alphabet", alphabet).withColumn("n", F.length("body")).withColumn("k", F.length("alphabet"))
    e = e.withColumn("sides", F.concat(F.repeat(F.lit("0"), F.expr("k div 2")), F.repeat(F.lit("1"), F.expr("k div 2"))))
    e = e.select("*", *(z.alias(c) for c, z in battery("body", "alphabet", "sides", "n", "k").items()))
    p = F.least(F.lit(1.0), 3 * F.least(*(two_sided(F.col(c)) for c in ("uniform", "runs", "serial"))))
    group = F.regexp_extract("value", ASSIGN, 2)
    long_enough = F.when(F.col("kind") == 0, F.length(group) >= ASSIGNED).when(F.col("kind") == 1, F.length("value") >= ACCESS).when(F.col("kind") == 2, True).otherwise(F.col("encoding").isNotNull())
    return e.select(
        "r", "doc_id", "kind", "at", "gap", F.length("value").alias("size"), long_enough.alias("ok"), "encoding", F.when(F.col("encoding").isNotNull(), F.length(F.bin("n")) - 1).alias("octave"),
        F.ceil(F.when(F.col("encoding").isNotNull(), p) * BINS).alias("bin"), F.when(F.col("encoding").isNotNull(), F.xxhash64("value")).alias("name"),
    )


def thresholds(rows: DataFrame, rate: float = RATE) -> DataFrame:
    """Per encoding and octave of lengths the largest p-value, in BINS, that Benjamini-Hochberg rejects.  Equal strings count once; p-values are rounded up to 1/BINS,
    so a family is at most BINS counts, and families number at most 8 encodings by 31 octaves, whatever the corpus."""
    once = rows.where("encoding IS NOT NULL").groupBy("name", "encoding", "octave").agg(F.first("bin").alias("bin"))
    counts = once.groupBy("encoding", "octave", "bin").count()
    family = Window.partitionBy("encoding", "octave")
    below, all_ = F.sum("count").over(family.orderBy("bin")), F.sum("count").over(family)
    passed = F.col("bin") * all_ <= rate * BINS * below
    return counts.withColumn("passed", passed).where("passed").groupBy("encoding", "octave").agg(F.max("bin").alias("limit"))


def spans(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """(r, doc_id, kind, start, end) of what stays; a document without any keeps one row of nulls."""
    placed = rows.repartition("r").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("r", "kind").orderBy("at"))).withColumn("start", F.col("end") - F.col("size"))
    placed = placed.join(F.broadcast(limits), ["encoding", "octave"], "left")  # at most 248 rows
    random = F.col("kind") == KINDS.index("random")
    stays = F.col("ok") & (~random | (F.col("bin") > F.coalesce("limit", F.lit(-1))))
    reach = F.max(F.when(~random & stays, F.col("end"))).over(Window.partitionBy("r").orderBy(F.asc_nulls_last("start"), "kind").rowsBetween(Window.unboundedPreceding, 0))
    stays = F.coalesce(stays & ~(random & (F.coalesce(reach, F.lit(-1)) >= F.col("end"))), F.lit(False))
    return placed.select("r", "doc_id", *(F.when(stays, F.col(c)).alias(c) for c in ("kind", "start", "end")))


def scanned(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per document the number of matches of each pattern, the digest of their places, and all spans."""
    rows = stored(found(docs))
    per = spans(rows, thresholds(rows, rate)).groupBy("r").agg(
        F.first("doc_id").alias("doc_id"), *(F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end")))).alias("all"),
    )
    names = F.array(*map(F.lit, KINDS))

    def joined(xs: Column) -> Column:
        return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")

    base = F.filter("all", lambda x: x["kind"] < KINDS.index("random"))
    return per.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), "n_random")
