"""Column expressions: every function takes columns (or names) and returns a Column."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def safe_ratio(num, den) -> Column:
    """num / den where den > 0, else null."""
    return F.when(col(den) > 0, col(num) / col(den))


def clip(c, low=None, high=None) -> Column:
    """Bounds that leave null null."""
    out = col(c)
    out = F.greatest(out, F.lit(low)) if low is not None else out
    out = F.least(out, F.lit(high)) if high is not None else out
    return F.when(col(c).isNotNull(), out)


def row_count(cols) -> Column:
    """Number of values that are not null."""
    return reduce(lambda a, b: a + b, (col(c).isNotNull().cast("int") for c in cols))


def row_sum(cols) -> Column:
    return F.when(row_count(cols) > 0, reduce(lambda a, b: a + b, (F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in cols)))


def row_mean(cols) -> Column:
    return row_sum(cols) / row_count(cols)


def row_any(cols) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(col(c), F.lit(False)) for c in cols))


def value_map(c, mapping: dict, default=None) -> Column:
    """Looked up in a dict; values that it lacks become default, or stay as they are where default is None."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(c)), col(c) if default is None else F.lit(default))


def bins(c, bounds: list[float], labels: list[str]) -> Column:
    """Label of the half-open band (low, high] that the value falls in; null outside."""
    out = F.when(F.lit(False), F.lit(""))
    for low, high, name in zip(bounds, bounds[1:], labels):
        out = out.when((col(c) > low) & (col(c) <= high), F.lit(name))
    return out


SUFFIXES = "JR|SR|II|III|IV|V"  # fixed values: generation suffixes


def fold(c) -> Column:
    """Compatibility decomposition without combining marks (NFKD), by an Arrow UDF: it has no built-in form."""
    import unicodedata

    def plain(x):
        return x if x is None or x.isascii() else "".join(y for y in unicodedata.normalize("NFKD", x) if not unicodedata.combining(y))

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(plain, na_action="ignore")

    return run(col(c))


def multi_replace(c, table: dict[str, str]) -> Column:
    """Literal replacements, one after another in the table's order."""
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), table.items(), col(c))


def contains_any(c, parts: list[str]) -> Column:
    """Whether a text has any of some literal parts."""
    return reduce(lambda a, b: a | b, (F.contains(col(c), F.lit(p)) for p in parts))


def capitalised(c) -> Column:
    """Words that are all lower case get a capital; others stay as written."""
    words = F.split(col(c), " ")
    return F.array_join(F.transform(words, lambda w: F.when(w == F.lower(w), F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))).otherwise(w)), " ")


def row_max(cols) -> Column:
    return F.greatest(*map(col, cols))


def row_min(cols) -> Column:
    return F.least(*map(col, cols))


def lenient(c, kind: str) -> Column:
    """Cast that gives null where a text does not parse."""
    return col(c).try_cast(kind)


def name_key(c) -> Column:
    """Join key of a personal name: folded, upper case, no stops or quotes, other signs as blanks, no generation suffix."""
    x = F.upper(fold(c))
    x = F.regexp_replace(x, r"[.'`‘’]", "")
    x = F.regexp_replace(x, r"[^A-Z0-9]+", " ")
    x = F.regexp_replace(F.trim(x), rf" ({SUFFIXES})$", "")
    return F.trim(F.regexp_replace(x, r" +", " "))


def ordinal(c) -> Column:
    """1st, 2nd, 3rd, 4th, 11th ..."""
    n = col(c)
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def signed_percent(c) -> Column:
    p = F.bround(col(c) * 100, 0).cast("long")
    return F.concat(F.when(p >= 0, "+").otherwise(""), p.cast("string"), F.lit("%"))


def american_to_probability(c) -> Column:
    o = col(c)
    return F.when(o < 0, -o / (-o + 100)).when(o > 0, F.lit(100.0) / (o + 100))


def shrunk(value, n, prior, k: float) -> Column:
    """(n * value + k * prior) / (n + k); the prior alone where nothing is known."""
    n0 = F.coalesce(col(n).cast("double"), F.lit(0.0))
    return (n0 * F.coalesce(col(value), F.lit(0.0)) + k * col(prior)) / (n0 + k)


def games_available(days, slate: int = 17, over: int = 365) -> Column:
    """Null date: the slate; beyond the season's end: 0; else what is left after days / 7 games."""
    d = col(days)
    return F.when(d.isNull(), F.lit(float(slate))).when(d > over, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(float(slate)), slate - d / 7)))


def hash_uniform(*keys, mod: int = 2147483647) -> Column:
    """A uniform in (0, 1) from whole-number keys by integer mixing: the same on any partitioning and in plain SQL."""
    x = F.lit(12345).cast("long")
    for k in keys:
        x = (x * 48271 + col(k).cast("long") * 69621 + 7) % mod
        x = (x * 16807 + 11) % mod
    return (x + 1) / F.lit(float(mod + 2))


def json_number(c, path: str) -> Column:
    return F.get_json_object(col(c), path).cast("double")


def juice_adjusted(line, under, over, c: float | Column = 0.25) -> Column:
    """A line moved by the difference of its prices: line + (under - over) * line * c."""
    return col(line) + (col(under) - col(over)) * col(line) * c
