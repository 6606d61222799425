"""Hand-typed wording: words of a small vocabulary by edit distance, names of a large dictionary by a q-gram index, and names typed into a label.

A word of a vocabulary is found by Column expressions alone.  A dictionary of any size goes through an index: two texts within d edits share
one of their q d + 1 rarest q-grams (counted with their repeats), so each text meets the few that share a rare gram with it, and the banded
edit distance decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import col

Q = 2
SHORT, MIDDLE = 3, 6  # up to these lengths no edit, and one, is a typo; beyond, two are


def allowed(text: Column) -> Column:
    """How many edits of a text count as typos, by its length."""
    return F.when(F.length(text) <= SHORT, 0).when(F.length(text) <= MIDDLE, 1).otherwise(2)


# ---------------------------------------------------------------- a vocabulary


def nearest_word(token: Column, vocabulary: list[str], most: int = 2) -> Column:
    """The one word of the vocabulary with least edit distance to the token, at most `most` (a token of 4 letters: 1, of less: 0); the token itself where none or several are nearest."""
    limit = F.when(F.length(token) >= 5, most).when(F.length(token) == 4, min(most, 1)).otherwise(0)
    near = F.array(*(F.struct(F.levenshtein(token, F.lit(w)).alias("d"), F.lit(w).alias("w")) for w in vocabulary))
    best = F.array_min(F.transform(near, lambda x: x["d"]))
    ones = F.filter(near, lambda x: x["d"] == best)
    return F.when((best <= limit) & (F.size(ones) == 1), F.get(ones, F.lit(0))["w"]).otherwise(token)


def _tokens(text, vocabulary: list[str], aliases: dict[str, str]) -> Column:
    """Lower-case words of a text, each as its vocabulary word; signs inside a word before its last s go, other signs part words."""
    x = F.regexp_replace(F.lower(col(text)), r"(?<=[a-z])['’\"?;]+(?=s\b)", "")
    x = F.regexp_replace(x, r"[^a-z0-9]+", " ")
    names = F.create_map(*(F.lit(v) for kv in aliases.items() for v in kv)) if aliases else None
    exact = lambda t: F.coalesce(F.try_element_at(names, t), t) if aliases else t
    words = F.filter(F.split(x, " "), lambda t: t != "")
    return F.transform(words, lambda t: F.when(exact(t) != t, exact(t)).when(t.isin(*vocabulary), t).otherwise(nearest_word(t, vocabulary)))


def phrase(text, vocabulary: list[str], aliases: dict[str, str], silent: tuple[str, ...] = ()) -> Column:
    """A label's canonical wording: its words as vocabulary words, without the silent ones, joined by one blank.  Null stays null."""
    return F.array_join(F.filter(_tokens(text, vocabulary, aliases), lambda t: ~t.isin(*silent) if silent else F.lit(True)), " ")


def coded(text, codes: dict[str, str], aliases: dict[str, str], silent: tuple[str, ...] = ()) -> Column:
    """The code of a label whose canonical wording has one, else null.  The vocabulary is that of the codes' wordings."""
    vocabulary = sorted({w for k in codes for w in k.split()} | set(silent))
    table = F.create_map(*(F.lit(v) for kv in codes.items() for v in kv))
    return F.try_element_at(table, phrase(text, vocabulary, aliases, silent))


def split_label(text, markers: list[str], aliases: dict[str, str], lead: str = "total", tail: str = r"\s+[A-Z]{2,3}\s*-?\s*$") -> Column:
    """struct(name, label) of a text in which a name runs into a label: the label begins at the first word that is a marker, typos included, or at `lead` before
    it, whichever takes more; `tail` (a team) and dashes at the name's end go.  A text without a marker is a label without a name (null)."""
    raw = F.filter(F.split(F.trim(col(text)), r"\s+"), lambda t: t != "")
    words = F.transform(raw, lambda t: _tokens(t, [*markers, lead], aliases))
    is_marker = F.transform(words, lambda w: F.exists(w, lambda t: t.isin(*markers)))
    at = F.array_position(is_marker, True)
    before = F.get(words, (at - 2).cast("int"))
    start = F.when(at == 0, None).when((at > 1) & F.exists(F.coalesce(before, F.array().cast("array<string>")), lambda t: t == lead), at - 1).otherwise(at).cast("int")
    head = F.array_join(F.slice(raw, 1, start - 1), " ")
    head = F.trim(F.regexp_replace(F.regexp_replace(head, r"[\s-]+$", ""), tail, ""))
    return F.when(start.isNull(), F.struct(F.lit(None).cast("string").alias("name"), col(text).alias("label"))).otherwise(
        F.struct(F.when(head != "", head).alias("name"), F.array_join(F.slice(raw, start, F.size(raw)), " ").alias("label"))
    )


def recovered(df: DataFrame, name: str, label: str, short: str, codes: dict[str, str], shorts: dict[str, str], aliases: dict[str, str], markers: list[str], silent: tuple[str, ...] = ("total",), unknown: str = "UNKNOWN") -> DataFrame:
    """df with name, label and `stat`: by the short code where it has one, else by the label's wording, after a name that is missing or unknown was taken out of the
    label; rows that are left without a name are dropped, rows whose wording has no code stay with a null stat."""
    code = F.try_element_at(F.create_map(*(F.lit(v) for kv in shorts.items() for v in kv)), F.col(short))
    lost = code.isNull() & (F.col(name).isNull() | (F.upper(F.trim(F.col(name))) == unknown))
    x = df.withColumn("_split", F.when(lost, split_label(label, markers, aliases))).withColumn("_code", code)
    x = x.withColumns({name: F.coalesce("_split.name", name), label: F.coalesce("_split.label", label)})
    x = x.withColumn("stat", F.coalesce("_code", coded(label, codes, aliases, silent)))
    return x.where(F.col(name).isNotNull() & (F.upper(F.trim(F.col(name))) != unknown)).drop("_split", "_code")


# ---------------------------------------------------------------- a dictionary


def _grams(text: str) -> Column:
    """q-grams of a text with a sign before and after it, each with how often it came before: equal grams of a text are different items."""
    padded = F.concat(F.lit("\x01"), F.col(text), F.lit("\x02"))
    all_ = F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: padded.substr(i, F.lit(Q)))
    return F.transform(all_, lambda g, i: F.concat(g, F.size(F.filter(F.slice(all_, 1, i), lambda h: h == g)).cast("string")))


def _rare(df: DataFrame, text: str, often: DataFrame, edits: Column) -> DataFrame:
    """text, _gram: the q d + 1 rarest grams of each text, unseen ones first, all of a text that has fewer."""
    g = df.select(text, edits.alias("_d"), F.explode(_grams(text)).alias("_gram")).join(often, "_gram", "left")
    w = Window.partitionBy(text).orderBy(F.coalesce("_often", F.lit(0)), "_gram")
    return g.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= Q * F.col("_d") + 1).select(text, "_gram")


def nearest_names(queries: DataFrame, text: str, dictionary: DataFrame, name: str) -> DataFrame:
    """text, name, edits of each distinct text: the one nearest entry of the dictionary within allowed(text) edits; null where there is none, or several are as near.

    Exact: no candidate is left out.  Equal texts are looked up once, and exact hits need no index.
    """
    words = dictionary.where(F.col(name).isNotNull()).select(F.col(name).alias("_w")).distinct()
    asked = queries.where(F.col(text).isNotNull()).select(F.col(text).alias("_t")).distinct()
    hits = asked.join(words, F.col("_t") == F.col("_w")).select("_t", "_w", F.lit(0).alias("_e"))
    rest = asked.join(words, F.col("_t") == F.col("_w"), "left_anti").where(F.length("_t") > SHORT)
    often = words.select(F.explode(_grams("_w")).alias("_gram")).groupBy("_gram").agg(F.count("*").alias("_often"))
    left, right = _rare(rest, "_t", often, allowed(F.col("_t"))), _rare(words, "_w", often, F.lit(2))
    pairs = left.join(right, "_gram").select("_t", "_w").where(F.abs(F.length("_t") - F.length("_w")) <= allowed(F.col("_t"))).distinct()
    near = pairs.withColumn("_e", F.levenshtein("_t", "_w", 2)).where((F.col("_e") >= 0) & (F.col("_e") <= allowed(F.col("_t"))))
    w = Window.partitionBy("_t")
    best = near.withColumn("_best", F.min("_e").over(w)).where("_e = _best").withColumn("_n", F.count("*").over(w)).where("_n = 1").select("_t", "_w", "_e")
    return asked.join(hits.unionByName(best), "_t", "left").select(F.col("_t").alias(text), F.col("_w").alias(name), F.col("_e").alias("edits"))
