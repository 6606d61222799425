"""Conversations whose turns are blank, repeated, cut off or out of order, repaired by the cheapest edits.

A conversation's roles and faults are spelled as a string of one letter a row, its signature.  Each distinct signature is solved once: the
table of a string (cheapest edits from each state to each state) is the product of the tables of its halves, remembered for short strings.
Audits then join back by signature, and a stream over rows in order replays them.

Rows are taken by turn (null first), then by role and by the text's MD5, which only orders rows of one turn.  A null conv_id is a conversation,
null roles and texts are one space, roles with other initials than s, u and a cannot be kept.  Repeated rows are duplicates.  Columns other
than the four named are not read; an empty table gives no row.  Texts are read one batch at a time.  A conversation's rows are ordered by
one task, which spills, since its digest runs over them one after another; its signature and its audit are strings of its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

SPACES = " \t\n\x0b\x0c\r"
PIECE = 64
SALTS = 32
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
OPEN = 1  # a truncated row that stays

# ---------------------------------------------------------------- signatures

EMPTY, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired roles so far end with
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # of an inserted or reroled row
KEPT = {(EMPTY, "s"): SYSTEM} | {(a, "au"[b == USER]): b for a, b in NEXT.items()}
CLOSING = {EMPTY: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


def _leaf(letter: str) -> dict:
    """Cheapest edits over one row, inserts before it included: at most two of them ever help."""
    out: dict = {}
    for start in range(4):
        state, spent, edits = start, 0, ""
        for _ in range(3):
            steps = [(DELETE, "D", state)]
            if letter != "x":
                more = OPEN if letter.isupper() else 0
                steps.append((REROLE + more, "R", NEXT[state]))
                if (end := KEPT.get((state, letter.lower()))) is not None:
                    steps.append((KEEP + more, "K", end))
            for cost, edit, end in steps:
                got = (spent + cost, edits + edit)
                out[start, end] = min(out.get((start, end), got), got)
            state, spent, edits = NEXT[state], spent + INSERT, edits + "I"
    return out


def _product(left: dict, right: dict) -> dict:
    """Costs add, edits follow each other.  Of equal costs no edits begin with the others (both use the same rows, and the last edit
    uses a row), so the ASCII-least whole is made of ASCII-least parts."""
    out: dict = {}
    for (a, b), (c1, e1) in left.items():
        for d in range(4):
            if (b, d) in right:
                c2, e2 = right[b, d]
                if (old := out.get((a, d))) is None or c1 + c2 <= old[0]:
                    got = (c1 + c2, e1 + e2)
                    out[a, d] = got if old is None else min(old, got)
    return out


@lru_cache(1 << 14)
def _short(signature: str) -> dict:
    return _leaf(signature) if len(signature) == 1 else _product(_short(signature[: len(signature) // 2]), _short(signature[len(signature) // 2 :]))


def _table(signature: str) -> dict:
    if len(signature) <= PIECE:
        return _short(signature)
    half = (len(signature) // 2 + PIECE - 1) // PIECE * PIECE  # whole pieces, so that equal pieces meet
    return _product(_table(signature[:half]), _table(signature[half:]))


def solve(signature: str) -> tuple[int, str]:
    """Cost and initials of the cheapest edits after which the roles' initials are (s?(ua)+)?, ties ASCII-least."""
    if not signature:
        return CLOSING[EMPTY]
    return min((c + CLOSING[b][0], e + CLOSING[b][1]) for (a, b), (c, e) in _table(signature).items() if a == EMPTY)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = b.column("signature").to_pylist()
        got = [solve(x) for x in names]
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([c for c, _ in got], pa.int64()), pa.array([e for _, e in got], pa.string())], names=["signature", "cost", "audit"])


# ---------------------------------------------------------------- rows


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, live) after a stated damage by crc32 of conv_id:turn; dropped rows stay, not live, so that no conversation is lost."""
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    k = F.crc32(named) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(k == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(k == 1, "").when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (k != 0).alias("live"),
        F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_again"),
    ).drop("_again")


def as_found(rows: DataFrame) -> DataFrame:
    """The same columns of rows that are to be repaired as they are."""
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(True).alias("live"))


def _order() -> list:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("h")]


def signatures(rows: DataFrame) -> DataFrame:
    """Per conversation its signature, its rows' first faults, gaps between turns and illegal neighbours.  Texts stay where they are: only their digests move."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    light = rows.select(
        "conv_id", "turn", "role", F.md5("text").alias("h"), "live", (bare == "").alias("empty"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"), F.substring("role", 1, 1).alias("i")
    ).repartition("conv_id")
    light = light.withColumn("again", F.row_number().over(Window.partitionBy("conv_id", "live", "role", "h").orderBy(F.asc_nulls_first("turn"))) > 1)
    w = Window.partitionBy("conv_id", "live").orderBy(*_order(), F.asc("again"))
    pos, before, last = F.row_number().over(w), F.lag("i").over(w), F.lag("turn").over(w)
    fault = F.when(F.col("empty"), "b").when(F.col("again"), "d").when(F.col("open"), "t")
    known = F.when(F.col("i").isin("s", "u", "a"), F.col("i")).otherwise("o")
    seen = light.select(
        "conv_id", "live", "turn", pos.alias("pos"), fault.alias("fault"),
        F.coalesce(~F.concat(before, "i").isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(last)).alias("new"),
        F.when(fault.isin("b", "d"), "x").when(fault == "t", F.upper(known)).otherwise(known).alias("letter"),
    ).withColumn("piece", F.when(F.col("live"), F.floor((F.col("pos") - 1) / PIECE)))
    live = F.col("live")

    def count(c):
        return F.coalesce(F.sum(F.when(live & c, 1).otherwise(0)), F.lit(0))

    def spelled(c: str, by: str):
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(by).isNotNull() & F.col("piece").isNotNull(), F.struct(by, c)))), lambda x: x[c]), "")

    pieces = seen.groupBy("conv_id", "piece").agg(
        spelled("letter", "pos").alias("letters"), *(count(F.col("fault") == f).alias(n) for f, n in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))),
        count(F.col("illegal")).alias("illegal"), count(F.col("new")).alias("turns"), F.min(F.when(live, F.col("turn"))).alias("first"), F.max(F.when(live, F.col("turn"))).alias("last"),
    )
    return pieces.groupBy("conv_id").agg(
        spelled("letters", "piece").alias("signature"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")),
        F.coalesce(F.max("last") - F.min("first") + 1 - F.sum("turns"), F.lit(0).cast("long")).alias("gaps"),
    )


def audited(rows: DataFrame) -> DataFrame:
    """Per conversation the counts of signatures(), and cost and audit of its cheapest repair."""
    per = stored(signatures(rows))
    solved = per.select("signature").distinct().mapInArrow(_solved, "signature string, cost long, audit string")
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")  # one signature may be that of a third of all conversations
    return per.withColumn("salt", salt).join(solved.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["signature", "salt"]).drop("salt")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(head, lines) of conversations in a stream in which each one's audit comes before its rows.  lines: (edit, turn, role, text), deleted rows too."""
    cols = ("conv_id", "kind", "turn", "role", "text", "audit", "counts")
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in cols)))
    ahead = [next(rows, None)]

    def lines(head: tuple) -> Iterator[tuple]:
        state = EMPTY
        for edit in head[5]:
            turn = role = None
            text = ""
            if edit != "I":
                row = ahead[0]
                assert row is not None and row[0] == head[0] and row[1] == 1, "an audit has more edits than its conversation has rows"
                _, _, turn, role, text = row[:5]
                ahead[0] = next(rows, None)
            if edit == "D":
                yield edit, turn, role, text
                continue
            if edit == "K":
                state = KEPT[state, role[:1]]
            else:
                state = NEXT[state]
                role = "user" if state == USER else "assistant"
            yield edit, turn, role, text

    while ahead[0] is not None:
        head, ahead[0] = ahead[0], next(rows, None)
        yield head, lines(head)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _in_order(rows: DataFrame, audits: DataFrame) -> DataFrame:
    turns = rows.where("live").select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.md5("text").alias("h"), "text", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("array<long>").alias("counts"))
    none = F.lit("")
    heads = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("h"), none.alias("text"), "audit", F.array(*COUNTS).alias("counts"))
    return turns.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order()).drop("h")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired conversations' rows: conv_id, n (place from 0), edit, turn (null where inserted), role, text; deleted rows have no place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, schema = [], 0, pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        for head, lines in _replayed(batches):
            n = 0
            for edit, turn, role, text in lines:
                out.append((head[0], None if edit == "D" else n, edit, turn, role, text))
                n += edit != "D"
                size += len(text) + 64
                if size > 4 << 20:
                    yield _batch(out, schema)
                    out, size = [], 0
        if out:
            yield _batch(out, schema)

    return _in_order(rows, audits).mapInArrow(run, "conv_id long, n long, edit string, turn long, role string, text string")


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Counts, cost and audit of each conversation, and the SHA-256 of its repaired lines role:text, joined by newlines, as they pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, schema = [], pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        for head, lines in _replayed(batches):
            sha, between = hashlib.sha256(), ""
            for edit, _, role, text in lines:
                if edit != "D":
                    sha.update(f"{between}{role}:{text}".encode())
                    between = "\n"
            out.append((head[0], *head[6], head[5], sha.hexdigest()))
            if len(out) == 4096:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return _in_order(rows, audits).mapInArrow(run, f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")
