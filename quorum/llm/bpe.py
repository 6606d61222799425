"""Byte-level BPE with the tokenizers library over Arrow batches, and decoding by the reversed byte table.

A text is cut into the matches of the vocabulary's pattern, each distinct match is encoded once by the library, and ids
are gathered back in text order with the byte and character offsets of every token.  A token may end inside a
character: byte offsets are exact, and a character offset counts the characters that are complete before it.

A vocabulary is a file of the library (.json) or one of ranks (.tiktoken).  From ranks the library's model is built with
every way to put a token together from two, in order of rank, and whole matches that are tokens are taken as they are, as
ranks prescribe.  Special tokens that a text spells are ordinary text, unless `special` asks for the library's own
handling, which takes them out of the text first.

Null and empty texts have no token; repeated rows are encoded each for itself.  Very long texts are matched PART characters at a time, and
a worker keeps the ids of up to CACHE matches.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SLICE = 2 << 20
PART = 1 << 20
MARGIN = 3  # characters of the longest match that a shorter one can stand for
LONG = 8 << 20
GROUP = 1000
CACHE = 400_000


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, reversed."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def from_ranks(path: str):
    """The library's byte-level BPE model with the vocabulary of a file of ranks."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    spelled = {b: x for x, b in byte_chars().items()}
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    text = {t: "".join(map(spelled.__getitem__, t)) for t in ranks}
    order = sorted(ranks, key=ranks.get)
    merges = [(text[t[:i]], text[t[i:]]) for t in order for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    tok = Tokenizer(models.BPE({text[t]: r for t, r in ranks.items()}, merges, ignore_merges=True, cache_capacity=0))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tok


def _reordered(pattern: str) -> str:
    """The same pattern with frequent alternatives first: those after the contractions that cannot match where a contraction does."""
    import regex

    parts = pattern.split("|")
    if any(x in pattern for x in ("(?:", "(?=", "\\|")):  # alternatives inside groups: left as it is
        return pattern
    first = next((i for i, x in enumerate(parts) if not x.startswith("'")), len(parts))
    last = next((i for i in range(first, len(parts)) if regex.match(parts[i], "'")), len(parts))
    return "|".join([*parts[first:last], *parts[:first], *parts[last:]])


def _below_256(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _narrow(pattern: str) -> re.Pattern | None:
    """The pattern for texts of code points below 256, whose classes are then lists of characters that the faster standard engine takes; None where it holds other escapes."""
    import regex

    every = "".join(map(chr, range(256)))
    listed = {k: "".join(f"\\x{ord(x):02x}" for x in regex.findall(k, every)) for k in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside = [], False
    for x in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        if x in listed:
            x = listed[x] if inside else f"[{listed[x]}]"
        elif x == r"\S" and not inside:
            x = f"[^{listed[chr(92) + 's']}]"
        elif x.startswith("\\"):
            return None
        inside = x == "[" or inside and x != "]"
        out.append(x)
    return re.compile("".join(out))


class Encoder:
    """Encodes texts of UTF-8 bytes; one per Python worker."""

    _made: dict[tuple[str, bool], "Encoder"] = {}

    @classmethod
    def of(cls, path: str, special: bool = False) -> "Encoder":
        if (path, special) not in cls._made:
            cls._made[path, special] = cls(path, special)
        return cls._made[path, special]

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.pattern = regex.compile(_reordered(public_tokenizers.PATTERN))
        self.narrow = _narrow(_reordered(public_tokenizers.PATTERN))
        self.tok = Tokenizer.from_file(path) if path.endswith(".json") else from_ranks(path)
        self.tok.encode_special_tokens = True  # of single matches; special ones are taken out before
        own = self.tok.get_added_tokens_decoder() if special else {}
        self.special = {t.content: array("i", [i]).tobytes() for i, t in own.items()}
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if own else None
        self.known: dict[str, bytes] = dict(self.special)
        table = byte_chars()
        vocab = self.tok.get_vocab()
        size = max(vocab.values()) + 1
        self.spelled: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.spelled[i] = bytes(table[x] for x in s) if all(x in table for x in s) else s.encode()
        self.width = np.array([len(x) for x in self.spelled], np.int64)
        self.spelling = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.at = np.cumsum(self.width) - self.width
        self.decimal = [str(i) for i in range(size)]

    def matches(self, text: str) -> Iterator[list[str]]:
        """The pattern's matches, a part of a long text at a time; matches in a part's last characters may be others in the whole text, so the next part begins with them."""
        if len(text) <= PART:
            yield (self.narrow if self.narrow and _below_256(text) else self.pattern).findall(text)
            return
        at, size = 0, PART
        while at < len(text):
            got = self.pattern.findall(text, at, at + size)
            done = sum(map(len, got))
            while got and at + size < len(text) and done > size - MARGIN:
                done -= len(got.pop())
            size = PART if done else 2 * size
            at += done
            yield got

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """The matches of a text, special tokens as one each; a part of a long text at a time."""
        if self.apart is None:
            yield from self.matches(text)
            return
        for i, x in enumerate(self.apart.split(text)):
            if i % 2:
                yield [x]
            else:
                yield from self.matches(x)

    def forget(self) -> None:
        self.known.clear()
        self.known.update(self.special)

    def _learn(self, got: Iterable[list[str]]) -> None:
        known = self.known
        if len(known) > CACHE:
            self.forget()
        new = [x for x in set(chain.from_iterable(got)) if x not in known]
        groups = [new[i : i + GROUP] for i in range(0, len(new), GROUP)]
        for words, e in zip(groups, self.tok.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)):
            # a group is one encoding; the widths of its tokens say where each match ends
            ids = np.array(e.ids, np.int32)
            ends = np.cumsum([len(x.encode()) for x in words])
            at = (4 * (np.searchsorted(np.cumsum(self.width[ids]), ends) + 1)).tolist()
            raw = ids.tobytes()
            known.update((x, raw[i:j]) for x, i, j in zip(words, [0, *at], at))

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after another, and n + 1 offsets."""
        raw, rows, of = data.tobytes(), [], self.known.__getitem__
        if len(raw) > LONG:  # a long text, whose matches are not held together
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                parts = []
                for got in self._pieces(raw[a:b].decode()):
                    self._learn([got])
                    parts.append(b"".join(map(of, got)))
                rows.append(b"".join(parts))
        else:
            got = [list(chain.from_iterable(self._pieces(raw[a:b].decode()))) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            self._learn(got)
            rows = [b"".join(map(of, x)) for x in got]
        ids = np.frombuffer(b"".join(rows), np.int32)
        return ids, np.r_[0, np.cumsum([len(x) // 4 for x in rows])].astype(np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids spell, through the reversed byte table; characters split between tokens come out whole."""
        return self.spelling[c.ragged(self.at[ids], self.width[ids])]

    def offsets(self, ids: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte end and character end of every token of one text."""
        end = np.cumsum(self.width[ids])
        chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        whole = chars[np.minimum(end, len(data))] - ((end < len(data)) & ((data[np.minimum(end, len(data) - 1)] & 0xC0) == 0x80)) if len(data) else end * 0
        return end, whole


def encoded(batches: Iterator[pa.RecordBatch], path: str, col: str = "text", special: bool = False):
    """For slices of the batches: the slice, its bytes and offsets, ids and id offsets."""
    tok = Encoder.of(path, special)
    for b in c.slices(batches, col, SLICE):
        data, off = c.flat(b.column(col))
        yield tok, b, data, off, *tok.encode(data, off)
    tok.forget()  # the worker may go on to other work
    c.trim()


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, byte_ends, char_ends: tokens with the offsets where each ends."""
    path = path or vocabulary()

    def run(batches):
        for tok, b, data, off, ids, at in encoded(batches, path):
            ends = [tok.offsets(ids[i:j], data[p:q]) for i, j, p, q in zip(at, at[1:], off, off[1:])]
            lists = [pa.array([ids[i:j] for i, j in zip(at, at[1:])], pa.list_(pa.int32()))] + [pa.array([x[k].astype(np.int32) for x in ends], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *lists], names=["doc_id", "ids", "byte_ends", "char_ends"])

    return docs.selectExpr(f"CAST({id_col} AS LONG) doc_id", f"CAST({text_col} AS STRING) text").mapInArrow(run, "doc_id long, ids array<int>, byte_ends array<int>, char_ends array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, bytes of (doc_id, ids)."""
    path = path or vocabulary()

    def run(batches):
        tok = Encoder.of(path)
        for b in batches:
            rows = [tok.decode(np.asarray(x.as_py() or [], np.int64)).tobytes() for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_split (tokens that end inside a character), encoded and decoded batch by batch, so ids need not travel."""
    path = path or vocabulary()

    def run(batches):
        for tok, b, data, off, ids, at in encoded(batches, path):
            text, end = tok.decode(ids).tobytes(), np.r_[0, np.cumsum(tok.width[ids])]
            inside = np.zeros(len(end), bool)
            part = end[1:-1]
            inside[1:-1] = (data[part] & 0xC0) == 0x80
            split = np.r_[0, np.cumsum(inside)]
            rows = ids.tolist()
            sha, back = [], []
            for i, j in zip(at.tolist(), at[1:].tolist()):
                sha.append(hashlib.sha256(" ".join(map(tok.decimal.__getitem__, rows[i:j])).encode()).hexdigest())
                back.append(hashlib.sha256(text[end[i] : end[j]]).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at)), pa.array(sha, pa.string()), pa.array(back, pa.string()), pa.array(split[at[1:]] - split[at[:-1]])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split"])

    return docs.selectExpr("CAST(doc_id AS LONG) doc_id", "CAST(text AS STRING) text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long")
