"""WARC archives: a writer with revisit records, and a salvage reader.

Every page becomes one record in a gzip member of its own.  Of records with equal payloads of at least 100 bytes the
one with the smallest page_id is a response and the others are revisits of it that carry no payload.  Archives are
rows of a table in the shared folder, a few MB each.

The reader checks every member (gzip checksum) and record (version 1.0 or 1.1, header block, Content-Length, payload
digest); a member may hold several records.  After a failed check it looks for the next offset at which a valid gzip member or a
version line begins a record, goes on from there, and logs the bytes between as a quarantined gap; a sound member with
damaged records gives its sound ones and is logged whole.  A revisit counts only if the response that it refers to was
read, with the digest and length that the revisit names; others are logged as unmatched.

A null html is an empty payload, a null page_id a response that nothing refers to; repeated rows are separate records.  A
record of any length is one member; other columns of pages are not written.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType

from . import common as c

# Fixed values of the format.
VERSIONS = (b"WARC/1.1\r\n", b"WARC/1.0\r\n")
END = b"\r\n\r\n"
MEMBER = b"\x1f\x8b\x08"
MIN_SHARED = 100
ARCHIVE_BYTES = 4 << 20
NUMBER = re.compile(r"-?[0-9]{1,18}")
SHA256 = re.compile(r"sha256:[0-9a-f]{64}")
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(v: str) -> str:
    return "".join(x if x >= " " and x != "\x7f" else "".join(f"%{y:02X}" for y in x.encode()) for x in v)


def _id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url or "")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        lines.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(refers_to)), ("X-Refers-To-Page-Id", str(refers_to))]
    body = payload if refers_to is None else b""
    lines += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    return VERSIONS[0] + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + body + END


def member(raw: bytes, level: int = 5) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


@dataclass
class Record:
    offset: int
    head: dict[str, str]
    payload: bytes


@dataclass
class Read:
    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int]] = field(default_factory=list)  # quarantined bytes [from, to)


def _member(raw: bytes, at: int) -> tuple[bytes, int] | None:
    """A whole member's content and its end, or None where it fails its own checks."""
    z, out, i = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            if i >= len(raw):
                return None
            out.append(z.decompress(raw[i : i + (1 << 15)]))
            i += 1 << 15
    except zlib.error:
        return None
    return b"".join(out), min(i, len(raw)) - len(z.unused_data)


def _record(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Header, payload and end of the record at a version line, or None where a check fails."""
    if not raw.startswith(VERSIONS, at):
        return None
    stop = raw.find(END, at)
    if stop < 0:
        return None
    head = {}
    for line in raw[at + len(VERSIONS[0]) : stop].split(b"\r\n"):
        k, sep, v = line.partition(b":")
        if not sep:
            return None
        try:
            head[k.decode().strip().lower()] = v.decode().strip()
        except UnicodeDecodeError:
            return None
    if any(not NUMBER.fullmatch(head.get(k, "0")) for k in ("x-page-id", "x-refers-to-page-id", "x-payload-length")):
        return None
    length, said = head.get("content-length", ""), head.get("warc-payload-digest", "")
    if not NUMBER.fullmatch(length) or int(length) < 0:
        return None
    begin = stop + len(END)
    end = begin + int(length)
    if raw[end : end + len(END)] != END:
        return None
    body = raw[begin:end]
    if head.get("warc-type") == "revisit":
        if not SHA256.fullmatch(said) or "x-refers-to-page-id" not in head:
            return None
    elif said.startswith("sha256:") and hashlib.sha256(body).hexdigest() != said[7:]:
        return None
    return head, body, end + len(END)


def _inside(content: bytes, offset: int, out: Read) -> bool:
    """Adds a member's sound records; whether it holds nothing else."""
    inner = salvage(content, members=False)
    out.records += [Record(offset, r.head, r.payload) for r in inner.records]
    return bool(inner.records) and not inner.gaps


def salvage(raw: bytes, members: bool = True) -> Read:
    """All records of an archive (or, without members, of plain bytes) that pass their checks, and the gaps between them."""
    out, at, bad = Read(), 0, None
    while at < len(raw):
        end = None
        if members and raw.startswith(MEMBER, at):
            if m := _member(raw, at):
                end = m[1]
                if not _inside(m[0], at, out):
                    out.gaps.append((at if bad is None else bad, end))
                    bad = None
        elif r := _record(raw, at):
            out.records.append(Record(at, r[0], r[1]))
            end = r[2]
        if end is not None:
            if bad is not None:
                out.gaps.append((bad, at))
                bad = None
            at = end
            continue
        if bad is None:
            bad = at
        found = [raw.find(x, at + 1) for x in ((MEMBER, *VERSIONS) if members else VERSIONS)]
        at = min((x for x in found if x >= 0), default=len(raw))
    if bad is not None:
        out.gaps.append((bad, len(raw)))
    return out


def write(pages: DataFrame) -> DataFrame:
    """Rows (archive, bytes) of records for pages (page_id, url, html)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast(BinaryType()).alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    # digests decide on ids alone; payloads then meet the decision by their own id, so a digest of millions of pages is no key of theirs
    ids = p.where(F.octet_length("payload") >= MIN_SHARED).select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = ids.join(first, "digest").where("page_id > refers_to").distinct()
    p = p.join(again, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches):
        def row(k, parts):
            return pa.RecordBatch.from_arrays([pa.array([k]), pa.array([b"".join(parts)], pa.binary())], names=["archive", "bytes"])

        parts, size, k = [], 0, 0
        for b in c.slices(batches, "payload"):
            for r in b.to_pylist():
                m = member(record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"]))
                k = k if parts else int.from_bytes(hashlib.sha256(m).digest()[:7], "big")
                parts.append(m)
                size += len(m)
                if size >= ARCHIVE_BYTES:
                    yield row(k, parts)
                    parts, size = [], 0
        if parts:
            yield row(k, parts)

    return p.mapInArrow(run, "archive long, bytes binary")


SCAN = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive long, gap_start long, gap_end long, payload binary"
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def scan(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One salvage of (archive, bytes): a row per sound record, and one of record_type 'gap' per quarantined gap."""
    schema = SCAN if payloads else SCAN.rsplit(",", 1)[0]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            for k, raw in zip(b.column("archive").to_pylist(), b.column("bytes")):
                got, rows = salvage(raw.as_py()), []
                for r in got.records:
                    h = r.head
                    revisit = h.get("warc-type") == "revisit"
                    page, to = (int(h[x]) if x in h else None for x in ("x-page-id", "x-refers-to-page-id"))
                    length = int(h.get("x-payload-length", "0")) if revisit else len(r.payload)
                    digest = h.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(r.payload).hexdigest()
                    rows.append((page, h.get("warc-target-uri"), length, digest, "revisit" if revisit else "response", to, k, None, None, None if revisit else r.payload))
                rows += [(None, None, None, None, "gap", None, k, i, j, None) for i, j in got.gaps]
                cols = list(zip(*rows)) if rows else [()] * len(_KINDS)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in list(zip(cols, _KINDS))[: len(names)]], names=names)

    return archives.select("archive", "bytes").mapInArrow(run, schema)


def _sides(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The revisits, and the distinct responses under the names by which revisits refer to them."""
    return scanned.where("record_type = 'revisit'"), scanned.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()


REFERENCE = ["refers_to", "payload_digest", "payload_bytes"]


def records(scanned: DataFrame) -> DataFrame:
    """The responses, and the revisits whose response is there with the same digest and length."""
    revisits, responses = _sides(scanned)
    return scanned.where("record_type = 'response'").unionByName(revisits.join(responses, REFERENCE, "left_semi").select(scanned.columns)).drop("gap_start", "gap_end")


def quarantined(scanned: DataFrame) -> DataFrame:
    """The log: gaps of archives (archive, gap_start, gap_end) and unmatched revisits (archive, page_id, refers_to)."""
    revisits, responses = _sides(scanned)
    names = ["archive", "gap_start", "gap_end", "page_id", "refers_to"]
    return scanned.where("record_type = 'gap'").select(*names).union(revisits.join(responses, REFERENCE, "left_anti").select(*names))


def read(archives: DataFrame) -> DataFrame:
    """The verified records of (archive, bytes) with their payloads; a revisit's is null."""
    return records(scan(archives, payloads=True))
