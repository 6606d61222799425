"""Main text of web pages by nearest-URL page differencing.

A page is cut into text lines (blocks), those of menus and footers included.  Pages of a host with the same lines are copies and count once.
Each is paired with the one whose URL path stands next to its own in path order and shares the longest prefix; all lines are aligned with
the partner's by longest common subsequence, and shared lines are deleted.  Two checks follow.  Lines of what a page declares as its article
(article, main) come back.  A page without a declared article that shares over EDITION of its text, or all of it, is an edition of its
partner: it takes the neighbour on its other side instead, and keeps its lines if that is an edition too, or there is none.

Then marks delete what pages of a host do not share.  Scripts, styles, and elements named as menu, header, footer, sidebar or form give no
text.  A class, id or role marks an element by a whole token: a word of WORDS ("sidebar"), or words of WORDS and PLACES together
("site-footer", not "has-sidebar"); on a page without a declared article, an element that holds over half of the page's text is no
boilerplate, whatever its class.  Inside a declared article such a mark deletes only lines that the partner shares too.

Pages are parsed twice, for the lines' hashes and for their text, so that the text moves once and is stored nowhere; what a page deletes is
decided once for all its copies, from hashes.  Pairing sorts (host, path) by range and joins the ends of neighbouring ranges, so a host with a
third of all pages is spread over many tasks.  Nulls are empty pages; a page alone on its host (copies aside) has no partner; repeated
rows, and rows that share a page_id, are pages of their own; ties of path go by the lines' digest.  Very long pages are read whole;
the alignment keeps one row of bits for every square root of their lines.  Other columns of pages are not read.
"""

from __future__ import annotations

import html as entities
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common as c

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTR = re.compile(r"(class|id|role|hidden|itemprop|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
# Names of elements, and words in class, id and role.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "option", "math", "canvas", "audio", "video"}
BOILER = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "datalist", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
IMPLIED = {"p", "li", "dt", "dd", "option", "tr", "td", "th"}
WORDS = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "masthead", "footer", "sidebar", "aside", "widget", "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "share", "sharing", "social", "comment", "comments", "disqus", "respond", "replies", "related", "recommended", "pagination", "pager", "login", "signin", "search", "toolbar", "skip", "copyright", "legal", "disclaimer", "contentinfo", "complementary", "alert", "alertdialog"}
PLACES = {"site", "main", "page", "global", "local", "top", "bottom", "left", "right", "upper", "lower", "primary", "secondary", "list", "box", "block", "wrap", "wrapper", "container", "section", "area", "bar", "panel", "item", "items", "links", "slot", "unit", "header", "form", "button", "buttons", "col", "column", "region", "group", "inner", "outer", "post", "article", "entry", "content", "reader", "user", "text", "signup", "1", "2", "3"}
OUTSIDE = {"header", "banner"}  # these mark the page's header, not an article's
MAIN = {"article", "main"}
ALWAYS = {"nav", "footer", "header", "head", "button", "dialog", "menu"}  # boilerplate however much text they hold


def _marks(attrs: str, inside: bool) -> bool:
    for m in ATTR.finditer(attrs):
        k, v = m[1].lower(), m[2] or m[3] or m[4] or ""
        if k == "hidden" and attrs[m.start() - 1 : m.start()].isspace():
            return True
        if k == "aria-hidden" and v.lower() == "true":
            return True
        if k in ("class", "id", "role"):
            for token in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", v).lower().split():
                parts = set(re.findall(r"[a-z0-9]+", token))
                if not inside and parts and parts <= OUTSIDE | PLACES and parts & OUTSIDE or parts & WORDS and parts <= WORDS | PLACES:
                    return True
    return False


ARTICLE, ELEMENT, CLASS = 1, 2, 4  # what a line lies in: a declared article, an element named as boilerplate, one marked by class, id or role


def lines(page: str) -> tuple[list[str], list[int]]:
    """All text lines of a page, and what each lies in."""
    out, main, marks = [], [], []  # with each line, the marked elements around it
    stack: list[tuple[str, int]] = []  # open elements other than inline ones, and the number of a marked one
    around: tuple[int, ...] = ()
    firm: set[int] = {0}
    named: set[int] = set()
    number = inside = declared = 0
    parts: list[str] = []
    at = 0

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(text)
                main.append(inside > 0)
                marks.append(around)

    def close(k: int):
        nonlocal inside, around
        for name, mark in stack[k:]:
            around = around[:-1] if mark else around
            inside -= name in MAIN
        del stack[k:]

    while True:
        m = TAG.search(page, at)
        parts.append(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ending, attrs = m[1] or m[4], m[3] or m[6] or ""
        if name == "br":
            parts.append(" ")
            continue
        if name in RAW and not ending:
            if attrs.rstrip().endswith("/") and name in ("svg", "iframe", "object", "math", "canvas"):
                continue
            e = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if name not in INLINE:
                parts.append(" ")
            if e:
                at = e.end()
            elif name in ("script", "style", "template", "textarea", "title"):
                at = len(page)
            continue
        inline = name in INLINE
        element = not ending and (name in BOILER or name == "header" and not inside)
        bad = element or not ending and name not in ("html", "body") and name not in MAIN and bool(attrs) and _marks(attrs, inside > 0)
        if not inline or bad:
            flush()
        if name in VOID:
            continue
        if ending:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                flush()
                close(k)
            continue
        if not inline and stack and stack[-1][0] in IMPLIED and (name in IMPLIED or stack[-1][0] == "p"):
            close(len(stack) - 1)
        if name in MAIN and around:  # an article cannot lie in a menu: the marked element was left open, or is a wrapper
            close(next(i for i, x in enumerate(stack) if x[1]))
        if name == "body" and around:
            close(0)
        if inline and not bad:
            continue
        mark = 0
        if bad:
            number += 1
            mark, around = number, (*around, number)
            if name in ALWAYS:
                firm.add(number)
            if element:
                named.add(number)
        stack.append((name, mark))
        inside += name in MAIN
        declared += name in MAIN
    flush()
    total, held = sum(map(len, out)), [0] * (number + 1)
    for text, around in zip(out, marks):
        for k in around:
            held[k] += len(text)
    wrapper = {k for k in range(1, number + 1) if not declared and k not in firm and 2 * held[k] > total}
    kinds = []
    for m, around in zip(main, marks):
        rest = set(around) - wrapper
        kinds.append(ARTICLE * m | ELEMENT * bool(rest & named) | CLASS * bool(rest - named))
    return out, kinds


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Indices of a's lines in a longest common subsequence with b, by bit-parallel rows; of the rows one in `step` is kept and the others are computed again."""
    both = set(a) & set(b)  # other lines stand in no common subsequence
    at, a, b = [i for i, x in enumerate(a) if x in both], [x for x in a if x in both], [y for y in b if y in both]
    where: dict[int, int] = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    step = math.isqrt(len(a)) + 1

    def rows(v: int, lo: int, hi: int) -> list[int]:
        out = [v]
        for x in a[lo:hi]:
            u = v & where[x]
            v = ((v + u) | (v - u)) & full
            out.append(v)
        return out

    kept = [full]
    for lo in range(0, len(a), step):
        kept.append(rows(kept[-1], lo, min(len(a), lo + step))[-1])
    out, j = [], len(b)
    for k in range(len(kept) - 2, -1, -1):
        part = rows(kept[k], k * step, min(len(a), (k + 1) * step))
        for i in range(len(part) - 2, -1, -1):
            if not j:
                break
            mask = (1 << j) - 1
            here = j - (part[i + 1] & mask).bit_count()  # zeros of a row count the length up to each column
            if here == j - (part[i] & mask).bit_count():
                continue
            # the line is needed: its partner is the column where the count first reaches this length
            j = (~part[i + 1] & mask).bit_length() - 1
            out.append(at[k * step + i])
    return out[::-1]


PAGE_RANGE = 100_000
PLACE = "STRUCT<host: STRING, path: STRING, digest: BIGINT>"


def pairs(pages: DataFrame) -> DataFrame:
    """host, digest, partner, other (digests) of distinct pages (host, path, digest): the neighbours in path order, first that with the longer common path; of equals the one before."""
    spark = pages.sparkSession
    # copies stand where their first path is
    k = pages.groupBy("host", "digest").agg(F.min("path").alias("path")).select(F.struct("host", "path", "digest").alias("here"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-k.count() // PAGE_RANGE))

    def run(batches):
        """Each row with those before and after it in its range."""
        last, kind = None, None  # the row that waits for its successor, with the one before it
        for b in batches:
            here = b.column("here")
            kind = here.type
            if not len(here):
                continue
            rows = here if last is None else pa.concat_arrays([last[0], here])
            before = pa.concat_arrays([pa.nulls(1, kind) if last is None else last[1], rows[:-1]])
            if len(rows) > 1:
                yield pa.RecordBatch.from_arrays([rows[:-1], before[:-1], rows[1:]], names=["here", "before", "after"])
            last = rows[-1:], before[-1:]
        if last is not None:
            yield pa.RecordBatch.from_arrays([*last, pa.nulls(1, kind)], names=["here", "before", "after"])

    local = k.repartitionByRange(n, "here").sortWithinPartitions("here").mapInArrow(run, f"here {PLACE}, before {PLACE}, after {PLACE}")
    local = c.stored(local)  # small beside the pages: no text; range bounds are sampled, so one materialisation has to serve all uses
    # the ends of ranges: two rows a range
    ends = local.where("before IS NULL OR after IS NULL").select("here", F.col("before").isNull().alias("b"), F.col("after").isNull().alias("a"))
    w = Window.orderBy("here")
    ends = ends.withColumns({"prev": F.lag("here").over(w), "next": F.lead("here").over(w)}).select("here", F.when(F.col("b"), F.col("prev")).alias("prev"), F.when(F.col("a"), F.col("next")).alias("next"))
    full = local.join(ends, "here", "left").select("here", F.coalesce("before", "prev").alias("before"), F.coalesce("after", "next").alias("after"))

    def common(x):
        a, b = F.split(F.col("here.path"), "/"), F.split(F.col(f"{x}.path"), "/")
        same = F.aggregate(F.zip_with(a, b, lambda p, q: p.eqNullSafe(q)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, e: F.struct((acc["n"] + F.when(acc["on"] & e, 1).otherwise(0)).alias("n"), (acc["on"] & e).alias("on")), lambda acc: acc["n"])
        return F.when(F.col(f"{x}.host") == F.col("here.host"), same)

    full = full.withColumns({"cb": common("before"), "ca": common("after")})
    ahead = F.col("cb").isNotNull() & (F.col("ca").isNull() | (F.col("cb") >= F.col("ca")))
    b, a = F.when(F.col("cb").isNotNull(), F.col("before.digest")), F.when(F.col("ca").isNotNull(), F.col("after.digest"))
    return full.select("here.host", "here.digest", F.when(ahead, b).otherwise(a).alias("partner"), F.when(ahead, a).otherwise(b).alias("other")).where("partner IS NOT NULL")


PLACED = "page_id long, url string, host string, path string, digest long"


LINE = np.dtype([("key", "<u8"), ("chars", "<u4"), ("kind", "u1")])


def _lines(text: list[str], kinds: list[int]) -> bytes:
    import xxhash

    out = np.zeros(len(text), LINE)
    out["key"] = [xxhash.xxh3_64_intdigest(y) for y in text]
    out["chars"], out["kind"] = [len(y) for y in text], kinds
    return out.tobytes()


def parsed(pages: DataFrame, text: bool) -> DataFrame:
    """page_id, url, host, path and digest of the lines of each page; with `text` its lines and what each lies in, else the lines' hashes, lengths and that."""
    import xxhash

    def run(batches):
        for b in c.slices(batches, "html"):
            got = [lines(x or "") for x in b.column("html").to_pylist()]
            digest = pa.array(np.fromiter((xxhash.xxh3_64_intdigest("\n".join(t)) for t, _ in got), np.uint64, len(got)).view(np.int64))
            more = [pa.array([t for t, _ in got], pa.list_(pa.string())), pa.array([m for _, m in got], pa.list_(pa.int8()))] if text else [pa.array([_lines(*x) for x in got], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("page_id", "url", "host", "path")), digest, *more], names=["page_id", "url", "host", "path", "digest", *(("text", "kinds") if text else ("lines",))])

    rest = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    own = pages.selectExpr("CAST(page_id AS LONG) page_id", "CAST(url AS STRING) url", "CAST(html AS STRING) html")
    return own.withColumns({"host": F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)}).mapInArrow(run, PLACED + (", text array<string>, kinds array<byte>" if text else ", lines binary"))


EDITION = 0.75


def shared(page: bytes, partner: bytes) -> tuple[bytes, bool]:
    """A bit for each of the page's lines, whether the partner shares it, and whether the page is an edition of it."""
    a, b = np.frombuffer(page, LINE), np.frombuffer(partner, LINE)
    gone = np.zeros(len(a), bool)
    gone[shared_lines(a["key"].tolist(), b["key"].tolist())] = True
    text = a["kind"] & (ELEMENT | CLASS) == 0
    held, lost = int(a["chars"][text].sum()), int(a["chars"][text & gone].sum())
    edition = not (a["kind"] & ARTICLE).any() and lost > 0 and (lost > EDITION * held or lost == held)
    return np.packbits(gone).tobytes(), edition


def choose(text: list[str], kinds: list[int], bits: bytes | None) -> list[str]:
    """A page's main text lines, given which of them its partner shares."""
    gone = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(text)).tolist() if bits is not None else [0] * len(text)

    def stays(kind: int, shared: int) -> bool:
        if kind & ELEMENT:
            return False
        return not (kind & CLASS and shared) if kind & ARTICLE else not (kind & CLASS or shared)

    return [t for t, k, g in zip(text, kinds, gone) if stays(k, g)]


def _aligned(frame: DataFrame, keep: str) -> DataFrame:
    """host, digest and the columns of `keep` (name type, ...) with the bits of shared() for rows of (lines, other_lines)."""
    names = ["host", "digest", *(x.split()[0] for x in keep.split(", ") if x)]

    def run(batches):
        for b in batches:
            for x in c.slices(iter([b]), "lines"):
                got = [shared(p, q) for p, q in zip(x.column("lines").to_pylist(), x.column("other_lines").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(x.column(n) for n in names), pa.array([g for g, _ in got], pa.binary()), pa.array([e for _, e in got], pa.bool_())], names=[*names, "gone", "edition"])

    return frame.select(*names, "lines", "other_lines").mapInArrow(run, f"host string, digest long, {keep + ', ' if keep else ''}gone binary, edition boolean")


def decided(k: DataFrame) -> DataFrame:
    """host, digest, gone: which lines of each distinct page (host, path, digest, lines) with a partner are shared."""
    lines_of = k.groupBy("host", "digest").agg(F.first("lines").alias("lines"))

    def of(by: str) -> DataFrame:
        return lines_of.select("host", F.col("digest").alias(by), F.col("lines").alias("other_lines"))

    near = pairs(k.select("host", "path", "digest"))
    first = c.stored(_aligned(lines_of.join(near, ["host", "digest"]).join(of("partner"), ["host", "partner"]), "other long"))
    out = first.select("host", "digest", F.when(~F.col("edition"), F.col("gone")).alias("gone"))
    again = first.where("edition AND other IS NOT NULL").select("host", "digest", "other")
    if again.isEmpty():
        return out
    second = _aligned(again.join(lines_of, ["host", "digest"]).join(of("other"), ["host", "other"]), "").where("NOT edition").select("host", "digest", F.col("gone").alias("instead"))
    return out.join(second, ["host", "digest"], "left").select("host", "digest", F.coalesce("gone", "instead").alias("gone"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    # copies are spread: a group of them has as many rows here as salts that its pages have
    spread = max(64, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(spread)).cast("int").alias("salt")
    k = c.stored(parsed(pages, text=False).select("host", "path", "digest", "lines", salt))
    gone = k.select("host", "digest", "salt").distinct().join(decided(k).where("gone IS NOT NULL"), ["host", "digest"])

    def run(batches):
        for b in batches:
            out = ["\n\n".join(choose(t, m, g)) for t, m, g in zip(*(b.column(x).to_pylist() for x in ("text", "kinds", "gone")))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    p = parsed(pages, text=True).select("page_id", "url", "text", "kinds", "host", "digest", salt)
    return p.join(gone, ["host", "digest", "salt"], "left").select("page_id", "url", "text", "kinds", "gone").mapInArrow(run, "page_id long, url string, text string, n_chars long")
