"""Main text of web pages: blocks of the article, and page differencing where no article is marked.

Every page becomes a list of lines, one for each block.  Blocks in menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and comments (by tag, or by a word of class, id or role) are
left out; inside a marked article, only by tag, role or a class that is such a word and no more.  In a page that marks its article
or main part, the lines inside it are its text.  In any other page, distinct texts are ordered by URL path within their host; of the nearest other texts before
and after it, the one with the longer common path is its pair; lines are aligned by longest common
subsequence, and shared ones, the template, are deleted.  Differencing is not used on marked articles: two
addresses of one article, and articles with a passage in common, would lose text (figures in the README).

Pages are parsed and written once.  Only hosts, paths and hashes of texts are ordered, by range, so a host with
most pages is split over tasks; the ends of each range are looked up in the ranges beside it.  Each pair of texts
is compared once and joined back to all copies, so equal rows get equal text.  Null html counts as empty; null urls
are a host of their own.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from math import isqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, small_batches, written

#: Elements whose content is never text, whose content is never main text, that end a block, that have no end tag.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head", "title"}
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "select", "textarea", "input", "dialog", "menu"}
BLOCK = {
    "address", "article", "blockquote", "body", "caption", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "aside", "dialog", "menu",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MARKED = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
NOISE = (
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice notices popup modal newsletter subscribe signup comment comments disqus replies "
    "sidebar related recommended share sharing social breadcrumb breadcrumbs menu nav navbar navigation footer header masthead toolbar pagination pager widget"
).split()
_NOISE_WORD = re.compile(rf"(?:{'|'.join(NOISE)})", re.I)
_NOISE_PART = re.compile(rf"(?:^|[\s_-])(?:{'|'.join(NOISE)})(?:$|[\s_-])", re.I)
#: Elements that a following start tag of the same kind ends.
IMPLIED = {"p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)")
_REST = re.compile(r"""[^>"'=]*+(?:[=]\s*+|["'])?""")
_ATTRIBUTE = re.compile(r"""([^\s"'=>/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_SPACE = re.compile(r"\s+")


def _noisy(tag: str, attributes: str, marked: bool) -> bool:
    if tag in ASIDE:
        return True
    if not attributes.strip():
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).strip()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in ROLES):
            return True
        if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
            if any(map(_NOISE_WORD.fullmatch, value.split())) if marked else _NOISE_PART.search(value):
                return True
    return False


class Tags:
    """Tags of a page, one after the other.  A quote opens a value only behind ``=``.

    Time is linear: where a search for the end of a tag runs out of page, the quotes it opened are kept, and a later
    search that opens one of them ends there.
    """

    def __init__(self, page: str):
        self.page = page
        self.failed: set[int] = set()

    def end(self, at: int) -> tuple[int | None, int]:
        """The place of the ``>`` that ends a tag whose attributes begin at ``at``, or None and where to go on."""
        opened: list[int] = []
        page = self.page
        while True:
            m = _REST.match(page, at)
            at = m.end()
            if at >= len(page):
                break
            if page[at] == ">":
                return at, at
            if page[at - 1] == "=" or (m.group().rstrip().endswith("=") and page[at] in "\"'"):
                if page[at] not in "\"'":
                    continue
                close = -1 if at in self.failed else page.find(page[at], at + 1)
                opened.append(at)
                if close < 0:
                    break
                at = close + 1
        self.failed.update(opened)
        return None, opened[0] + 1 if opened else len(page)

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it ends an element, name, attributes) of the next tag or comment (no name) from ``at``."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                close = page.find("-->", start + 4)
                return start, (close + 3 if close >= 0 else len(page)), False, "", ""
            if page.startswith("<![CDATA[", start):
                close = page.find("]]>", start)
                return start, (close + 3 if close >= 0 else len(page)), False, "", ""
            if page.startswith(("<!", "<?"), start):
                close = page.find(">", start)
                return start, (close + 1 if close >= 0 else len(page)), False, "", ""
            if m := _NAME.match(page, start):
                close, go = self.end(m.end())
                if close is not None:
                    return start, close + 1, bool(m.group(1)), m.group(2).lower(), page[m.end() : close]
                at = go
            else:
                at = start + 1
        return None


def lines(page: str | None) -> tuple[bool, list[str]]:
    """Whether an article is marked, and the lines: of the article if so, else of all that is not left out."""
    page = page or ""
    tags = Tags(page)
    stack: list[tuple[str, bool, bool]] = []  # (tag, left out, marked)
    open_: Counter[str] = Counter()
    blocks: list[int] = []  # places of block elements in the stack
    out: list[tuple[bool, str]] = []
    piece: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(piece)).strip()
        piece.clear()
        if text:
            out.append((bool(stack) and stack[-1][2], text))

    def close(at: int) -> None:
        while len(stack) > at:
            if stack[-1][0] in BLOCK or stack[-1][1]:
                flush()
            open_[stack.pop()[0]] -= 1
            if blocks and blocks[-1] == len(stack):
                blocks.pop()

    at, n = 0, len(page)
    while at < n:
        found = tags.next(at)
        text = page[at : found[0] if found else n]
        if text and not (stack and stack[-1][1]):
            piece.append(html.unescape(text))
        if not found:
            break
        _, at, ending, tag, attributes = found
        if not tag:
            continue
        if ending:
            if open_[tag]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            elif tag in BLOCK and not (stack and stack[-1][1]):
                flush()
            continue
        if tag in BLOCK:
            # A block start ends an open p, li, ... of its own level, with what is open in it.
            for k in reversed(blocks):
                if tag in IMPLIED.get(stack[k][0], ()):
                    close(k)
                    break
                if stack[k][0] != "p":
                    break
        hidden, marked = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if tag in BLOCK and not hidden:
            flush()
        if tag == "br" and not hidden:
            piece.append(" ")
        if tag in VOID:
            continue
        if tag in RAW and tag != "head":
            close_tag = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close_tag.end() if close_tag else n
            continue
        if attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        noisy = hidden or tag == "head" or _noisy(tag, attributes, marked)
        if tag == "header" and marked and not hidden:
            noisy = False  # an article's own header holds its title
        if noisy and not hidden:
            flush()
        if tag in BLOCK:
            blocks.append(len(stack))
        open_[tag] += 1
        stack.append((tag, noisy, marked or tag in MARKED))
    flush()
    found = any(m for m, _ in out)
    return found, [t for m, t in out if m or not found]


def shared(a: list[str], b: list[str]) -> set[int]:
    """Places of a that a longest common subsequence of a and b has.

    A row of the table of lengths is one number, whose zero bits below j count the length up to j in b.  Only each
    sqrt(n)-th row is kept, and the rows between are made again on the way back.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    keep = set(range(lo)) | set(range(len(a) - hi, len(a)))
    mid_a, mid_b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    both = set(mid_a) & set(mid_b)
    left = [(lo + i, x) for i, x in enumerate(mid_a) if x in both]
    right = [x for x in mid_b if x in both]
    where: dict[str, list[int]] = {}
    for j, x in enumerate(right):
        where.setdefault(x, []).append(j)

    def places(x: str) -> int:
        bits = bytearray(len(right) // 8 + 1)
        for j in where[x]:
            bits[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(bits, "little")

    often = {x: places(x) for x, at in where.items() if len(at) > 64}  # few, so they fit
    full = (1 << len(right)) - 1

    def rows(row: int, lines_of: list[tuple[int, str]]) -> Iterator[int]:
        for _, x in lines_of:
            hit = row & (often[x] if x in often else places(x))
            row = ((row + hit) | (row - hit)) & full
            yield row

    step = max(1, isqrt(len(left)))
    kept, row = [full], full
    for p in range(0, len(left), step):
        for row in rows(row, left[p : p + step]):  # noqa: B007
            pass
        kept.append(row)
    i, j, length, block, above = len(left), len(right), len(right) - row.bit_count(), -1, []
    while i and j:
        if left[i - 1][1] == right[j - 1]:
            keep.add(left[i - 1][0])
            i, j, length = i - 1, j - 1, length - 1
            continue
        if (i - 1) // step != block:
            block = (i - 1) // step
            above = [kept[block], *rows(kept[block], left[block * step : block * step + step])]
        if j - (above[i - 1 - block * step] & ((1 << j) - 1)).bit_count() == length:
            i -= 1
        else:
            j -= 1
    return keep


def host_path(url: str | None) -> tuple[str, str]:
    m = re.match(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    host, path = (m.group(1).lower(), m.group(2)) if m else ("", url or "")
    return re.sub(r"^www\.|:\d+$", "", host), path


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _runs(rows: pd.DataFrame) -> list[list[tuple]]:
    """(host, path, key, marked) in order, in runs of one host and text."""
    entries = sorted(zip(rows["host"], rows["path"], rows["key"], rows["marked"], strict=True))
    return [list(run) for _, run in groupby(entries, lambda x: (x[0], x[2]))]


def _beside(ends: dict[int, list], part: int, way: int) -> tuple | None:
    """The nearest other text of the host before (way -1) or after (1) a range; ``ends``: see ``border``."""
    end = 0 if way < 0 else 1
    host, _, key = ends[part][end][0]
    order = sorted(ends)
    k = order.index(part) + way
    while 0 <= k < len(order):
        nearest, other = ends[order[k]][1 - end]
        if nearest[0] != host:
            return None
        if nearest[2] != key:
            return nearest
        if other or not ends[order[k]][2]:
            return other
        k += way
    return None


def pairs(pages: DataFrame) -> DataFrame:
    """host, path, key of every distinct text that has an unmarked page, and the key of its pair, if any."""

    def border(rows: pd.DataFrame) -> pd.DataFrame:
        """For the first and the last entry: it, the nearest other text of its host; whether all is one run."""
        runs = _runs(rows)
        out = []
        for end, one, two in ((0, runs[0][0], runs[1][0] if len(runs) > 1 else None), (1, runs[-1][-1], runs[-2][-1] if len(runs) > 1 else None)):
            two = two if two and two[0] == one[0] else (None,) * 3
            out.append((rows["part"].iloc[0], end, *one[:3], *two[:3], len(runs) == 1))
        return pd.DataFrame(out, columns=["part", "end", "host", "path", "key", "host2", "path2", "key2", "alone"])

    entries = pages.groupBy("host", "path", "key").agg(F.min("marked").alias("marked"))
    ordered = written(entries.repartitionByRange("host", "path", "key").withColumn("part", F.spark_partition_id()), "ordered")
    ends: dict[int, list] = {}
    for r in ordered.groupBy("part").applyInPandas(border, "part int, end int, host string, path string, key string, host2 string, path2 string, key2 string, alone boolean").collect():
        ends.setdefault(r.part, [None, None, r.alone])[r.end] = (r[2:5], r[5:8] if r.key2 is not None else None)
    beside = {part: (_beside(ends, part, -1), _beside(ends, part, 1)) for part in ends}

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        runs = _runs(rows)
        first, last = beside[int(rows["part"].iloc[0])]
        out = []
        for k, run in enumerate(runs):
            host, _, key, _ = run[0]
            near = (runs[k - 1][-1] if k else first, runs[k + 1][0] if k + 1 < len(runs) else last)
            near = [x for x in near if x and x[0] == host]
            out += [(host, path, key, max(near, key=lambda x: _common(x[1], path))[2] if near else None) for _, path, _, marked in run if not marked]  # noqa: B023
        return pd.DataFrame(out, columns=["host", "path", "key", "pair"])

    found = written(ordered.groupBy("part").applyInPandas(find, "host string, path string, key string, pair string"), "pairs")
    discard(ordered)
    return found


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, marked of every page."""
    small_batches(pages.sparkSession, 500)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = [host_path(u.as_py()) for u in batch.column(1)]
            found = [lines(x.as_py()) for x in batch.column(2)]
            texts = ["\n".join(t) for _, t in found]  # no line holds a line feed
            keys = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([h for h, _ in where], pa.string()), pa.array([p for _, p in where], pa.string()), pa.array([m for m, _ in found], pa.bool_()), pa.array(keys, pa.string()), pa.array(texts, pa.string())],
                ["page_id", "url", "host", "path", "marked", "key", "text"],
            )

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = text.split("\n") if text else []
                gone = shared(own, other.split("\n") if other else [])
                out.append("\n".join(x for k, x in enumerate(own) if k not in gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["key", "pair", "left"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = written(rows.mapInArrow(parse, "page_id long, url string, host string, path string, marked boolean, key string, text string"), "pages")
    found = pairs(parsed)
    each = found.filter("pair is not null").select("key", "pair").distinct()
    used = each.select("key").union(each.select("pair")).distinct()
    texts = parsed.select("key", "text").join(used, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    both = each.join(texts, "key").join(texts.select(F.col("key").alias("pair"), F.col("text").alias("other")), "pair")
    left = both.select("key", "pair", "text", "other").mapInArrow(differ, "key string, pair string, left string")
    plain = parsed.filter("not marked").join(found, ["host", "path", "key"], "left").join(left, ["key", "pair"], "left")
    out = plain.withColumn("text", F.coalesce("left", "text")).select("page_id", "url", "text", "marked").union(parsed.filter("marked").select("page_id", "url", "text", "marked"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "marked")
