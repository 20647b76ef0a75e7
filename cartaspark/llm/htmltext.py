"""Main text of web pages by nearest-URL page differencing.

Pages are put in order of host and URL path; the nearest pages with other lines before and after a
page on the same host are its neighbours (copies of a page are not template, so they are passed
over).  All blocks of text of a page, whatever element they stand in, are aligned with those of each
neighbour by a longest common subsequence; blocks that a neighbour shares are the site's template
and are deleted, the others stay.

Where markup says plainly what a block is, it overrules differencing, which alone deletes article
lines that happen to repeat on the next page and keeps adverts that do not:

* blocks inside ``<article>`` or ``<main>`` stay, even if a neighbour has them as well;
* blocks inside navigation, header, footer, aside, form and similar elements, or in elements whose
  class or id names an advert, notice, sidebar or comment, go, even if no neighbour has them.  Inside
  ``<article>`` or ``<main>`` headers are text, and a name counts only if all words of a class (or of
  the id of a ``div``) say advert, comments, cookies, notice, sharing or the like, or where such a thing
  stands (``sidebar-left``, ``reader-comments``), and outside containers such as ``div`` and ``section``
  (``menu`` and ``notice``: anywhere) only if no other class stands beside it: ``entry-header``, ``related-work``, ``<p class="share price">``
  and the ids of headings name parts of the text.  Formulas are text, their annotations are not.

Every page's result says how many blocks it had, how many differencing found shared, and how many
the markup overruled.  Character references are decoded, white space inside a block becomes one
space, blocks are joined by one newline.  A null or empty html gives an empty text.  A null URL has
no host: such pages have no neighbours.  Pages with equal URLs are in order of page_id; rows that
agree in page_id, URL and html get the same result.  Extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .shared import Scratch

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
# fixed values of HTML
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "select", "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "button", "dialog", "head"}
TEXT = {"article", "main"}
_CHROME_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promo|related|share|sharing|sidebar|skip|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
#: Inside an article a class or id names what is no text if it is made of these words alone, at least one of the first set, or two of them.
_CHROME_WORDS = set("ad ads adsbygoogle advert adverts advertisement advertisements advertorial banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus menu nav navbar navigation newsletter notice notices pager pagination popup promo promos share sharing sidebar sponsor sponsored subscribe".split())
_WITH_OTHERS = set("related social".split())
_PLACES = set("area bar block bottom box button buttons container content form items left links list modal overlay posts articles stories reader readers right section signup site slot text thread top unit user widget wrap wrapper".split())
#: Classes that also stand beside others on parts of a text.
_ALONE = {"menu", "notice", "notices"}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_CHROME_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu", "menubar", "toolbar"}
CLOSES = {"p": BLOCK - {"body", "html", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
MAIN, OTHER, CHROME_KIND = 2, 1, 0
#: Elements of an article that may be an advert, comments and the like as a whole.
CONTAINER = {"div", "section", "aside", "ul", "ol", "dl", "table", "figure", "ins"}


def _chrome_in_text(name: str) -> bool:
    words = [w.lower() for w in _WORD.findall(name)]
    known = all(w in _CHROME_WORDS or w in _WITH_OTHERS or w in _PLACES or w.isdigit() for w in words)
    return known and (any(w in _CHROME_WORDS for w in words) or len(words) > 1 and any(w in _WITH_OTHERS for w in words))


def _names_chrome(tag: str, name: str, value: str, in_text: bool) -> bool:
    """Whether a class or id names what is never text."""
    if tag in ("html", "body", *TEXT):
        return False
    if not in_text:
        return _CHROME_NAME.search(value) is not None
    if name == "id":
        return tag == "div" and any(map(_chrome_in_text, value.split()))
    words = value.split()
    named = [word for word in words if _chrome_in_text(word)]
    return bool(named) and (len(named) == len(words) or tag in CONTAINER and any(word.lower() not in _ALONE for word in named))


def _kind(tag: str, attributes: str, inherited: int, in_text: bool) -> int:
    """Whether what stands in an element is text, undecided or chrome."""
    if inherited == CHROME_KIND or tag in CHROME and not (tag == "header" and in_text):
        return CHROME_KIND
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "")
            name = name.lower()
            if name == "hidden" or name == "role" and value.lower() in _CHROME_ROLE or name in ("class", "id") and _names_chrome(tag, name, value, in_text):
                return CHROME_KIND
    return MAIN if tag in TEXT else inherited


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, MAIN, OTHER or CHROME_KIND) of all blocks of a page in order; scripts, styles and the like are no text."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []
    open_tags: Counter[str] = Counter()
    parts: dict[bool, list[tuple[str, int]]] = {True: [], False: []}  # chrome or not: an inline button is no part of its paragraph
    kind, at = OTHER, 0

    def add(text: str) -> None:
        parts[kind == CHROME_KIND].append((text, kind))

    def flush() -> None:
        for own in (parts[False], parts[True]):
            if own:
                text = _SPACE.sub(" ", entities.unescape("".join(t for t, _ in own))).strip()
                if text:
                    out.append((text, own[-1][1]))
                own.clear()

    def pop() -> str:
        nonlocal kind
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        kind = stack[-1][1] if stack else OTHER
        return tag

    for found in _TOKEN.finditer(page):
        if found.start() < at:
            continue
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        tag = (found[3] or "").lower()
        if not tag:
            if found[1]:
                add(entities.escape(found[1]))
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            flush()
        if found[2]:
            if open_tags[tag]:
                while pop() != tag:
                    pass
        elif tag in RAW:
            if not found[4].rstrip().endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else len(page)
        elif tag not in VOID and not (found[4].rstrip().endswith("/") and tag not in BLOCK):
            while stack and tag in CLOSES.get(stack[-1][0], ()):
                pop()
            kind = _kind(tag, found[4], kind, kind == MAIN)
            stack.append((tag, kind))
            open_tags[tag] += 1
    if at < len(page):
        add(page[at:])
    flush()
    return out


def shared_lines(a: list[int], b: list[int], cells: int = 1 << 26) -> list[bool]:
    """For each item of a whether it is in a longest common subsequence of a and b.

    Bit-parallel rows (Hyyro 2004), traced back; beyond `cells` the problem is halved (Hirschberg 1975).
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not x or not y or not set(x) & set(y):
        middle = [False] * len(x)
    elif len(x) * len(y) <= cells or len(x) == 1:
        middle = _traced(x, y)
    else:
        half = len(x) // 2
        ahead, back = _lengths(x[:half], y), _lengths(x[half:][::-1], y[::-1])
        cut = int(np.argmax(ahead + back[::-1]))
        middle = shared_lines(x[:half], y[:cut], cells) + shared_lines(x[half:], y[cut:], cells)
    return [True] * lo + middle + [True] * hi


def _rows(x: list[int], y: list[int]) -> Iterator[int]:
    """After each item of x: a number whose zero bits mark where the length over y grows."""
    full, places = (1 << len(y)) - 1, {}
    for j, item in enumerate(y):
        places[item] = places.get(item, 0) | 1 << j
    row = full
    for item in x:
        match = row & places.get(item, 0)
        row = ((row + match) | (row - match)) & full
        yield row


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    row = (1 << len(y)) - 1
    for row in _rows(x, y):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _traced(x: list[int], y: list[int]) -> list[bool]:
    rows = [(1 << len(y)) - 1, *_rows(x, y)]
    out, j = [False] * len(x), len(y)
    for i in range(len(x), 0, -1):
        while j and rows[i] >> (j - 1) & 1:
            j -= 1  # y's last item adds nothing
        if not j:
            break
        if rows[i - 1] >> (j - 1) & 1 or (rows[i - 1] & ((1 << j) - 1)).bit_count() != (rows[i] & ((1 << j) - 1)).bit_count():
            out[i - 1] = True
            j -= 1
    return out


def _line(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def decide(lines: list[int], kinds: list[int], texts: list[str], neighbours: list[list[int]]) -> tuple[str, int, int, int]:
    """(text, blocks, blocks that a neighbour shares, blocks where the markup overruled differencing) of a page."""
    shared = [False] * len(lines)
    for other in neighbours:
        if other != lines:
            shared = [d or s for d, s in zip(shared, shared_lines(lines, other), strict=True)]
    keep = [k == MAIN or k == OTHER and not s for k, s in zip(kinds, shared, strict=True)]
    overruled = sum(k == s for k, s in zip(keep, shared, strict=True))
    return "\n".join(t for t, k in zip(texts, keep, strict=True) if k), len(lines), sum(shared), overruled


LINES = "a1 long, a2 long, host string, path string, page_id long, url string, lines array<long>"
PARSED = "a1 long, a2 long, page_id long, url string, texts binary, kinds array<int>, lines array<long>"
RESULT = "page_id long, url string, text string, n_blocks int, n_shared int, n_overruled int"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [[_line(t) for t, _ in blocks(page.as_py() or "")] for page in batch.column(6)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(lines, pa.list_(pa.int64()))], names=_names(LINES))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=6)
    for batch in batches:
        texts, kinds, lines = [], [], []
        for page in batch.column(4):
            own = blocks(page.as_py() or "")
            # chrome never stays, so its text need not move; no block holds a newline
            texts.append(pack.compress("\n".join(t if k != CHROME_KIND else "" for t, k in own).encode("utf-8", "surrogatepass")))
            kinds.append([k for _, k in own])
            lines.append([_line(t) for t, _ in own])
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(texts, pa.binary()), pa.array(kinds, pa.list_(pa.int32())), pa.array(lines, pa.list_(pa.int64()))], names=_names(PARSED))


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(2, 6)]
        out = []
        for packed, kind, line, near in zip(*columns, strict=True):
            texts = unpack.decompress(packed).decode("utf-8", "surrogatepass").split("\n") if line else []
            out.append(decide(line, kind, texts, near or []))
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int32()) for c in columns[1:])], names=_names(RESULT))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of copies within a task's sorted rows."""
    from pyspark import TaskContext

    part, last, at = TaskContext.get().partitionId(), None, -1
    for batch in batches:
        inside = np.zeros(batch.num_rows, np.int64)
        for i, key in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)):
            at += key != last
            last, inside[i] = key, at
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(inside), part, np.int32)), pa.array(inside)], names=["a1", "a2", "host", "lines", "digest", "part", "inside"])


def _neighbours(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """For each address (a1, a2) the lines of the nearest pages with other lines on its host: two arrays at most.

    One global order by (host, path), so that a host of any size spreads over tasks.
    """
    order = ["host", "path", "page_id", "url", "a1", "a2"]
    keyed = lines.where("host <> ''").withColumn("digest", F.xxhash64("lines"))
    numbered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("a1", "a2", "host", "lines", "digest").mapInArrow(_numbered, "a1 long, a2 long, host string, lines array<long>, digest long, part int, inside long")
    ordered = scratch.save(numbered, "ordered")
    key = F.struct("host", "digest")
    ends = ordered.groupBy("part").agg(F.max("inside").alias("last"), F.min_by(key, "inside").alias("from"), F.max_by(key, "inside").alias("to")).orderBy("part")
    starts, total, before = [], 0, None
    for r in ends.collect():  # one row per task
        total -= r["from"] == before  # a run of copies that goes on from the task before
        starts.append((r["part"], total))
        total, before = total + r["last"] + 1, r["to"]
    starts = ordered.sparkSession.createDataFrame(starts, "part int, start long")
    placed = ordered.join(F.broadcast(starts), "part").select("a1", "a2", "host", "lines", (F.col("start") + F.col("inside")).alias("place"))
    mine = placed.select("a1", "a2", "host", "place").distinct().withColumn("place", F.explode(F.array(F.col("place") - 1, F.col("place") + 1)))
    first = placed.groupBy("host", "place").agg(F.first("lines").alias("lines"))  # all rows of a run have the same lines
    return mine.join(first.hint("merge"), ["host", "place"]).groupBy("a1", "a2").agg(F.collect_list("lines").alias("near"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and counts of blocks of every page (page_id, url, html)."""
    scratch = Scratch(pages.sparkSession, "html")
    url = F.col("url").cast("string")
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    row = [F.col("page_id").isNull(), F.col("page_id"), F.col("url").isNull(), F.col("url"), F.col("html")]
    source = source.select(F.xxhash64(F.lit(1), *row).alias("a1"), F.xxhash64(F.lit(2), *row[::-1]).alias("a2"), "*")
    lines = scratch.save(source.select("a1", "a2", "host", "path", "page_id", "url", "html").mapInArrow(_lines, LINES), "lines")
    near = scratch.save(_neighbours(lines, scratch), "near")
    scratch.drop("lines", "ordered")
    # pages are parsed again instead of being kept: only the text of blocks that may stay is shuffled
    parsed = source.select("a1", "a2", "page_id", "url", "html").mapInArrow(_parsed, PARSED)
    met = parsed.join(near.hint("merge"), ["a1", "a2"], "left").select("page_id", "url", "texts", "kinds", "lines", "near")
    return met.mapInArrow(_decided, RESULT)
