"""Main text of web pages by site template removal.

A tolerant parser turns each page into blocks of text and a tree of the elements around them.
Elements' subtrees are hashed and counted per host; a subtree that recurs on many of a host's pages
is template and goes, unless it holds most of its page's or much of its article's text, or is a
paragraph, heading or the like of an article. Elements whose tag, role or whole class name says
that they are no main text go on every page; a name counts for less than an article inside.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize

#: A subtree is template from so many pages of its host and this share of them, or from many pages of a large host.
PAGES, SHARE, MANY = 3, 0.2, 50
#: A subtree with more of its page's or of its article's text is content.
OF_PAGE, OF_ARTICLE = 0.5, 0.3
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAME = re.compile(r"""\b(class|id|role|aria-label|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
#: White space of HTML and of Unicode alike is one space.
_SPACE = re.compile(r"\s+")
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes", "svg", "math", "object", "select", "button", "canvas", "audio", "video", "map"}
_AWAY = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "fieldset", "label", "input", "datalist", "legend", "option"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_FLOW = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "table", "thead", "tbody", "tr", "td", "th", "figure", "figcaption", "br", "hr"} | _INLINE
_PROSE = _FLOW - {"ul", "ol", "dl", "table", "figure"}
_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog", "alert", "toolbar"}
#: Whole class names and ids of what is no main text.
_BAD = frozenset(
    """ad ads advert adverts advertisement advertising ad-slot ad-container adsbygoogle sponsor sponsored promo promos promotion promotions banner
    nav navbar navigation main-nav site-nav main-menu menu breadcrumb breadcrumbs header site-header page-header masthead footer site-footer page-footer
    sidebar side widget widgets cookie cookies cookie-bar cookie-banner cookie-notice cookie-consent consent gdpr notice notices popup modal overlay
    newsletter newsletter-signup subscribe subscription signup login social social-links share sharing share-buttons related related-posts recommended
    comment comments comment-list comments-area disqus replies respond pagination pager toolbar skip skip-link copyright disclaimer""".split()
)
#: Names that inside an article may hold its title.
_TITLES = frozenset(("header", "page-header", "masthead", "banner"))
_ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", "figure"}
_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class _Page:
    """What one page's parse has found: elements in the order they open, blocks in page order."""

    def __init__(self) -> None:
        self.tag, self.up, self.hard, self.named, self.main, self.size, self.hash = ["html"], [-1], [False], [False], [-1], [0], [xxhash.xxh64("html")]
        self.blocks: list[tuple[str, int]] = []

    def open(self, tag: str, up: int, hard: bool, named: bool) -> int:
        e = len(self.tag)
        self.tag.append(tag)
        self.up.append(up)
        self.hard.append(hard)
        self.named.append(named)
        self.main.append(self.main[up] if self.main[up] >= 0 or tag not in ("article", "main") else e)  # the outermost article around
        self.size.append(0)
        self.hash.append(xxhash.xxh64(tag))
        return e

    def close(self, e: int) -> None:
        self.hash[self.up[e]].update(self.hash[e].digest())
        self.size[self.up[e]] += self.size[e]


def _unwanted(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is no main text by its tag, role or state, and whether by its name."""
    hard, named = tag in _AWAY and not (tag == "header" and in_article), False  # an article's own header holds its title
    if attrs and tag not in ("html", "body", "article", "main"):
        for m in _NAME.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _ROLE:
                hard = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hard = True
            elif name in ("class", "id"):
                found = _BAD.intersection(value.replace("_", "-").split())
                named |= bool(found - _TITLES if in_article else found)
    return hard, named


def _read(page: str) -> _Page:
    out = _Page()
    stack, parts, owner, seen = [0], [], 0, False

    def text_of(raw: str) -> None:
        nonlocal owner, seen
        if raw:
            top = stack[-1]
            if not seen and not raw.isspace():
                owner, seen = top, True
            parts.append(html.unescape(raw))
            out.hash[top].update(raw)
            out.size[top] += len(raw)

    def flush() -> None:
        nonlocal seen
        if parts:
            line = _SPACE.sub(" ", "".join(parts)).strip()
            parts.clear()
            seen = False
            if line:
                out.blocks.append((line, owner))

    def close(n: int) -> None:
        while len(stack) > n:
            e = stack.pop()
            if out.tag[e] not in _INLINE:
                flush()
            out.close(e)

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            text_of(page[at:])
            break
        text_of(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            text_of(html.escape(m[1]))
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if out.tag[stack[k]] == tag:
                    close(k)
                    break
                if tag in _INLINE and out.tag[stack[k]] not in _INLINE:
                    break  # an inline end tag closes no block
            else:
                if tag == "p":
                    flush()
            continue
        closed = m[4].rstrip().endswith("/")
        if tag in _RAW and not closed:
            gone = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            out.hash[stack[-1]].update(tag)
            at = gone.end() if gone else (end if tag in ("script", "style", "textarea", "title") else at)
            continue
        if tag in ("br", "hr"):
            flush()
            out.hash[stack[-1]].update(tag)
            continue
        if tag in _VOID:
            continue
        if tag in ("html", "body") and len(stack) <= 2:
            if tag == "body":
                close(1)
            continue
        if tag in _ENDS_P or tag in _SELF:
            for k in range(len(stack) - 1, 0, -1):
                open_ = out.tag[stack[k]]
                if open_ == "p" and tag in _ENDS_P or open_ in _SELF.get(tag, ()):
                    close(k)
                    break
                if open_ not in _INLINE and open_ not in ("td", "th") or tag in ("li", "dt", "dd") and open_ in ("ul", "ol", "dl"):
                    break
        if tag not in _INLINE:
            flush()
        hard, named = _unwanted(tag, m[4], out.main[stack[-1]] >= 0)
        if hard or named:
            flush()
        if closed and tag not in _INLINE and tag not in _FLOW and tag not in ("div", "section", "article", "main"):
            continue
        stack.append(out.open(tag, stack[-1], hard, named))
    close(1)
    flush()
    return out


def parse(page: str) -> tuple[list[str], list[int], list[int], list[int]]:
    """Blocks, the innermost element around each that may be template (-1: none), those elements' parents of their kind, and their hashes.

    Blocks of what is no main text are left out. Where the page has an article or main, its text is
    all there is, if need be in spite of a name around it; where names leave nothing, they count for nothing.
    """
    x = _read(page)
    n = len(x.tag)
    holds = [False] * n  # an article or main
    for e in range(n - 1, 0, -1):
        holds[x.up[e]] |= holds[e] or x.tag[e] in ("article", "main")
    strict, soft, hard = ([False] * n for _ in range(3))
    for e in range(1, n):
        up = x.up[e]
        hard[e] = hard[up] or x.hard[e]
        soft[e] = soft[up] or x.hard[e] or x.named[e] and not holds[e]
        strict[e] = strict[up] or x.hard[e] or x.named[e]
    kept: list[tuple[str, int]] = []
    for away, main in ((strict, True), (soft, True), (strict, False), (hard, False)):
        kept = [(t, e) for t, e in x.blocks if not away[e] and (x.main[e] >= 0 or not main)]
        if kept:
            break
    near, ups, hashes = [-1] * n, [], []
    for e in range(1, n):
        near[e] = near[x.up[e]]
        inside, tag = x.main[e], x.tag[e]
        if not x.size[e] or away[e] or holds[e] or inside == e or tag in _INLINE or inside >= 0 and tag in _PROSE:
            continue
        if x.size[e] > OF_PAGE * x.size[0] or inside >= 0 and x.size[e] > OF_ARTICLE * x.size[inside]:
            continue
        h = x.hash[e].intdigest()
        ups.append(near[e])
        near[e] = len(hashes)
        hashes.append(h - (1 << 64) if h >> 63 else h)
    return [t for t, _ in kept], [near[e] for _, e in kept], ups, hashes


def _parse_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
    for b in batches:
        cols = list(zip(*[parse(x or "") for x in b.column(2).to_pylist()])) or [()] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["page_id", "url", "page", "texts", "within", "ups", "hashes"])


def _text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, texts, within, ups, hashes, gone) to (page_id, url, text)."""
    for b in batches:
        out = []
        for texts, within, ups, hashes, gone in zip(*[b.column(k).to_pylist() for k in range(2, 7)]):
            if gone:
                known, away = set(gone), np.zeros(len(hashes) + 1, bool)  # the last stands for none
                for e, (up, h) in enumerate(zip(ups, hashes)):
                    away[e] = away[up] or h in known
                texts = [t for t, e in zip(texts, within) if not away[e]]
            out.append("\n".join(texts))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame, least_pages: int = PAGES, share: float = SHARE, many: int = MANY) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html).

    Blocks stand in page order, joined by one newline. If a page has an article or main element,
    its text is that element's; otherwise all that is no template. Null and empty pages have an
    empty text; pages of any length and depth are read whole. Pages whose url is null or has no host
    count as one host. Repeated rows are returned each, and pages of one html count as one page of
    a host; other columns are ignored; no rows give no rows.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    parsed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.xxhash64(F.col("html").cast("string")).alias("page"))
    parsed = parsed.mapInArrow(lean(_parse_all), "page_id long, url string, page long, texts array<string>, within array<int>, ups array<int>, hashes array<long>")
    parsed = materialize(parsed.withColumn("host", host).withColumn("row", F.monotonically_increasing_id()))
    subtrees = parsed.select("host", "row", "page", F.explode(F.array_distinct("hashes")).alias("hash"))
    seen = subtrees.groupBy("host", "hash").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= least_pages)
    size = parsed.groupBy("host").agg(F.countDistinct("page").alias("of"))
    template = seen.join(size, "host").where(F.col("pages") >= F.least(share * F.col("of"), F.lit(float(many)))).select("host", "hash")
    hit = materialize(subtrees.join(template, ["host", "hash"]).groupBy("row").agg(F.collect_set("hash").alias("gone")))  # of known size: sent whole only if small
    kept = parsed.join(hit, "row", "left").select("page_id", "url", "texts", "within", "ups", "hashes", "gone")
    text = kept.mapInArrow(lean(_text), "page_id long, url string, text string")
    return text.withColumn("n_chars", F.length("text").cast("long"))
