"""Posts and comments from the site's HTML pages, by an Arrow-batched parser; and what attributes mean."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.posts import COMMENT

COMMENTS = 80
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = {"p", "div", "li", "br", "h1", "h2", "h3", "h4", "blockquote", "tr", "ul", "ol"}
#: Attributes of a post and what they are called here.
ATTRIBUTES = {"id": "id", "permalink": "permalink", "post-title": "title", "author": "author", "subreddit-prefixed-name": "prefixed", "subreddit-name": "subreddit", "score": "score", "comment-count": "comments", "created-timestamp": "created", "domain": "domain", "content-href": "href"}


def parse_integer(x: Column) -> Column:
    """An integer written with commas or spaces; null if it is none."""
    return F.regexp_replace(x, r"[,\s]", "").try_cast("double").cast("bigint")


def age_hours(created: Column, as_of: Column) -> Column:
    """Hours from an ISO time to as_of (epoch seconds), never below 0; null if it is no time."""
    t = F.try_to_timestamp(created)
    return F.when(t.isNotNull(), F.greatest(F.lit(0.0), (as_of - F.unix_millis(t) / 1000) / 3600))


def absolute_url(url: Column, base: str = "https://www.reddit.com") -> Column:
    return F.when(url.rlike("(?i)\\Ahttps?://"), url).when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).when(F.startswith(url, F.lit("/")), F.concat(F.lit(base), url))


def is_site_host(host: Column) -> Column:
    return F.coalesce(host.rlike(r"(?:\A|\.)(?:reddit\.com|redd\.it)\z"), F.lit(False))


class _Reader(HTMLParser):
    """Collects each post with the text of its slots, and each comment."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.posts: list[dict] = []
        self.comments: list[dict] = []
        self.stack: list[tuple[str, dict | None, str | None]] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        top = self.stack[-1] if self.stack else (None, None, None)
        item, slot = top[1], a.get("slot") or top[2]
        if tag == "shreddit-post":
            item, slot = {**{ATTRIBUTES[k]: v for k, v in a.items() if k in ATTRIBUTES}, "parts": {}, "anchors": []}, None
            self.posts.append(item)
        elif tag == "shreddit-comment":
            item, slot = {"author": a.get("author"), "depth": a.get("depth"), "parts": {}, "anchors": []}, None
            self.comments.append(item)
        elif tag in ("script", "style"):
            slot = "-"
        if item is not None and slot:
            if tag == "a" and a.get("href") and slot in ("text-body", "comment"):
                item["anchors"].append(a["href"])
            if tag in _BLOCKS:
                item["parts"].setdefault(slot, []).append("\n")
        if tag not in _VOID:
            self.stack.append((tag, item, slot))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                _, item, slot = self.stack[k]
                if tag in _BLOCKS and item is not None and slot:
                    item["parts"].setdefault(slot, []).append("\n")
                del self.stack[k:]
                return

    def handle_data(self, data):
        if self.stack and self.stack[-1][1] is not None and self.stack[-1][2]:
            self.stack[-1][1]["parts"].setdefault(self.stack[-1][2], []).append(data)


def _said(item: dict, slot: str) -> str:
    lines = [" ".join(x.split()) for x in "".join(item["parts"].get(slot, ())).split("\n")]
    return "\n".join(x for x in lines if x)


def parse_page(html: str) -> tuple[list[dict], list[dict]]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    posts = []
    for p in reader.posts:
        title = " ".join((p.get("title") or _said(p, "title")).split())
        if title:
            posts.append({**{k: p.get(k) for k in ATTRIBUTES.values()}, "title": title, "body": _said(p, "text-body"), "anchors": p["anchors"], "credit": _said(p, "credit-bar")})
    comments = [{"author": c["author"], "text": _said(c, "comment"), "depth": int(c["depth"]) if (c["depth"] or "").isdigit() else 0} for c in reader.comments]
    return posts, [c for c in comments if c["text"] and c["text"] not in ("[deleted]", "[removed]")][:COMMENTS]


def extract_posts(pages: DataFrame, as_of: Column, html: str = "html", detail: bool = True) -> DataFrame:
    """A row for each post of pages, with a post's columns (and those of pages but html)."""
    comment = pa.list_(pa.struct([("author", pa.string()), ("text", pa.string()), ("depth", pa.int32())]))
    fields = [*ATTRIBUTES.values(), "body", "credit"]
    post = pa.list_(pa.struct([*((f, pa.string()) for f in fields), ("anchors", pa.list_(pa.string()))]))
    at = pages.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse_page(x or "") for x in b.column(at).to_pylist()]
            kept = b.drop_columns([html])
            yield kept.append_column("_posts", pa.array([f[0] for f in found], post)).append_column("_comments", pa.array([f[1] for f in found], comment))

    from pyspark.sql import types as T

    texts = ", ".join(f"{f}: string" for f in fields)
    kinds = T.StructType.fromDDL(f"_posts array<struct<{texts}, anchors: array<string>>>, _comments array<struct<author: string, text: string, depth: int>>")
    df = pages.mapInArrow(run, T.StructType([*[f for f in pages.schema.fields if f.name != html], *kinds.fields]))
    df = df.withColumn("_p", F.explode("_posts"))
    p = F.col("_p")
    anchors = F.filter(F.transform(p["anchors"], absolute_url), lambda u: u.isNotNull())
    href = absolute_url(p["href"])
    outward = F.when(href.isNotNull() & ~is_site_host(X.host_of(href)), F.array(href)).otherwise(F.array().cast("array<string>"))
    links = F.array_distinct(F.concat(anchors, X.extract_urls(p["body"]), outward))
    hosts = F.array_distinct(F.filter(F.concat(F.array(F.lower(p["domain"])), F.transform(links, X.host_of)), lambda h: h.isNotNull() & (h != "") & ~is_site_host(h) & ~F.startswith(h, F.lit("self."))))
    own = lambda c: F.lower(c["author"]) == F.lower(p["author"])
    comments = F.transform("_comments", lambda c: F.struct(c["author"].alias("author"), c["text"].alias("text"), F.coalesce(own(c), F.lit(False)).alias("isOp"), c["depth"].alias("depth")).cast(COMMENT))
    return df.select(
        *[c for c in pages.columns if c not in (html, "id", "url", "title", "body")], p["id"].alias("id"), absolute_url(p["permalink"]).alias("url"), p["title"].alias("title"), p["body"].alias("body"), p["author"].alias("author"),
        F.coalesce(F.regexp_replace(p["prefixed"], "(?i)\\Ar/", ""), p["subreddit"]).alias("subreddit"), parse_integer(p["score"]).alias("upvotes"), parse_integer(p["comments"]).alias("commentsCount"), age_hours(p["created"], as_of).alias("ageHours"),
        hosts.alias("outboundDomains"), links.alias("links"), p["credit"].rlike("(?i)brand affiliate").alias("brandAffiliateLabel"), F.when(F.lit(detail), comments).otherwise(F.slice(comments, 1, 0)).alias("visibleComments"), F.lit(detail).alias("isDetailPage"),
    )
