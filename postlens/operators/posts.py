"""The posts table: its schema, its limits, and which rows are valid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import MAX_BODY, MAX_COMMENT, MAX_COMMENTS, MAX_LINKS, MAX_TITLE

COMMENT = "struct<author: string, text: string, isOp: boolean, depth: int>"
HISTORY = (
    "struct<author: string, fetchedAt: bigint, available: boolean, reason: string, accountAgeDays: double, linkKarma: bigint, commentKarma: bigint, truncated: boolean, "
    "submissions: array<struct<id: string, subreddit: string, title: string, domain: string, url: string, excerpt: string, createdUtc: bigint, permalink: string>>, "
    "comments: array<struct<subreddit: string, excerpt: string, createdUtc: bigint, linkDomains: array<string>, postTitle: string>>>"
)
FIELDS = {
    "id": "string", "url": "string", "title": "string", "body": "string", "author": "string", "subreddit": "string", "upvotes": "bigint", "commentsCount": "bigint",
    "ageHours": "double", "subredditSubscribers": "bigint", "outboundDomains": "array<string>", "links": "array<string>", "brandAffiliateLabel": "boolean",
    "visibleComments": f"array<{COMMENT}>", "isDetailPage": "boolean", "authorHistory": HISTORY,
}
POST = ", ".join(f"{k} {v}" for k, v in FIELDS.items())


def conform(df: DataFrame) -> DataFrame:
    """df with every column of a post, null where it has none; its other columns stay."""
    here = df.columns
    fields = [(F.col(name) if name in here else F.lit(None)).cast(kind).alias(name) for name, kind in FIELDS.items()]
    return df.select(*[F.col(f"`{c}`") for c in here if c not in FIELDS], *fields)


def with_problems(df: DataFrame) -> DataFrame:
    """conform(df) with problems: what makes a row invalid (empty if it is valid), ten at most."""
    c, n = F.col, F.length
    checks = [
        ("title: 1 to 600 characters", c("title").isNull() | ~n("title").between(1, MAX_TITLE)),
        ("body: too long", n("body") > MAX_BODY),
        ("id: too long", n("id") > 100),
        ("url: too long", n("url") > 2_000),
        ("author: too long", n("author") > 100),
        ("subreddit: too long", n("subreddit") > 100),
        ("upvotes: out of range", ~c("upvotes").between(-1_000_000, 100_000_000)),
        ("commentsCount: out of range", ~c("commentsCount").between(0, 100_000_000)),
        ("ageHours: out of range", ~c("ageHours").between(0, 1_000_000) | F.isnan("ageHours")),
        ("subredditSubscribers: out of range", ~c("subredditSubscribers").between(0, 1_000_000_000)),
        ("links: too many or too long", (F.size("links") > MAX_LINKS) | F.exists("links", lambda u: n(u) > 2_000)),
        ("outboundDomains: too many or too long", (F.size("outboundDomains") > MAX_LINKS) | F.exists("outboundDomains", lambda u: n(u) > 253)),
        ("visibleComments: too many", F.size("visibleComments") > MAX_COMMENTS),
        ("visibleComments: text missing or too long", F.exists("visibleComments", lambda x: x["text"].isNull() | (n(x["text"]) > MAX_COMMENT) | (n(x["author"]) > 100) | ~x["depth"].between(0, 50))),
        ("authorHistory: too many items", (F.size("authorHistory.submissions") > 100) | (F.size("authorHistory.comments") > 100)),
        ("authorHistory: author, time or availability missing", c("authorHistory").isNotNull() & (c("authorHistory.author").isNull() | c("authorHistory.fetchedAt").isNull() | c("authorHistory.available").isNull())),
    ]
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for text, bad in checks])
    return conform(df).withColumn("problems", F.slice(F.filter(found, lambda x: x.isNotNull()), 1, 10))


def valid(df: DataFrame) -> DataFrame:
    return with_problems(df).where(F.size("problems") == 0).drop("problems")


def rejected(df: DataFrame) -> DataFrame:
    return with_problems(df).where(F.size("problems") > 0)
