"""Posts, comments and histories from the JSON listings of a discussion site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Depths of a comment tree that are read, comments kept, items asked for, characters of an excerpt.
DEPTHS, COMMENTS, LIMIT, EXCERPT = 3, 80, 40, 300


def permalink_path(url: Column) -> Column:
    """/r/<sub>/comments/<id> or /user/<name>/comments/<id> of an address; null otherwise."""
    path = F.regexp_extract(url, r"(?i)(?:\A(?:https?://(?:[a-z0-9-]+\.)?reddit\.com)?)(/(?:r|user|u)/[\w-]+/comments/[a-z0-9]+)", 1)
    return F.when(path != "", path)


def data_api_url(url: Column) -> Column:
    """The same resource at the data API's host, without the .json ending."""
    return F.regexp_replace(F.regexp_replace(url, r"(?i)\Ahttps?://(?:www\.|old\.|new\.)?reddit\.com", "https://oauth.reddit.com"), r"\.json(?=\?|\z)", "")


def status_reason(status: Column) -> Column:
    """Why a fetch gave nothing; null if it gave something."""
    return F.when(status.isNull(), "fetch_failed").when(status == 429, "rate_limited").when(status == 403, "forbidden").when(status == 404, "not_found").when(~status.between(200, 299), F.concat(F.lit("http_"), status.cast("string")))


def read_bodies(raw: DataFrame, most: int = 262_144, body: str = "body", declared: str | None = None) -> DataFrame:
    """raw with ok, status and json (a variant): 413 for bodies over most bytes, said or sent, 400 for what is no JSON."""
    size = F.octet_length(body)
    large = size > most if declared is None else (size > most) | (F.coalesce(declared, F.lit(0)) > most)
    v = F.try_parse_json(F.when(~F.coalesce(large, F.lit(False)), F.col(body)))
    status = F.when(F.coalesce(large, F.lit(False)), 413).when(v.isNull(), 400).otherwise(200)
    return raw.withColumns({"status": status, "ok": status == 200, "json": v})


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def read_posts(raw: DataFrame, as_of: Column, body: str = "body", status: str = "status") -> DataFrame:
    """raw (a JSON text and an HTTP status) with ok, reason and post, a struct of a post's fields."""
    v = F.try_parse_json(body)
    df = raw.withColumn("_v", v).withColumn("_p", F.try_variant_get(F.col("_v"), "$[0].data.children[0].data", "variant"))
    p = F.col("_p")
    title = _text(p, "$.title")
    reason = F.coalesce(status_reason(F.col(status)), F.when(title.isNull() | (X.trim_all(title) == ""), "malformed"))
    created = F.try_variant_get(p, "$.created_utc", "double")
    url = _text(p, "$.url")
    outside = ~F.coalesce(F.try_variant_get(p, "$.is_self", "boolean"), F.lit(False)) & url.isNotNull()
    own = F.when(outside & ~F.coalesce(X.host_of(url).rlike(r"(?:\A|\.)(?:reddit\.com|redd\.it)\z"), F.lit(False)), F.array(url)).otherwise(F.array().cast("array<string>"))
    text = F.coalesce(_text(p, "$.selftext"), F.lit(""))
    post = F.struct(
        _text(p, "$.name").alias("id"), F.concat(F.lit("https://www.reddit.com"), _text(p, "$.permalink")).alias("url"), title.alias("title"), text.alias("body"), _text(p, "$.author").alias("author"), _text(p, "$.subreddit").alias("subreddit"),
        F.try_variant_get(p, "$.score", "bigint").alias("upvotes"), F.try_variant_get(p, "$.num_comments", "bigint").alias("commentsCount"), F.greatest(F.lit(0.0), (as_of - created) / 3600).alias("ageHours"),
        F.try_variant_get(p, "$.subreddit_subscribers", "bigint").alias("subredditSubscribers"), F.array_distinct(F.concat(own, X.extract_urls(text))).alias("links"), flatten_comments(F.col("_v"), _text(p, "$.author")).alias("visibleComments"), F.lit(True).alias("isDetailPage"),
    )
    return df.withColumns({"ok": reason.isNull(), "reason": reason, "post": F.when(reason.isNull(), post)}).drop("_v", "_p")


def flatten_comments(v: Column, author: Column, depths: int = DEPTHS, most: int = COMMENTS) -> Column:
    """The comments of a listing in reading order: a parent, its replies, then the next."""

    def level(children: Column, depth: int) -> Column:
        list_ = F.coalesce(F.try_variant_get(children, "$", "array<variant>"), F.array().cast("array<variant>"))
        real = F.filter(list_, lambda c: _text(c, "$.kind") == "t1")

        def one(c: Column) -> Column:
            text, who = _text(c, "$.data.body"), _text(c, "$.data.author")
            shown = text.isNotNull() & ~text.isin("[deleted]", "[removed]", "")
            me = F.struct(who.alias("author"), F.left(text, F.lit(4000)).alias("text"), F.coalesce(F.try_variant_get(c, "$.data.is_submitter", "boolean"), F.lower(who) == F.lower(author), F.lit(False)).alias("isOp"), F.lit(depth).alias("depth"))
            own = F.filter(F.array(me), lambda x: F.coalesce(shown, F.lit(False)))
            return own if depth + 1 >= depths else F.concat(own, level(F.try_variant_get(c, "$.data.replies.data.children", "variant"), depth + 1))

        return F.flatten(F.transform(real, one))

    return F.slice(level(F.try_variant_get(v, "$[1].data.children", "variant"), 0), 1, most)


def read_histories(raw: DataFrame, as_of: Column) -> DataFrame:
    """raw (author, about, submitted, comments as JSON texts, and their statuses) with authorHistory."""
    about, subs, coms = (F.try_parse_json(c) for c in ("about", "submitted", "comments"))
    items = lambda v: F.coalesce(F.try_variant_get(v, "$.data.children", "array<variant>"), F.array().cast("array<variant>"))
    worst = F.greatest(F.coalesce("about_status", F.lit(0)), F.coalesce("submitted_status", F.lit(0)), F.coalesce("comments_status", F.lit(0)))
    reason = F.when(F.coalesce("author", F.lit("")).isin("", "[deleted]"), "no_author").when(worst == 0, "fetch_failed").when(worst == 429, "rate_limited").when(F.col("about_status") == 404, "not_found").when(worst == 403, "private_or_suspended").when(worst >= 300, F.concat(F.lit("http_"), worst.cast("string")))
    cut = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(EXCERPT))
    sub = lambda c: F.struct(_text(c, "$.data.name").alias("id"), _text(c, "$.data.subreddit").alias("subreddit"), F.left(_text(c, "$.data.title"), F.lit(300)).alias("title"), _text(c, "$.data.domain").alias("domain"), _text(c, "$.data.url").alias("url"), cut(_text(c, "$.data.selftext")).alias("excerpt"), F.try_variant_get(c, "$.data.created_utc", "double").cast("bigint").alias("createdUtc"), _text(c, "$.data.permalink").alias("permalink"))
    com = lambda c: F.struct(_text(c, "$.data.subreddit").alias("subreddit"), cut(_text(c, "$.data.body")).alias("excerpt"), F.try_variant_get(c, "$.data.created_utc", "double").cast("bigint").alias("createdUtc"), F.slice(F.array_distinct(F.filter(F.transform(X.extract_urls(F.coalesce(_text(c, "$.data.body"), F.lit(""))), X.host_of), lambda h: h.isNotNull())), 1, 20).alias("linkDomains"), _text(c, "$.data.link_title").alias("postTitle"))
    submissions, comments = F.slice(F.transform(items(subs), sub), 1, 100), F.slice(F.transform(items(coms), com), 1, 100)
    born = F.try_variant_get(about, "$.data.created_utc", "double")
    good = reason.isNull()
    history = F.struct(
        F.col("author").alias("author"), (as_of * 1000).cast("bigint").alias("fetchedAt"), good.alias("available"), reason.alias("reason"), F.when(good, (as_of - born) / 86400).alias("accountAgeDays"),
        F.when(good, F.try_variant_get(about, "$.data.link_karma", "bigint")).alias("linkKarma"), F.when(good, F.try_variant_get(about, "$.data.comment_karma", "bigint")).alias("commentKarma"),
        F.when(good, (F.size(submissions) >= LIMIT) | (F.size(comments) >= LIMIT)).alias("truncated"), F.when(good, submissions).otherwise(F.slice(submissions, 1, 0)).alias("submissions"), F.when(good, comments).otherwise(F.slice(comments, 1, 0)).alias("comments"),
    )
    return raw.withColumn("authorHistory", history)


def with_history(posts: DataFrame, histories: DataFrame) -> DataFrame:
    """posts with the authorHistory of their author (compared without case), null where there is none."""
    known = histories.select(F.lower("author").alias("_author"), "authorHistory").groupBy("_author").agg(F.max_by("authorHistory", F.col("authorHistory.fetchedAt")).alias("authorHistory"))
    return posts.drop("authorHistory").withColumn("_author", F.lower("author")).join(known, "_author", "left").drop("_author")
