"""Results by content: the key of what an analysis depends on, and what is known already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .posts import COMMENT, conform


def content_key() -> Column:
    """The key of a post's columns; votes and age, which an analysis of content doesn't read, stay out."""
    h, none = F.col("authorHistory"), F.array().cast("array<string>")
    whole = lambda c: c.cast("string")
    history = F.when(h.isNull(), "h:none").otherwise(F.concat_ws(":", F.lit("h"), F.when(h["available"], "1").otherwise("0"), whole(h["fetchedAt"]), whole(F.size(h["submissions"])), whole(F.size(h["comments"]))))
    said = F.transform(F.coalesce("visibleComments", F.array().cast(f"array<{COMMENT}>")), lambda c: F.concat(F.coalesce(c["author"], F.lit("")), F.lit(":"), c["text"]))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    parts = [
        F.lit("v2"), history, text("id"), text("title"), text("body"), text("author"), text("subreddit"), F.array_join(F.coalesce("links", none), "|"), F.array_join(F.coalesce("outboundDomains", none), "|"),
        F.when(F.coalesce("isDetailPage", F.lit(False)), "detail").otherwise("feed"), F.array_join(said, ""),
    ]
    return X.fnv_hash(F.concat_ws(" ", *parts))


def with_key(posts: DataFrame) -> DataFrame:
    return conform(posts).withColumn("contentHash", content_key())


def known(posts: DataFrame, results: DataFrame) -> DataFrame:
    """The posts (with contentHash) whose result (contentHash, ...) is there, with it."""
    return posts.join(results, "contentHash")


def unknown(posts: DataFrame, results: DataFrame) -> DataFrame:
    """One post of each content that has no result yet: what there is to analyse."""
    return posts.join(results.select("contentHash"), "contentHash", "left_anti").dropDuplicates(["contentHash"])


def stored(cache: DataFrame, results: DataFrame, now: Column, ttl: int, most: int) -> DataFrame:
    """The cache (contentHash, stored_at in ms, result) after results are put in: the newest of a hash, fresh ones only, most of them."""
    from ..streaming.limits import fresh, within_capacity

    both = cache.unionByName(results)
    newest = both.groupBy("contentHash").agg(F.max_by(F.struct(*both.columns), "stored_at").alias("_r")).select("_r.*")
    return within_capacity(fresh(newest, now, ttl).withColumn("key", F.col("contentHash")), most).drop("key")
