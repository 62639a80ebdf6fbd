"""Cards of a feed: what a fetched page adds to them, the order they are analysed in, and why one failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .posts import FIELDS, conform


def with_fetched(cards: DataFrame, fetched: DataFrame, key: str = "id") -> DataFrame:
    """cards with what was fetched (key, ok, reason, post) for those that are no detail page.

    A fetched post stands for the card's, but for an id that it lacks and a label that only the card
    shows. ready is false where the site refuses for now; anything else that failed leaves the card.
    """
    cards = conform(cards)
    found = fetched.select(F.col(key).alias("_key"), F.col("ok").alias("_ok"), F.col("reason").alias("_reason"), F.col("post").alias("_post"))
    both = cards.join(found, F.col(key) == F.col("_key"), "left")
    open_ = ~F.coalesce("isDetailPage", F.lit(False))
    use = open_ & F.coalesce("_ok", F.lit(False))
    inner = set(found.schema["_post"].dataType.names)
    label = F.coalesce("brandAffiliateLabel", F.lit(False)) | (F.coalesce(F.col("_post.brandAffiliateLabel"), F.lit(False)) if "brandAffiliateLabel" in inner else F.lit(False))
    own = {c: F.when(use, F.col(f"_post.{c}") if c in inner else F.lit(None).cast(kind)).otherwise(F.col(c)) for c, kind in FIELDS.items()}
    own["id"] = F.when(use & (F.col("_post.id").isNotNull() if "id" in inner else F.lit(False)), F.col("_post.id") if "id" in inner else F.col("id")).otherwise(F.col("id"))
    own["brandAffiliateLabel"] = F.when(use, label).otherwise(F.col("brandAffiliateLabel"))
    ready = ~(open_ & F.coalesce(F.col("_reason") == "rate_limited", F.lit(False)) & ~F.coalesce("_ok", F.lit(False)))
    kept = [c for c in cards.columns if c not in FIELDS]
    return both.select(*kept, *[c.alias(name) for name, c in own.items()], ready.alias("ready"))


def queued(tasks: DataFrame, key: str = "key", at_a_time: int = 100) -> DataFrame:
    """tasks (key, priority, seq) with turn, the wave they run in: highest priority first, then in order.

    A key that waits already is not queued again. Waves are counted by priority, so no task orders all.
    """
    first = tasks.groupBy(key).agg(F.min_by(F.struct(*tasks.columns), "seq").alias("_t")).select("_t.*")
    from .history import numbered

    counts = first.groupBy("priority").agg(F.count("*").alias("_n"))
    higher = counts.alias("a").join(F.broadcast(counts.alias("b")), F.col("b.priority") > F.col("a.priority"), "left").groupBy(F.col("a.priority").alias("_p")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    placed = numbered(first, "priority", "seq").join(higher, F.col("priority") == F.col("_p"))
    return placed.withColumn("turn", F.floor((F.col("_before") + F.col("place")) / at_a_time).cast("long")).drop("_p", "_before", "place")


# How a failed analysis is explained.
FAILURES = {
    "api_disabled": "deeper analysis is switched off",
    "no_key": "no API key has been added yet",
    "quota_exceeded": "this month's included analyses are used up; upgrade to Plus or add your own key in the popup",
    "bad_key": "the provider rejected the API key",
    "timeout": "the API took too long to answer",
    "invalid_response": "the API returned an unexpected answer",
    "invalid_json": "the API returned an unexpected answer",
    "no_response": "the background worker did not answer",
    "unreachable": "the API is not running or not reachable",
    "network": "the API is not running or not reachable",
}


def describe_failure(reason: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in FAILURES.items() for x in kv])
    http = F.when(reason.rlike(r"\Ahttp_5"), "the API reported a server error").when(reason.rlike(r"\Ahttp_429"), "the API is rate limited").when(reason.rlike(r"\Ahttp_"), F.concat(F.lit("the API answered "), F.regexp_replace(reason, r"\Ahttp_", "http ")))
    return F.coalesce(F.try_element_at(known, reason), http, F.regexp_replace(reason, "_", " "))


def model_failure(message: Column) -> Column:
    """The short reason of a model call's error message."""
    status = F.regexp_extract(message, r"HTTP (\d{3})", 1)
    return (
        F.when(message.rlike("(?i)timed out"), "timeout")
        .when(message.rlike("401"), "bad_key")
        .when(message.rlike("429|insufficient_quota|rate_limit"), "http_429")
        .when(status != "", F.concat(F.lit("http_"), status))
        .when(message.rlike("JSON|shape"), "invalid_response")
        .otherwise("unreachable")
    )


def licence_check(body: Column, product: int) -> Column:
    """(valid, reason) of a licence provider's JSON answer; a null one counts as no answer."""
    v = F.try_parse_json(body)
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    other = F.coalesce(get("$.meta.product_id", "bigint") != product, F.lit(False))
    good = F.coalesce(get("$.valid", "boolean"), F.lit(False)) | F.coalesce(get("$.activated", "boolean"), F.lit(False))
    status, error = F.coalesce(get("$.license_key.status"), F.lit("")), F.lower(F.coalesce(get("$.error"), F.lit("")))
    refused = (
        F.when(error.rlike("not found|invalid"), "not_found")
        .when((status == "expired") | F.contains(error, F.lit("expired")), "expired")
        .when(status.isin("disabled", "inactive") | error.rlike("disabled|inactive"), "inactive")
        .when(F.contains(error, F.lit("activation limit")), "limit_reached")
        .otherwise("inactive")
    )
    lapsed = F.when(~status.isin("", "active"), F.when(status == "expired", "expired").otherwise("inactive"))
    reason = F.when(v.isNull(), "provider_error").when(other, "wrong_product").when(~good, refused).otherwise(lapsed)
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"))
