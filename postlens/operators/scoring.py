"""From signals to the four displayed concepts, inside the post's row.

A post has some dozens of signals at most, so discounts, caps, flags and ranking are array
expressions; a table of posts is scored without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as P
from ..functions import text as X
from .catalog import SIGNAL, once
from .detectors import detect

_VERIFY = [r[0] for r in P.CRITERIA if r[8]]


def effective(signals: Column) -> Column:
    """The signals that count for promotion, as (s, w): weights after both discounts."""
    counted = F.filter(signals, lambda s: F.array_contains(s["affects"], "promotion") & (s["weight"] != 0))
    first = F.transform(counted, lambda s, i: F.struct(s.alias("s"), F.when(s["id"].isin(_VERIFY) & ~F.coalesce(s["verified"], F.lit(False)), s["weight"] * P.UNVERIFIED_DISCOUNT).otherwise(s["weight"]).alias("w"), i.alias("i")))

    def discounted(x: Column, all_: Column) -> Column:
        stronger = lambda y: (y["s"]["correlationGroup"] == x["s"]["correlationGroup"]) & ((F.abs(y["w"]) > F.abs(x["w"])) | ((F.abs(y["w"]) == F.abs(x["w"])) & (y["i"] < x["i"])))
        return F.when(F.exists(all_, lambda y: F.coalesce(stronger(y), F.lit(False))), x["w"] * P.CORRELATION_DISCOUNT).otherwise(x["w"])

    return F.transform(F.array(first), lambda all_: F.transform(all_, lambda x: F.struct(x["s"].alias("s"), discounted(x, all_).alias("w"))))[0]


def category_points(weighted: Column) -> Column:
    """Capped points by category, a map that holds the categories that occur."""
    names = F.array_distinct(F.transform(weighted, lambda x: x["s"]["category"]))
    caps = F.create_map(*[x for k, v in P.CATEGORY_CAPS.items() for x in (F.lit(k), F.lit(float(v)))])

    def capped(c: Column) -> Column:
        total = F.aggregate(F.filter(weighted, lambda x: x["s"]["category"] == c), F.lit(0.0), lambda a, x: a + x["w"])
        cap = F.try_element_at(caps, c)
        return F.when(cap.isNull(), total).when(cap >= 0, F.least(total, cap)).otherwise(F.greatest(total, cap))

    return F.map_from_arrays(names, F.transform(names, capped))


def clamp(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.floor(x + 0.5)))).cast("int")


def _any(signals: Column, ids: list[str]) -> Column:
    return F.exists(signals, lambda s: s["id"].isin(ids))


def promotion(points: Column, signals: Column) -> Column:
    """(score, capped): the score of capped points, and whether the style-only cap held it."""
    entries = F.map_entries(points)
    add = lambda keep: F.aggregate(F.filter(entries, keep), F.lit(0.0), lambda a, e: a + e["value"])
    behaves = lambda e: e["key"].isin(P.BEHAVIORAL)
    behavioral, style, negative = add(lambda e: (e["value"] >= 0) & behaves(e)), add(lambda e: (e["value"] >= 0) & ~behaves(e)), add(lambda e: e["value"] < 0)
    capped = (behavioral < 8) & (style > P.STYLE_ONLY_CAP)
    plain = clamp(F.when(capped, behavioral + P.STYLE_ONLY_CAP).otherwise(behavioral + style) + negative)
    confirmed = _any(signals, P.SELF_CONNECTION) & _any(signals, P.ASK)
    return F.struct(F.when(confirmed, F.greatest(plain, F.lit(P.CONFIRMED_FLOOR))).otherwise(plain).cast("int").alias("score"), capped.alias("capped"))


def disclosure_status(signals: Column, score: Column) -> Column:
    buried = F.exists(signals, lambda s: s["id"] == "disclosure.buried")
    commercial = F.exists(signals, lambda s: F.array_contains(s["affects"], "promotion") & (s["weight"] >= 8) & s["category"].isin(P.COMMERCIAL))
    return (
        F.when(_any(signals, P.CLEAR), F.when(buried, "unclear").otherwise("clear"))
        .when(_any(signals, P.UNCLEAR), "unclear")
        .when((commercial & (score >= 20)) | (score >= 40), "missing")
        .otherwise("unknown")
    )


def undisclosed_risk(score: Column, disclosure: Column) -> Column:
    return F.when(disclosure == "clear", "low").when(score >= 60, "high").when(score >= 40, "medium").otherwise("low")


def confidence(signals: Column, weighted: Column, detail: Column) -> Column:
    unverified = lambda s: s["id"].isin(_VERIFY) & ~F.coalesce(s["verified"], F.lit(False))
    worth = lambda s: F.when(unverified(s), 0.25).when(s["strength"] == "very-strong", 3.0).when(s["strength"] == "strong", 2.0).when(s["strength"].isin("medium", "counter"), 1.0).when(s["strength"] == "weak", 0.25).otherwise(0.0)
    sources = F.size(F.array_distinct(F.transform(weighted, lambda x: x["s"]["evidenceSource"])))
    points = F.aggregate(weighted, F.lit(0.0), lambda a, x: a + worth(x["s"])) + F.greatest(F.lit(0), sources - 1) * 0.5
    sure = F.exists(weighted, lambda x: (x["s"]["strength"] == "very-strong") & ~unverified(x["s"]))
    level = F.when(points < 2.5, 0).when(points < 6, 1).when(~F.coalesce(detail, F.lit(False)) & ~sure, 1).otherwise(2)
    copied = F.exists(signals, lambda s: s["id"] == "community.coordinated-accusations")
    level = F.when(copied, F.when(level == 2, 1).otherwise(0)).otherwise(level)
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), level + 1)


def reach() -> Column:
    """(level, explanation) from upvotes, commentsCount, ageHours and subredditSubscribers."""
    up, count, age, members = F.col("upvotes"), F.col("commentsCount"), F.col("ageHours"), F.col("subredditSubscribers")
    votes, comments = F.coalesce(up, F.lit(0)), F.coalesce(count, F.lit(0))
    hourly = F.when(age > 0, votes / age)
    large = F.coalesce(members >= 1000, F.lit(False))
    per = lambda n: n / F.when(large, members).otherwise(1) * 1000
    fast = lambda n: F.coalesce(hourly >= n, F.lit(False))
    high = F.when(large, ((per(votes) >= 2) & (votes >= 50)) | ((per(comments) >= 0.5) & (comments >= 30)) | (votes >= 5000)).otherwise((votes >= 1000) | fast(150) | (comments >= 300))
    medium = F.when(large, ((per(votes) >= 0.4) & (votes >= 15)) | ((per(comments) >= 0.1) & (comments >= 10)) | (votes >= 500)).otherwise((votes >= 100) | fast(25) | (comments >= 50))
    hidden = up.isNull() & count.isNull()
    half = X.round_half_up
    days = half(age / 24)
    old = F.when(age < 1, "less-than-an-hour-old").when(age < 48, F.concat(half(age).cast("string"), F.lit("-hour-old"))).when(days < 60, F.concat(days.cast("string"), F.lit("-day-old"))).otherwise(F.concat(half(days / 30).cast("string"), F.lit("-month-old")))
    millions = F.when(members >= 10_000_000, F.format_string("%.0fM", members / 1_000_000.0)).otherwise(F.format_string("%.1fM", members / 1_000_000.0))
    crowd = F.when(members >= 1_000_000, millions).otherwise(F.concat(half(members / 1000).cast("string"), F.lit("k")))
    text = F.concat(
        F.concat_ws(" and ", F.concat(F.format_number(up, 0), F.lit(" upvotes")), F.concat(F.format_number(count, 0), F.lit(" comments"))),
        F.when(age.isNotNull(), F.concat(F.lit(" on a "), old, F.lit(" post"))).otherwise(""),
        F.when(large, F.concat(F.lit(" in a "), crowd, F.lit("-member community"))).otherwise(""),
        F.lit(" (approximate; reach is not evidence of promotion)"),
    )
    level = F.when(hidden, "low").when(high, "high").when(medium, "medium").otherwise("low")
    return F.struct(level.alias("level"), F.when(hidden, "Vote and comment counts were not visible").otherwise(text).alias("explanation"))


def reasons(weighted: Column, signals: Column, disclosure: Column, score: Column) -> Column:
    """Up to three reasons: the strongest signals, then what was not disclosed or not seen."""
    ranked = F.filter(weighted, lambda x: F.abs(x["w"]) >= 2)
    keyed = F.transform(ranked, lambda x, i: F.struct(F.when((score < 40) & (x["w"] < 0), 0).otherwise(F.when(score < 40, 1).otherwise(0)).alias("side"), (-F.abs(x["w"])).alias("low"), i.alias("i"), x["s"]["explanation"].alias("text")))
    top = F.slice(F.array_distinct(F.transform(F.array_sort(keyed), lambda x: x["text"])), 1, 3)
    silent = (disclosure == "missing") & (score >= 40) & ~F.exists(top, lambda r: r.rlike("(?i)disclos"))
    note = F.when(silent, F.array(F.lit("No author-product connection is disclosed"))).otherwise(F.array().cast("array<string>"))
    unseen = F.filter(
        F.transform(signals, lambda s: F.when(s["id"] == "availability.profile-history-unavailable", "Limited evidence: author history was not available").when(s["id"] == "availability.comments-unavailable", "Limited evidence: comments were not visible")),
        lambda r: r.isNotNull(),
    )
    return F.slice(F.concat(top, note, unseen), 1, 3)


def score_signals(df: DataFrame, source: str = "local") -> DataFrame:
    """df (a post's columns and signals) with the result's columns, and points by category."""
    df = once(df, {"_weighted": effective(F.col("signals"))})
    df = once(df, {"categoryPoints": category_points(F.col("_weighted"))})
    df = once(df, {"_promotion": promotion(F.col("categoryPoints"), F.col("signals"))})
    df = df.withColumns({"promoLikelihood": F.col("_promotion.score"), "styleOnlyCapApplied": F.col("_promotion.capped")})
    df = once(df, {"disclosure": disclosure_status(F.col("signals"), F.col("promoLikelihood"))})
    df = df.withColumns(
        {
            "label": X.score_label(F.col("promoLikelihood")),
            "undisclosedRisk": undisclosed_risk(F.col("promoLikelihood"), F.col("disclosure")),
            "confidence": confidence(F.col("signals"), F.col("_weighted"), F.col("isDetailPage")),
            "reach": reach(),
            "reasons": reasons(F.col("_weighted"), F.col("signals"), F.col("disclosure"), F.col("promoLikelihood")),
            "analysisVersion": F.lit(P.VERSION),
            "source": F.lit(source),
        }
    )
    return df.drop("_weighted", "_promotion")


def analyze(posts: DataFrame, as_of: Column | None = None, source: str = "local") -> DataFrame:
    """Detects and scores a table of posts: one result row for each."""
    df = score_signals(detect(posts, as_of), source)
    return df.drop(*[c for c in df.columns if c.startswith("_") and c not in posts.columns])


EMPTY = f"array<{SIGNAL}>"
