"""Evidence from a post's visible comments, in the post's own row; only detail pages have it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as P
from ..functions import text as X
from .catalog import once, signals, when
from .posts import COMMENT

SIMILAR, SHORT = 0.7, 200


def similar_pairs(texts: Column) -> Column:
    """How many pairs of an array of texts share most of their words."""
    words = F.transform(texts, X.ascii_words)
    earlier = F.transform(words, lambda w, i: F.size(F.filter(F.slice(words, F.lit(1), i), lambda v: X.overlap(w, v) >= SIMILAR)))
    return F.aggregate(earlier, F.lit(0), lambda a, n: a + n)


def _matching(comments: Column, pattern: str) -> Column:
    return F.filter(comments, lambda c: X.ascii_shadow(c["text"]).rlike(pattern))


def with_comment_facts(df: DataFrame) -> DataFrame:
    none = F.array().cast(f"array<{COMMENT}>")
    comments = F.when(F.coalesce("isDetailPage", F.lit(False)), F.filter(F.coalesce("visibleComments", none), lambda c: c["text"].isNotNull())).otherwise(none)
    author = F.lower(F.coalesce("author", F.lit("")))
    own = lambda c: F.coalesce(c["isOp"], F.lit(False)) | ((author != "") & (F.lower(F.coalesce(c["author"], F.lit(""))) == author))
    df = once(df, {"f_ops": F.filter(comments, own), "f_others": F.filter(comments, lambda c: ~own(c))})
    df = once(df, {"f_accusing": _matching(F.col("f_others"), P.ACCUSATION), "f_repeats": _matching(F.col("f_others"), P.REPEAT_MENTION)})
    op_text = X.ascii_shadow(X.spaces(F.array_join(F.transform("f_ops", lambda c: c["text"]), "\n")))
    named = F.array_distinct(F.filter(F.transform("f_accusing", lambda c: c["author"]), lambda a: a.isNotNull()))
    nameless = F.filter("f_accusing", lambda c: c["author"].isNull())
    praise = F.filter(_matching(F.col("f_others"), P.POSITIVE), lambda c: F.length(c["text"]) < SHORT)
    texts = lambda c: F.transform(c, lambda x: x["text"])
    return once(
        df,
        {
            "f_op_text": op_text,
            "f_accusers": F.size(named) + F.size(nameless),
            "f_copied": (F.size("f_accusing") >= 2) & (similar_pairs(texts(F.col("f_accusing"))) >= 1),
            "f_praise": similar_pairs(texts(praise)),
            "f_op_links": F.size(F.filter("f_ops", lambda c: F.exists(X.extract_urls(c["text"]), lambda u: F.array_contains(F.col("_hosts"), X.host_of(u))))),
        },
    )


def comment_signals() -> Column:
    f, op, ops = F.col, F.col("f_op_text"), F.size("f_ops")
    count, open_ = F.size("f_accusing"), ~F.col("f_copied")
    repeats = F.size("f_repeats")
    admits = op.rlike(P.CLEAR_CREATOR) | op.rlike(P.CLEAR_EMPLOYMENT) | op.rlike(P.CLEAR_AFFILIATE) | op.rlike(P.CLEAR_BENEFIT)
    to_product = F.exists("f_accusing", lambda c: F.exists(X.extract_urls(c["text"]), lambda u: ~F.endswith(X.host_of(u), F.lit("reddit.com")) & F.array_contains(F.col("_hosts"), X.host_of(u))))
    how_many = F.when(repeats == 1, "one comment").otherwise(F.concat(repeats.cast("string"), F.lit(" comments")))
    first_repeat = F.left(X.normalize_whitespace(F.try_element_at("f_repeats", F.lit(1))["text"]), F.lit(80))
    pushes = op.rlike(P.DM) | op.rlike(P.CTA) | (f("f_op_links") > 0)
    return signals(
        when(f("f_copied"), "community.coordinated-accusations"),
        when(open_ & (f("f_accusers") >= 2), "community.several-independent-concerns", explanation=F.concat(f("f_accusers").cast("string"), F.lit(" different commenters raise concerns that the post may be promotional (unverified)"))),
        when(open_ & (f("f_accusers") < 2) & (count == 1), "community.single-accusation"),
        when(open_ & (repeats > 0), "community.repeated-posts-identified", verified=False, excerpt=first_repeat, explanation=F.concat(F.lit("A commenter says the author has posted this before ("), how_many, F.lit(", not verified)"))),
        when(open_ & F.exists("f_accusing", lambda c: c["text"].rlike(P.REDDIT_LINK)), "community.linked-identical-post", verified=False),
        when(open_ & to_product, "community.author-product-evidence", verified=False),
        when((ops > 0) & admits, "community.author-admission"),
        when((ops > 0) & op.rlike(P.DM), "behavior.dm-for-link"),
        when((ops > 0) & op.rlike(P.COMMENT_INTERESTED), "behavior.comment-interested-dm"),
        when((ops > 0) & (X.count_matches(op, P.PRIVATE_GROUP) >= 2), "behavior.private-group"),
        when(f("f_op_links") >= 3, "behavior.same-product-replies", explanation=F.concat(F.lit("The author replies with the product link in "), f("f_op_links").cast("string"), F.lit(" comments"))),
        when((ops >= 3) & ~pushes, "counter.answers-without-push"),
        when(f("f_praise") >= 2, "coord.similar-wording"),
        when(F.coalesce("isDetailPage", F.lit(False)) & f("f_removed"), "community.mod-removed"),
    )
