"""The verdict: promotion and openness in one line, and the technique in another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

# Framings in order of priority: signals (any of each group), wording, wording if disclosed.
FRAMINGS = [
    ([["workflow.only-product-linked", "workflow.obscure-among-familiar", "workflow.more-detail", "workflow.success-attributed"]], "Presented as a workflow in which one obscure tool gets the link and the credit", "Presented as a workflow built around the author's own tool"),
    ([["story.advice-then-product"]], "Presented as neutral advice that ends by directing readers to a product", "Presented as advice that ends at the author's own product"),
    ([["story.problem-product-success", "story.emotional-intro", "story.result-title-tool-body", "story.solves-everything"]], "Presented as a personal story that ends at a product", "Told as the founder's own story, ending at their product"),
    ([["cta.dm-request", "cta.comment-interested"]], "Access is withheld behind a DM or a keyword comment", None),
    ([["story.testimonial", "lang.hype-phrases", "lang.transformation"], ["link.product-link", "link.affiliate-params", "cta.coupon"]], "Presented as a user's review or recommendation", "The founder's own account of the product, with a link"),
    ([["lang.sales-page-format", "lang.feature-focus"]], "Reads like a product page: features listed, little discussion", None),
    ([["cta.direct", "cta.coupon", "cta.signup-benefit", "cta.waitlist"]], "Asks readers directly to buy, sign up, or use a code", None),
]
ELSEWHERE = "Elsewhere the author describes this as their own product; this post does not say so"
RECURS = "the same product recurs in the author's other recent posts"
RECURRING = ["history.cross-subreddit", "account.repeats-domain", "history.repeated-text", "account.single-product-history"]
LATE = "The author's connection to the linked product is stated only partway through a long post, where a skimming reader will miss it"


def verdict(score: Column, disclosure: Column, ids: Column) -> Column:
    """(kind, headline, technique, hiddenConnection) of a result; ids: array of its signals' ids."""
    has = lambda x: F.arrays_overlap(ids, F.array(*map(F.lit, x)))
    one = lambda x: F.array_contains(ids, x)
    clear = disclosure == "clear"
    hidden = one("account.self-identified-elsewhere") & ~clear
    framing = F.lit(None).cast("string")
    for groups, plain, disclosed in reversed(FRAMINGS):
        here = has(groups[0])
        for g in groups[1:]:
            here = here & has(g)
        framing = F.when(here, F.when(clear, disclosed or plain).otherwise(plain)).otherwise(framing)
    recurs = F.when(has(RECURRING), F.lit(RECURS))
    rest = F.concat_ws("; ", framing, recurs)
    technique = F.when(hidden, F.when(rest == "", F.lit(ELSEWHERE + ".")).otherwise(F.concat(F.lit(ELSEWHERE + ". "), rest, F.lit(".")))).when(rest != "", F.concat(rest, F.lit(".")))
    late = F.when(technique.isNull(), LATE + ".").otherwise(F.concat(F.lit(LATE + ". "), technique))
    organic = (score < 40) & ~hidden
    buried, only_comments = one("disclosure.buried"), one("disclosure.comments-only")
    unclear = disclosure == "unclear"
    kind = F.when(organic, "organic").when(clear, "transparent").when(unclear, "unclear").otherwise("undisclosed")
    headline = (
        F.when(organic, F.when(score < 20, "Looks organic").otherwise("Mostly organic, a few promotional signals"))
        .when(clear, "Transparent promotion")
        .when(unclear, F.when(buried, "Promotion, disclosed late in the post").when(only_comments, "Promotion, disclosed only in the comments").otherwise("Promotion with an unclear connection"))
        .when(hidden | (score >= 60), "Possible undisclosed promotion")
        .otherwise("Possibly promotional, connection not disclosed")
    )
    shown = F.when(organic, F.lit(None)).when(unclear & buried & ~clear, late).otherwise(technique)
    return F.struct(kind.alias("kind"), headline.alias("headline"), shown.alias("technique"), (hidden & ~organic).alias("hiddenConnection"))


def of_result() -> Column:
    return verdict(F.col("promoLikelihood"), F.col("disclosure"), F.transform("signals", lambda s: s["id"]))


def summary(product: str) -> Column:
    """A result in a sentence, for a screen reader; product names what speaks."""
    v = of_result()
    technique = F.when(v["technique"].isNull(), "").otherwise(F.concat(v["technique"], F.lit(" ")))
    return F.concat(F.lit(product + ": "), v["headline"], F.lit(". "), technique, F.col("promoLikelihood").cast("string"), F.lit("% "), F.lower("label"), F.lit(". "), X.confidence_label(F.col("confidence")), F.lit(". "), X.disclosure_label(F.col("disclosure")), F.lit(". Press Enter for details."))


def source_note() -> Column:
    """Which evidence the result rests on."""
    return F.when((F.col("source") == "api") | F.exists("signals", lambda s: s["id"] == "api.llm-witness"), "rules and language model").otherwise("rules only")
