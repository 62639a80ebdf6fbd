"""Detectors that read the post itself: columns of facts first, then the signals they give.

A post is one row and its signals one array, so detection never shuffles. Facts that several
signals share are columns of their own, so that each pattern runs once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as P
from ..functions import text as X
from ..functions.gate import hit
from .catalog import once, signals, when
from .comments import comment_signals, with_comment_facts
from .context import with_context
from .history import history_signals, with_history_facts

STRONG_CODE = r"(?i)\b(?:promo ?code|discount code|use code|referral code)\b"
BENEFIT_TAG = r"[?&]tag="


def _has(name: str) -> Column:
    return F.size(name) > 0


def with_facts(ctx: DataFrame) -> DataFrame:
    """The context with a column for each fact that patterns find."""
    x, b, t, lx, lb = (F.col(c) for c in ("_sx", "_sb", "_st", "_lx", "_lb"))
    on_text = {
        "cta": P.CTA, "coupon": P.COUPON, "code": P.CODE_TOKEN, "strong_code": STRONG_CODE, "signup": P.SIGNUP_BENEFIT, "waitlist": P.WAITLIST, "interested": P.COMMENT_INTERESTED,
        "dm": P.DM, "dm_for": P.DM_FOR, "feedback": P.FEEDBACK, "testimonial": P.TESTIMONIAL, "dramatic": P.DRAMATIC, "hype": P.HYPE, "transform": P.TRANSFORM, "slogan": P.SLOGAN,
        "performance": P.PERFORMANCE, "named": P.CREATOR_NAMED, "relative": P.CREATOR_RELATIVE, "creator": P.CLEAR_CREATOR, "employment": P.CLEAR_EMPLOYMENT, "benefit": P.CLEAR_BENEFIT,
        "affiliate": P.CLEAR_AFFILIATE, "working_on": P.UNCLEAR_WORKING_ON, "involved": P.UNCLEAR_INVOLVED, "friends": P.FRIENDS_PRODUCT, "discourage": P.DISCOURAGE,
    }
    facts = {f"f_{k}": hit(x, p, lx) for k, p in on_text.items()}
    facts |= {
        "f_pricing": hit(b, P.PRICING, lb), "f_solves": hit(b, P.SOLVES_ALL, lb), "f_advice": t.rlike(P.ADVICE_TITLE), "f_result": t.rlike(P.RESULT_TITLE), "f_search": t.rlike(P.SEARCH_TITLE),
        "f_cta_body": b.rlike(P.CTA), "f_steps": X.count_matches(b, P.STEP), "f_problems": X.count_matches(b, P.PROBLEM), "f_limits": X.count_matches(x, P.LIMITATION),
        "f_features": X.count_matches(b, P.FEATURE), "f_bullets": X.count_matches(b, P.BULLET), "f_removed": b.rlike(r"(?i)\[removed\]|removed by (?:the )?moderators?") & b.rlike(r"(?i)self[- ]?promo|spam|advertis"),
    }
    name = F.col("_primary.name")
    in_sentence = F.when(name.isNotNull(), F.filter("_sentences", lambda s: X.mentions(s, name))).otherwise(F.array().cast("array<string>"))
    facts["f_own"] = in_sentence
    named = F.when(name.isNotNull(), X.position(b, F.concat(F.lit(r"(?i)\b"), X.literal(name), F.lit(r"\b")))).otherwise(F.lit(-1.0))
    size = F.greatest(F.lit(1), F.length("_body"))
    places = F.filter(F.transform("_product", lambda u: F.instr(F.col("_body"), u)), lambda i: i > 0)
    link = F.when(F.size(places) > 0, (F.array_min(places) - 1) / size).otherwise(F.lit(-1.0))
    facts["f_at"] = F.when(named >= 0, named).otherwise(link)
    hosts = F.col("_link_hosts")
    facts["f_repeated"] = F.try_element_at(F.filter(hosts, lambda h: F.size(F.filter(hosts, lambda g: g == h)) >= 2), F.lit(1))
    facts["f_tracked"] = F.try_element_at(F.filter("_product", lambda u: u.rlike(P.AFFILIATE_PARAM) | u.rlike(P.AFFILIATE_PATH) | (F.endswith(X.host_of(u), F.lit("amazon.com")) & u.rlike(BENEFIT_TAG))), F.lit(1))
    redirects = "(?:" + "|".join(h.replace(".", r"\.") for h in P.REDIRECT_HOSTS) + ")"
    facts["f_redirect"] = F.try_element_at(F.filter(hosts, lambda h: h.rlike(rf"(?:\A|\.){redirects}\z")), F.lit(1))
    df = once(ctx, facts)
    has_product = (F.col("f_at") >= 0) | _has("_product")
    return df.withColumns({"f_has_product": has_product, "f_offer": has_product | F.col("f_dm") | F.col("f_interested") | F.col("f_cta")})


def _excerpt(pattern: str, text: str = "_text", shadow: str = "_sx") -> Column:
    return X.first_match(F.col(text), F.col(shadow), pattern)


def direct() -> Column:
    f = F.col
    strong = f("f_strong_code")
    times = F.size(F.filter("_link_hosts", lambda g: g == f("f_repeated")))
    return signals(
        when(f("f_cta"), "cta.direct", excerpt=_excerpt(P.CTA)),
        when(f("f_coupon") | f("f_code"), "cta.coupon", F.when(strong, 25.0).otherwise(20.0), F.when(strong, "The post includes a discount, promo or referral code").otherwise("The post includes a discount or time-limited offer"), _excerpt(P.COUPON)),
        when(f("f_signup"), "cta.signup-benefit", excerpt=_excerpt(P.SIGNUP_BENEFIT)),
        when(f("f_waitlist"), "cta.waitlist", excerpt=_excerpt(P.WAITLIST)),
        when(f("f_interested"), "cta.comment-interested", excerpt=_excerpt(P.COMMENT_INTERESTED)),
        when(f("f_dm"), "cta.dm-request", F.when(f("f_dm_for"), 20.0).otherwise(15.0), F.when(f("f_dm_for"), "Readers are asked to send a private message to get the link, template or details").otherwise("Readers are asked to send a private message"), _excerpt(P.DM)),
        when(f("f_feedback") & _has("_product") & f("f_cta"), "cta.feedback-redirect"),
        when(f("f_repeated").isNotNull(), "cta.repeated-links", explanation=F.concat(F.lit("The post links to "), f("f_repeated"), F.lit(" "), times.cast("string"), F.lit(" times"))),
    )


def links() -> Column:
    f = F.col
    tools = F.size("_familiar") + F.when(f("_primary").isNotNull(), 1).otherwise(0)
    only = (tools >= 3) & (F.size("_hosts") == 1) & (F.lower(X.first_label(F.try_element_at("_hosts", F.lit(1)))) == F.lower("_primary.name"))
    return signals(
        when(f("f_tracked").isNotNull(), "link.affiliate-params", explanation=F.concat(F.lit("A link to "), X.host_of(f("f_tracked")), F.lit(" carries affiliate or referral tracking parameters"))),
        when(f("f_redirect").isNotNull(), "link.redirect-tracking", explanation=F.concat(F.lit("A link goes through a redirect or tracking domain ("), f("f_redirect"), F.lit(")"))),
        when(_has("_hosts"), "link.product-link", explanation=F.concat(F.lit("The post contains a direct link to "), F.try_element_at("_hosts", F.lit(1)))),
        when(only, "workflow.only-product-linked", explanation=F.concat(F.lit("Several tools are mentioned but only "), f("_primary.name"), F.lit(" receives a link"))),
    )


def workflow() -> Column:
    f, name = F.col, F.col("_primary.name")
    steps, familiar, own = f("f_steps") >= 2, F.size("_familiar") >= 1, F.size("f_own")
    most = F.coalesce(F.array_max(F.transform("_familiar", lambda t: F.size(F.filter("_sentences", lambda s: X.mentions(s, t))))), F.lit(0))
    there = f("_primary").isNotNull()
    return signals(
        when(there & steps & familiar, "workflow.obscure-among-familiar", explanation=F.concat(name, F.lit(" is presented alongside well-known tools ("), F.array_join(F.slice("_familiar", 1, 3), ", "), F.lit(")"))),
        when(there & steps & F.exists("f_own", lambda s: s.rlike(P.NECESSARY)), "workflow.necessary-step", explanation=F.concat(name, F.lit(" is described as a necessary step"))),
        when(there & F.exists("f_own", lambda s: s.rlike(P.ATTRIBUTION)), "workflow.success-attributed", explanation=F.concat(F.lit("The successful outcome is attributed to "), name)),
        when(there & familiar & (own >= 3) & (own >= F.greatest(F.lit(3), most * 2)), "workflow.more-detail", explanation=F.concat(name, F.lit(" gets far more explanation than the supporting tools"))),
    )


def narrative() -> Column:
    f, b = F.col, F.col("_sb")
    size, words = F.length("_sb"), F.col("_words")
    told = f("f_offer") & (words >= 40)
    problem, emotional = X.position(b, P.PROBLEM), X.position(b, P.EMOTIONAL)
    start = F.when(problem < 0, emotional).when(emotional < 0, problem).otherwise(F.least(problem, emotional))
    middle = F.greatest(X.position(b, P.DISCOVERY), F.col("f_at"))
    end = F.greatest(X.last_position(b, P.SUCCESS), X.position(b, P.RESOLUTION))
    head = F.left(b, F.floor(size * 0.35).cast("int"))
    cut = F.floor(size * 0.7).cast("int") + 1
    tail = F.substr(b, cut)
    asks = F.arrays_overlap(X.extract_urls(F.substr(f("_body"), cut)), "_product") | tail.rlike(P.CTA) | tail.rlike(P.DM)
    mentions = f("_primary.mentions")
    often = (mentions >= 4) & (mentions >= F.floor(words / 60) + 2)
    times = F.concat("_primary.name", F.lit(" is named "), mentions.cast("string"), F.lit(" times"))
    return signals(
        when(told & (start >= 0) & (middle > start) & (end > start), "story.problem-product-success"),
        when(told & (f("f_at") > 0.3) & head.rlike(P.EMOTIONAL), "story.emotional-intro"),
        when(f("f_advice") & (words >= 80) & asks, "story.advice-then-product"),
        when(f("f_result") & (_has("_product") | f("f_cta_body")), "story.result-title-tool-body"),
        when(f("f_has_product") & f("f_solves") & (f("f_problems") >= 2), "story.solves-everything"),
        when(f("f_offer") & (words >= 80) & (f("f_limits") == 0), "story.no-limitations"),
        when(_has("_product") & (words < 60) & ~f("_body").rlike("[0-9]"), "story.few-details"),
        when(often & (mentions >= 6), "lang.seo-name-repetition", explanation=times),
        when(often & (mentions < 6), "story.name-repeated", explanation=times),
        when(f("f_testimonial"), "story.testimonial", excerpt=_excerpt(P.TESTIMONIAL)),
        when(f("f_dramatic") & f("f_offer"), "story.dramatic-claims", excerpt=_excerpt(P.DRAMATIC)),
    )


def language() -> Column:
    f = F.col
    features = f("f_features")
    return signals(
        when(f("f_hype"), "lang.hype-phrases", excerpt=_excerpt(P.HYPE)),
        when(f("f_transform"), "lang.transformation", excerpt=_excerpt(P.TRANSFORM)),
        when((features >= 5) & (f("_words") >= 60), "lang.feature-focus", explanation=F.concat(F.lit("The text leans heavily on feature and benefit language ("), features.cast("string"), F.lit(" feature terms)"))),
        when((f("f_bullets") >= 3) & (features >= 2), "lang.sales-page-format"),
        when(f("f_slogan"), "lang.slogans", excerpt=_excerpt(P.SLOGAN)),
        when(f("f_performance"), "lang.unsupported-performance", excerpt=_excerpt(P.PERFORMANCE)),
        when(f("f_pricing"), "lang.pricing-details", excerpt=_excerpt(P.PRICING, "_body", "_sb")),
        when(f("f_search") & (f("_primary").isNotNull() | _has("_product")), "lang.search-title"),
    )


def with_disclosure(df: DataFrame) -> DataFrame:
    """Adds f_creator_by (which pattern says that the author made it), f_clear and f_buried."""
    f, x = F.col, F.col("_sx")
    about = f("_primary").isNotNull() | _has("_product")
    plain = F.regexp_replace(x, P.GENERIC_POSSESSIVE, " ").rlike(P.CLEAR_CREATOR)
    by = F.when(f("f_named"), 1).when(f("f_relative"), 2).when(f("f_creator") & (about | plain), 3).otherwise(0)
    df = once(df, {"f_creator_by": by})
    late = lambda at: ((f("_words") > 150) & (at > 0.85)) | ((f("_words") > 300) & (at > 0.5))
    place = lambda p: X.position(x, p)
    maker = F.when(f("f_creator_by") == 1, place(P.CREATOR_NAMED)).when(f("f_creator_by") == 2, place(P.CREATOR_RELATIVE)).when(f("f_creator_by") == 3, place(P.CLEAR_CREATOR)).otherwise(-1.0)
    buried = late(maker)
    for fact, p in (("f_employment", P.CLEAR_EMPLOYMENT), ("f_benefit", P.CLEAR_BENEFIT), ("f_affiliate", P.CLEAR_AFFILIATE)):
        buried = buried | F.when(f(fact), late(place(p))).otherwise(False)
    said = (f("f_creator_by") > 0) | f("f_employment") | f("f_benefit") | f("f_affiliate")
    return once(df, {"f_clear": said | F.coalesce("brandAffiliateLabel", F.lit(False)), "f_buried": (f("_words") > 150) & said & buried})


def disclosure() -> Column:
    f = F.col
    maker = F.when(f("f_creator_by") == 1, _excerpt(P.CREATOR_NAMED)).when(f("f_creator_by") == 2, _excerpt(P.CREATOR_RELATIVE)).otherwise(_excerpt(P.CLEAR_CREATOR))
    return signals(
        when(f("f_creator_by") > 0, "disclosure.creator", excerpt=maker),
        when(f("f_employment"), "disclosure.employment", excerpt=_excerpt(P.CLEAR_EMPLOYMENT)),
        when(f("f_benefit"), "disclosure.material-benefit", excerpt=_excerpt(P.CLEAR_BENEFIT)),
        when(f("f_affiliate"), "disclosure.affiliate", excerpt=_excerpt(P.CLEAR_AFFILIATE)),
        when(f("brandAffiliateLabel"), "disclosure.brand-affiliate-label"),
        when(f("f_buried"), "disclosure.buried"),
        when(~f("f_clear") & f("f_working_on"), "disclosure.unclear-working-on", excerpt=_excerpt(P.UNCLEAR_WORKING_ON)),
        when(~f("f_clear") & f("f_involved"), "disclosure.unclear-involved", excerpt=_excerpt(P.UNCLEAR_INVOLVED)),
        when(~f("f_clear") & f("f_friends"), "disclosure.friends-product", excerpt=_excerpt(P.FRIENDS_PRODUCT)),
    )


def account() -> Column:
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    author = bare(F.coalesce("author", F.lit("")))
    primary = F.when(F.col("_primary").isNotNull(), F.array(F.col("_primary.name"))).otherwise(F.array().cast("array<string>"))
    tries = F.filter(F.transform(F.concat(primary, F.transform("_hosts", X.first_label)), bare), lambda n: F.length(n) >= 4)
    like = (F.length(author) >= 4) & F.exists(tries, lambda n: F.contains(author, n) | F.contains(n, author))
    return signals(when(like, "account.username-matches", explanation=F.concat(F.lit("The username resembles the product or brand name ("), F.col("author"), F.lit(")"))))


def counter() -> Column:
    f = F.col
    names = F.transform("_names", lambda n: n["name"])
    compares = F.filter(X.split_sentences(f("_sx")), lambda s: s.rlike(P.COMPARE) & (F.size(F.filter(names, lambda n: X.mentions(s, n))) >= 2))
    compares = F.when((F.size("_names") >= 3) & hit(f("_sx"), P.COMPARE, f("_lx")), F.try_element_at(compares, F.lit(1)))
    direct_ = F.size("s_direct") > 0
    commercial = direct_ | F.exists("s_links", lambda s: s["id"] != "link.product-link") | _has("_product")
    return signals(
        when(f("f_limits") >= 1, "counter.limitations", F.when(f("f_limits") >= 2, -15.0).otherwise(-10.0), "The post discusses drawbacks or limitations", _excerpt(P.LIMITATION)),
        when(compares.isNotNull(), "counter.compares-alternatives", excerpt=F.left(X.normalize_whitespace(compares), F.lit(80))),
        when((F.size("_links") == 0) & (f("_words") >= 120), "counter.useful-no-links"),
        when(f("f_discourage"), "counter.discourages-buyers", excerpt=_excerpt(P.DISCOURAGE)),
        when(~commercial, "counter.no-cta"),
    )


def reach() -> Column:
    return signals(
        when(F.col("upvotes").isNotNull(), "reach.upvotes", explanation=F.concat(F.format_number("upvotes", 0), F.lit(" upvotes (affects reach only)"))),
        when(F.col("commentsCount").isNotNull(), "reach.comments", explanation=F.concat(F.format_number("commentsCount", 0), F.lit(" comments (affects reach only)"))),
    )


def availability() -> Column:
    feed = ~F.coalesce("isDetailPage", F.lit(False))
    return signals(when(feed, "availability.comments-unavailable"), when(feed & (F.length("body") > 0), "availability.body-truncated"))


def detect(posts: DataFrame, as_of: Column | None = None) -> DataFrame:
    """posts with the array signals, in the order that ties are settled by. as_of: epoch seconds for "days ago"."""
    df = with_disclosure(with_facts(with_context(posts)))
    df = with_history_facts(with_comment_facts(df))
    kinds = {"s_direct": direct(), "s_links": links(), "s_workflow": workflow(), "s_narrative": narrative(), "s_language": language(), "s_disclosure": disclosure(), "s_account": account()}
    df = once(df, kinds | {"s_comments": comment_signals()})
    df = once(df, {"s_counter": counter(), "s_history": history_signals(F.unix_timestamp().cast("double") if as_of is None else as_of)})
    f = F.col
    admitted = F.exists("s_comments", lambda s: s["id"] == "community.author-admission")
    told = f("f_clear") | f("f_working_on") | f("f_involved") | f("f_friends")
    promoted = f("_primary").isNotNull() & ((F.size("s_workflow") > 0) | (F.size("s_links") > 0) | (F.size("s_direct") > 0))
    more = signals(
        when(promoted & ~told & ~admitted, "workflow.no-relationship-disclosed", explanation=F.concat(F.lit("No relationship with "), f("_primary.name"), F.lit(" is disclosed"))),
        when(admitted & ~f("f_clear"), "disclosure.comments-only"),
    )
    order = [*kinds, "s_comments", "s_counter", "s_history"]
    df = once(df, {"signals": F.concat(*order, more, reach(), availability())})
    return df.drop(*[c for c in df.columns if c[:2] in ("f_", "s_")])
