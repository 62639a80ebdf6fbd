"""Evidence from the author's public history, carried in the post's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as P
from ..functions import text as X
from .catalog import once, signals, when

NEAR = 0.6
# How a missing history is explained.
REASONS = {
    "private_or_suspended": "profile is private, suspended or deleted",
    "not_found": "profile not found",
    "rate_limited": "Reddit rate limit reached; try again later",
    "timeout": "Reddit did not answer in time",
    "fetch_failed": "Reddit could not be reached",
    "no_author": "no author name visible",
    "disabled": "history check is turned off",
}


def describe_reason(reason: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, reason), reason, F.lit("unknown reason"))


def bare_id(id: Column) -> Column:
    return F.regexp_replace(F.lower(id), r"\At3_", "")


def permalink(path: Column) -> Column:
    return F.when((path == "") | path.isNull(), None).when(path.rlike("(?i)\\Ahttps?://"), path).otherwise(F.concat(F.lit("https://www.reddit.com"), F.when(F.startswith(path, F.lit("/")), "").otherwise("/"), path))


def _submission_hosts(s: Column) -> Column:
    return F.filter(F.array(F.lower(s["domain"]), X.host_of(s["url"])), lambda d: d.isNotNull() & (d != ""))


def _own_words(s: Column) -> Column:
    return F.concat(F.coalesce(s["title"], F.lit("")), F.lit("\n"), F.coalesce(s["excerpt"], F.lit("")))


def near_duplicates(title: Column, body: Column, items: Column) -> Column:
    """Those of the submissions whose title or excerpt says nearly what title or body says."""
    t, b = X.unicode_words(title), X.unicode_words(F.left(body, F.lit(1500)))

    def near(s: Column) -> Column:
        e = X.unicode_words(F.coalesce(s["excerpt"], F.lit("")))
        by_title = (F.size(t) >= 5) & (X.overlap(t, X.unicode_words(F.coalesce(s["title"], F.lit("")))) >= NEAR)
        return by_title | ((F.size(b) >= 20) & (F.size(e) >= 15) & (X.overlap(b, e) >= NEAR))

    return F.filter(items, near)


def numbered(docs: DataFrame, by: str, order: str, cell: int = 1 << 20) -> DataFrame:
    """docs with place, their number (from 0) by order among those of the same by, counted cell by cell."""
    cells = F.floor(F.col(order) / cell)
    inside = F.row_number().over(Window.partitionBy(by, cells).orderBy(order)) - 1
    counts = docs.groupBy(F.col(by).alias("_by"), cells.alias("_cell")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_by").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_by", "_cell", before.alias("_start"))
    found = docs.withColumn("_inside", inside).join(starts, (F.col(by) == F.col("_by")) & (cells == F.col("_cell")))
    return found.withColumn("place", F.col("_start") + F.col("_inside")).drop("_by", "_cell", "_start", "_inside")


def near_posts(posts: DataFrame, by: str, order: str, most: int = 100) -> DataFrame:
    """(order, other): each post (title, body, excerpt) and those of the most before it, of the same by, that say nearly the same.

    Word sets are made once for each post, of 64-bit hashes of words; the texts stay behind. Posts without by take no part.
    """
    words = lambda c: F.transform(X.unicode_words(F.coalesce(c, F.lit(""))), lambda w: F.xxhash64(w))
    sets = posts.where(F.col(by).isNotNull()).select(order, by, words(F.col("title")).alias("t"), words(F.left("body", F.lit(1500))).alias("b"), words(F.col("excerpt")).alias("e"))
    sets = numbered(sets, by, order)
    mine = sets.where((F.size("t") >= 5) | (F.size("b") >= 20)).select(order, by, "t", "b", F.explode(F.sequence(F.greatest(F.lit(0), F.col("place") - most), F.col("place"))).alias("place_"))
    other = sets.select(F.col(by).alias("by_"), F.col("place").alias("at"), F.col(order).alias("other"), F.col("t").alias("t2"), F.col("e").alias("e2"))
    size = lambda a, b: F.least(F.size(a), F.size(b)) >= NEAR * F.greatest(F.size(a), F.size(b))
    pairs = mine.join(other, (F.col(by) == F.col("by_")) & (F.col("place_") == F.col("at"))).where(F.col("other") != F.col(order))
    by_title = F.when((F.size("t") >= 5) & size("t", "t2"), X.overlap(F.col("t"), F.col("t2")) >= NEAR).otherwise(False)
    by_body = F.when((F.size("b") >= 20) & (F.size("e2") >= 15) & size("b", "e2"), X.overlap(F.col("b"), F.col("e2")) >= NEAR).otherwise(False)
    return pairs.where(by_title | by_body).select(order, "other")


def with_history_facts(df: DataFrame) -> DataFrame:
    """Adds the other submissions and comments, and which of them concern the post's product."""
    h = F.col("authorHistory")
    there = h.isNotNull() & F.coalesce(h["available"], F.lit(False))
    title = F.lower("_title")
    other = lambda s: ~F.coalesce((F.col("id") != "") & (s["id"] != "") & (bare_id(F.col("id")) == bare_id(s["id"])), F.lit(False)) & (F.lower(X.normalize_whitespace(F.coalesce(s["title"], F.lit("")))) != title)
    none = lambda c: F.slice(c, 1, 0)
    subs = F.coalesce(F.filter(h["submissions"], other), none(h["submissions"]))
    df = once(df, {"f_there": there, "f_subs": F.when(there, subs), "f_coms": F.when(there, h["comments"]), "f_names": F.filter("_others", lambda n: F.length(n) >= 3)})
    hosts = F.col("_hosts")
    has = F.size("f_names") + F.size(hosts) > 0

    def about(text: Column, own: Column) -> Column:
        plain = X.ascii_shadow(text)
        return F.exists("f_names", lambda n: X.mentions(plain, n)) | F.exists(hosts, lambda d: F.contains(F.lower(text), d)) | F.arrays_overlap(own, hosts)

    coms_hosts = lambda c: F.transform(F.coalesce(c["linkDomains"], F.array().cast("array<string>")), F.lower)
    df = once(
        df,
        {
            "f_has_targets": has,
            "f_product_subs": F.filter("f_subs", lambda s: has & about(_own_words(s), _submission_hosts(s))),
            "f_product_coms": F.filter("f_coms", lambda c: has & about(F.coalesce(c["excerpt"], F.lit("")), coms_hosts(c))),
            "f_host_subs": F.filter("f_subs", lambda s: F.arrays_overlap(_submission_hosts(s), hosts)),
            "f_host_coms": F.filter("f_coms", lambda c: F.arrays_overlap(coms_hosts(c), hosts)),
        },
    )
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return df.withColumns({f"f_n_{c}": F.when(F.col("f_there"), F.greatest(F.lit(0), size(f"f_{c}"))).otherwise(0) for c in ("subs", "coms", "product_subs", "product_coms", "host_subs", "host_coms")})


def _plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def history_signals(as_of: Column) -> Column:
    f, h = F.col, F.col("authorHistory")
    there, has = f("f_there"), f("f_has_targets")
    subs, coms, psubs, pcoms = f("f_n_subs"), f("f_n_coms"), f("f_n_product_subs"), f("f_n_product_coms")
    total, mentions = subs + coms, psubs + pcoms
    some = there & has & (total > 0)
    places = lambda c: F.transform(c, lambda s: F.lower(s["subreddit"]))
    linked = f("f_n_host_subs") + f("f_n_host_coms")
    linked_places = F.size(F.array_distinct(F.concat(places("f_host_subs"), places("f_host_coms"))))
    product_places = F.array_distinct(places("f_product_subs"))
    share = F.when(subs > 0, psubs / F.greatest(F.lit(1), subs)).otherwise(0.0)
    age, karma = h["accountAgeDays"], F.coalesce(h["linkKarma"], F.lit(0)) + F.coalesce(h["commentKarma"], F.lit(0))
    dup = F.when(some, F.try_element_at(near_duplicates(F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")), F.when(psubs > 0, f("f_product_subs")).otherwise(f("f_subs"))), F.lit(1)))
    when_ = lambda t: F.when(t.isNotNull() & (t != 0), F.concat(F.lit(" ("), X.days_ago(t, as_of), F.lit(")"))).otherwise("")

    patterns = [P.CREATOR_NAMED, P.CREATOR_RELATIVE, P.CLEAR_CREATOR, P.CLEAR_EMPLOYMENT, P.CLEAR_AFFILIATE]
    item = lambda text, where, t, url: F.struct(text.alias("text"), where.alias("where"), t.alias("when"), url.alias("url"))
    items = F.concat(
        F.transform("f_product_subs", lambda s: item(_own_words(s), s["subreddit"], s["createdUtc"], permalink(s["permalink"]))),
        F.transform("f_product_coms", lambda c: item(F.coalesce(c["excerpt"], F.lit("")), c["subreddit"], c["createdUtc"], F.lit(None).cast("string"))),
    )
    said = F.when(some & (mentions > 0), F.try_element_at(F.filter(items, lambda i: F.exists(F.array(*map(F.lit, patterns)), lambda p: F.regexp_like(X.ascii_shadow(i["text"]), p))), F.lit(1)))
    shadow = X.ascii_shadow(said["text"])
    at = F.coalesce(*[F.when(F.regexp_instr(shadow, F.lit(p)) > 0, F.regexp_instr(shadow, F.lit(p))) for p in patterns])
    around = F.left(X.normalize_whitespace(F.substr(said["text"], F.greatest(F.lit(1), at - 20), F.lit(90))), F.lit(90))
    sites = F.array_distinct(F.filter(F.flatten(F.transform("f_subs", _submission_hosts)), lambda d: ~d.rlike(r"reddit\.com|redd\.it")))
    years = F.when(age.isNotNull(), F.concat(F.lit(", account "), X.round_half_up(age / 365).cast("string"), F.lit("+ years old"))).otherwise("")
    whole = lambda n: n.cast("string")
    return signals(
        when(h.isNull(), "availability.profile-history-unavailable"),
        when(h.isNotNull() & ~there, "availability.profile-history-unavailable", explanation=F.concat(F.lit("Author history could not be checked ("), describe_reason(h["reason"]), F.lit(")"))),
        when(there, "availability.profile-history-checked", explanation=F.concat(F.lit("Checked "), _plural(subs, "other recent post", "other recent posts"), F.lit(" and "), _plural(coms, "comment", "comments"), F.lit(" from the author's public profile"))),
        when(some & (linked >= 2), "account.repeats-domain", F.when(linked >= 4, 25.0).otherwise(15.0), F.concat(F.lit("The author linked "), F.try_element_at("_hosts", F.lit(1)), F.lit(" in "), whole(linked), F.lit(" other recent posts or comments across "), _plural(linked_places, "community", "communities"))),
        when(some & (psubs >= 2) & (F.size(product_places) >= 3), "history.cross-subreddit", explanation=F.concat(F.lit("The same product appears in "), whole(psubs), F.lit(" other recent posts across "), whole(F.size(product_places)), F.lit(" communities ("), F.array_join(F.transform(F.slice(product_places, 1, 4), lambda s: F.concat(F.lit("r/"), s)), ", "), F.lit(")"))),
        when(some & (subs >= 3) & (share >= 0.5), "account.single-product-history", explanation=F.concat(whole(psubs), F.lit(" of the author's "), whole(subs), F.lit(" other recent posts concern the same product"))),
        when(dup.isNotNull(), "history.repeated-text", explanation=F.concat(F.lit("u/"), h["author"], F.lit(" published a near-identical post in r/"), dup["subreddit"], when_(dup["createdUtc"])), excerpt=F.left(dup["title"], F.lit(80)), url=permalink(dup["permalink"])),
        when(some & (pcoms >= 3) & (pcoms / F.greatest(F.lit(1), coms) >= 0.4), "account.comments-redirect", explanation=F.concat(whole(pcoms), F.lit(" of "), whole(coms), F.lit(" recent comments mention the same product"))),
        when(said.isNotNull(), "account.self-identified-elsewhere", verified=True, explanation=F.concat(F.lit("In r/"), said["where"], when_(said["when"]), F.lit(" u/"), h["author"], F.lit(" describes the product as their own")), excerpt=around, url=said["url"]),
        when(there & (age < 30), "account.new-account", explanation=F.concat(F.lit("Account is "), whole(F.greatest(F.lit(0), X.round_half_up(age))), F.lit(" days old (context only)"))),
        when(there & h["linkKarma"].isNotNull() & h["commentKarma"].isNotNull() & (karma < 50), "account.low-karma", explanation=F.concat(F.lit("Very low karma ("), whole(karma), F.lit(") (context only)"))),
        when(there & (age < 30) & (karma < 50) & (share >= 0.5) & (subs >= 2), "account.new-low-karma-product-focus"),
        when(there & has & (subs >= 5) & (F.size(sites) >= 3) & (share < 0.3), "counter.varied-recommendations", explanation=F.concat(F.lit("The author links to "), whole(F.size(sites)), F.lit(" different sites in recent posts; this product is not a recurring one"))),
        when(there & (total >= 10) & (mentions / F.greatest(F.lit(1), total) <= 0.1) & (age.isNull() | (age >= 365)), "counter.genuine-history", explanation=F.concat(F.lit("Long public history ("), whole(total), F.lit(" recent items"), years, F.lit(") with little or no mention of this product"))),
        when(there & has & (total >= 8) & (mentions <= 1), "counter.incidental-product"),
    )


def summarize(h: Column, as_of: Column, most: int = 25) -> Column:
    """A history as lines of text, most items at most."""
    whole = lambda n: n.cast("string")
    since = lambda t: F.when(t.isNotNull() & (t != 0), F.concat(F.lit(" "), X.days_ago(t, as_of))).otherwise("")
    head = F.concat(
        F.lit("author history: "), whole(F.size(h["submissions"])), F.lit(" recent posts, "), whole(F.size(h["comments"])), F.lit(" recent comments"),
        F.when(h["accountAgeDays"].isNotNull(), F.concat(F.lit(", account age "), whole(X.round_half_up(h["accountAgeDays"])), F.lit(" days"))).otherwise(""),
        F.when(h["linkKarma"].isNotNull(), F.concat(F.lit(", karma "), whole(h["linkKarma"] + F.coalesce(h["commentKarma"], F.lit(0))))).otherwise(""),
    )
    line = lambda kind, s, text, more: F.concat(F.lit(f"- [{kind}] r/"), s["subreddit"], since(s["createdUtc"]), F.lit(': "'), F.left(text, F.lit(120)), F.lit('"'), more)
    posts = F.transform(F.slice(h["submissions"], 1, most), lambda s: line("post", s, s["title"], F.when(s["domain"].isNotNull(), F.concat(F.lit(" -> "), s["domain"])).otherwise("")))
    room = F.lit(most) - F.least(F.size(h["submissions"]), F.lit(most))
    comments = F.transform(F.slice(h["comments"], F.lit(1), room), lambda c: line("comment", c, c["excerpt"], F.lit("")))
    text = F.array_join(F.concat(F.array(head), posts, comments), "\n")
    return F.when(h.isNull(), "author history: not checked").when(~h["available"], F.concat(F.lit("author history: unavailable ("), describe_reason(h["reason"]), F.lit(")"))).otherwise(text)


def quotable(h: Column) -> Column:
    """What may be quoted of a history: titles and excerpts."""
    text = F.array_join(F.concat(F.transform(h["submissions"], _own_words), F.transform(h["comments"], lambda c: F.coalesce(c["excerpt"], F.lit("")))), "\n")
    return F.when(F.coalesce(h["available"], F.lit(False)), text).otherwise("")
