"""What the detectors share of a post, as columns that begin with an underscore.

_title, _body and _text are the texts; _st, _sb and _sx their ASCII shadows, which patterns run on;
_lx is _sx in lower case, for the gates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.fixed import FAMILIAR_TOOLS
from ..functions.names import with_names
from .catalog import once
from .posts import conform



def none(kind: str = "array<string>") -> Column:
    return F.array().cast(kind)


def _hosts(links: Column) -> Column:
    return F.transform(links, X.host_of)


def with_context(posts: DataFrame) -> DataFrame:
    df = conform(posts)
    title = X.normalize_whitespace(F.coalesce("title", F.lit("")))
    df = df.withColumns({"_title": title, "_body": X.trim_all(F.coalesce("body", F.lit("")))})
    df = df.withColumn("_text", F.concat("_title", F.lit("\n"), "_body"))
    links = F.array_union(F.coalesce("links", none()), X.extract_urls(F.col("_body")))
    df = df.withColumn("_links", F.filter(links, lambda u: u.isNotNull()))
    df = df.withColumn("_product", F.filter("_links", lambda u: X.is_product_host(X.host_of(u))))
    outbound = F.transform(F.coalesce("outboundDomains", none()), lambda d: F.regexp_replace(F.lower(d), r"\Awww\.", ""))
    outbound = F.filter(outbound, lambda d: d.isNotNull() & ~d.isin(X.NON_PRODUCT_HOSTS))
    df = df.withColumn("_link_hosts", _hosts(F.col("_product"))).withColumn("_hosts", F.array_union("_link_hosts", outbound))
    df = with_names(df)
    tools = [t.lower() for t in FAMILIAR_TOOLS]
    known = F.filter("_names", lambda n: F.lower(n["name"]).isin(tools))
    others = F.filter("_names", lambda n: ~F.lower(n["name"]).isin(tools))
    labels = F.transform("_hosts", lambda d: F.lower(X.first_label(d)))
    best = F.aggregate(others, F.lit(None).cast("struct<name: string, mentions: int>"), lambda a, n: F.when(a.isNull() | (n["mentions"] > a["mentions"]), n).otherwise(a))
    linked = F.filter(others, lambda n: F.array_contains(labels, F.lower(n["name"])))
    best_linked = F.aggregate(linked, F.lit(None).cast("struct<name: string, mentions: int>"), lambda a, n: F.when(a.isNull() | (n["mentions"] > a["mentions"]), n).otherwise(a))
    df = once(df, {"_familiar": F.transform(known, lambda n: n["name"]), "_others": F.transform(others, lambda n: n["name"]), "_primary": F.coalesce(best_linked, best)})
    shadow = X.ascii_shadow
    df = once(df, {"_st": shadow(F.col("_title")), "_sb": shadow(F.col("_body"))})
    df = once(df, {"_sx": F.concat("_st", F.lit("\n"), "_sb")})
    return once(df, {"_lx": F.lower("_sx"), "_lb": F.lower("_sb"), "_words": X.word_count(F.col("_text")), "_sentences": X.split_sentences(F.col("_sb"))})
