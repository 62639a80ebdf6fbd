"""Posts with comments and histories built from the synthetic tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: What is set behind a document's text, by doc_id; each sets off other detectors, or none.
PHRASES = [
    "",
    "Please sign up today and use code SAVE20 for 20% off.",
    "DM me and I will send the template.",
    "Comment interested and I will reply.",
    "Join the waitlist for early access beta.",
    "Sign up now and get free credits. Would love to hear your thoughts.",
    "This game-changer transformed my mornings, highly recommend, worth every penny.",
    "It has downsides and a steep learning curve, and it is pricey.",
    "I work for the company behind it.",
    "I was paid for this sponsored post.",
    "My affiliate link is below and I earn a small commission.",
    "I have been working on this for a while.",
    "My friend built it, and I know the founder.",
    "It is the fastest way to save 10 hours, 5x faster, $9/month on the free plan.",
    "You probably don't need it, skip it if you are happy.",
    "I built this app because I was stuck and frustrated, and finally it doubled my output.",
    "We made FlowMatic and FlowMatic is what made it work; FlowMatic saved me.",
    "Removed by moderators for self-promo spam.",
    "First, open Notion. Then, Slack. After that, FlowMatic is essential. You must have FlowMatic. Thanks to FlowMatic it runs. FlowMatic helps.",
    "I was stuck. I found https://www.flowmatic.io/a and https://flowmatic.io/b too. Now I sleep. What finally helped was that.",
    "See https://bit.ly/abc1 or https://shop.example.com/x?ref=me for it.",
    "It solved everything, I was stuck and wasted days at https://shop.example.com/app.",
    "Compared to Notion and Slack, FlowMatic is fine. Trello is an alternative.",
    "The app that we built is live, 400% growth overnight. FlowMatic FlowMatic. FlowMatic, and FlowMatic. Or FlowMatic, so FlowMatic.",
    "There is a project I'm part of. Sign up at https://flowmatic.io today.",
    "Here it is:\n- one feature\n- two integrations\n- three dashboards, unlimited, real-time and automated analytics",
    "We built QuickNotes. I use Notion and Slack and Trello and https://quicknotes.app for it; QuickNotes is best.",
    "As of now it is my tool and my company.",
]
#: What is set before it.
OPENINGS = ["", "", "", "I cried and we were broke, it was hopeless. ", "", "Never mind. ", ""]
#: What titles begin with.
TITLES = ["", "How to grow in 30 days: ", "Best tools for ", "", "I made $500 with it, ", ""]
#: What commenters say; LINK stands for the post's own link.
SAYINGS = [
    "This is an ad, plain and simple, I reported it",
    "This is an ad plain and simple, I reported it now",
    "Thanks for sharing, exactly what I needed today, great tool",
    "Thanks for sharing, exactly what I needed today, great tool indeed",
    "thanks for sharing exactly what I needed today great tool",
    "I built this app over the summer, happy to answer",
    "DM me and I will send it",
    "Comment interested and I will reply",
    "Join my discord or join our newsletter",
    "See LINK for the details",
    "OP works for them, see LINK",
    "undisclosed shill, https://www.reddit.com/r/test/comments/abc1",
    "posted this before, same post as last week",
    "I use it daily and it is fine",
    "Does it run on the old phone?",
    "Yes, it does, and here is how",
    "My affiliate link is in my profile",
    "what a spammer, keeps posting",
]
#: What authors say elsewhere.
ELSEWHERE = [
    "Nothing to see here, just a walk in the park",
    "I built this app because I needed it",
    "a tool we made last year, try it",
    "I work for the company behind it",
    "my affiliate link is there too",
    "See LINK again",
    "We made QuickNotes and it went well",
    "An ordinary evening at home",
]
SITES = ["blog.example.org", "shop.example.net", "reddit.com", "files.example.io", None]
REASONS = ["not_found", "timeout", "no_author", "oddly", None]
AS_OF = 1_700_000_000


def quote(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def as_sql_list(items) -> str:
    return "[" + ", ".join(map(quote, items)) + "]"


def _pick(items: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x).cast("string") for x in items]), (at % len(items) + 1).cast("int"))


def _linked(said: Column) -> Column:
    return F.replace(said, F.lit("LINK"), F.coalesce("link", F.lit("https://other.example/x")))


def _comments(d: Column) -> Column:
    def one(j: Column) -> Column:
        return F.struct(
            F.when((d + j) % 11 != 0, F.concat(F.lit("c"), ((d + j * j) % 3).cast("string"))).alias("author"),
            _linked(_pick(SAYINGS, F.when(d % 45 == 30, 9).otherwise(F.floor(d / 3) * 5 + j * (F.floor(d / 9) % 4)))).alias("text"),
            (((d + j) % 4 == 0) | (d % 5 == 0)).alias("isOp"),
            (j % 3).cast("int").alias("depth"),
        )

    return F.transform(F.sequence(F.lit(1), d % 8), lambda j: one(j - 1))


def _history(d: Column) -> Column:
    host = F.col("host")
    n, m = (F.floor(d / 5) % 13).cast("int"), (F.floor(d / 7) % 8).cast("int")
    list_ = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: f(k - 1))).otherwise(F.slice(F.transform(F.sequence(F.lit(1), F.lit(1)), lambda k: f(k - 1)), 1, 0))

    def submission(k: Column) -> Column:
        about = F.when(d % 2 == 0, (d + k) % 3 != 0).otherwise(k == 5)
        title = F.when((k == 3) & (d % 4 == 2), F.concat("title", F.lit(" again today"))).when((k == 4) & (d % 6 == 0), F.col("title")).otherwise(F.concat(F.lit("Weekly notes number "), k.cast("string")))
        return F.struct(
            F.when(k == 2, F.concat(F.lit("t3_"), d.cast("string"))).otherwise(F.concat(F.lit("h"), k.cast("string"))).alias("id"),
            F.concat(F.lit("Sub"), (k % (d % 4 + 1)).cast("string")).alias("subreddit"),
            title.alias("title"),
            F.when(about, host).otherwise(_pick(SITES, k)).alias("domain"),
            F.when(about & (k % 2 == 1), F.col("link")).alias("url"),
            F.when((k == 1) & (d % 8 == 4), F.left("body", F.lit(400))).otherwise(_linked(_pick(ELSEWHERE, d + k * 2))).alias("excerpt"),
            F.when(k % 6 != 5, AS_OF - 100_000 - k * 86_400 - d).alias("createdUtc"),
            F.when(k % 3 != 0, F.concat(F.lit("/r/x/comments/"), k.cast("string"))).alias("permalink"),
        )

    def comment(k: Column) -> Column:
        return F.struct(
            F.concat(F.lit("Com"), (k % 3).cast("string")).alias("subreddit"), _linked(_pick(ELSEWHERE, d * 5 + k)).alias("excerpt"), (AS_OF - 50_000 - k * 3_600).cast("long").alias("createdUtc"),
            F.when((d + k) % 2 == 0, F.filter(F.array(host), lambda h: h.isNotNull())).otherwise(F.array().cast("array<string>")).alias("linkDomains"), F.lit(None).cast("string").alias("postTitle"),
        )

    there = d % 5 != 1
    none = lambda c: F.slice(c, 1, 0)
    subs, coms = list_(n, submission), list_(m, comment)
    return F.when(
        d % 5 != 0,
        F.struct(
            F.col("author").alias("author"), F.lit(AS_OF * 1000).alias("fetchedAt"), there.alias("available"), F.when(~there, _pick(REASONS, F.floor(d / 5))).alias("reason"),
            F.when(d % 9 != 0, F.when(d % 7 == 2, d % 40).otherwise(d * 37 % 2000).cast("double")).alias("accountAgeDays"), F.when(d % 10 != 3, d * 3 % 80).alias("linkKarma"), (d % 40).alias("commentKarma"), F.lit(False).alias("truncated"),
            F.when(there, subs).otherwise(none(subs)).alias("submissions"), F.when(there, coms).otherwise(none(coms)).alias("comments"),
        ),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A post for each document: its text, with phrases, links, comments and a history by doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    few = spark.sparkContext.defaultParallelism
    if len(docs.inputFiles()) < few:  # a few files would be read by a few tasks
        docs = docs.repartition(few)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").alias("link"))
    d = F.col("doc_id")
    df = docs.join(pages, d == F.col("page_id"), "left").withColumn("host", X.host_of(F.col("link")))
    title = F.concat(_pick(TITLES, d), F.left("text", F.lit(80)))
    body = F.concat(_pick(OPENINGS, d), F.col("text"), F.lit("\n"), _pick(PHRASES, d))
    named = (d % 9 == 4) & F.col("host").isNotNull()
    df = df.withColumns({"title": title, "body": body, "author": F.when(named, F.concat(X.first_label(F.col("host")), F.lit("_dev"))).otherwise(F.col("source"))})
    return df.select(
        "doc_id",
        d.cast("string").alias("id"),
        "title",
        "body",
        "author",
        F.col("lang").alias("subreddit"),
        (d * 37 % 6000).alias("upvotes"),
        F.when(d % 5 != 0, d * 11 % 400).alias("commentsCount"),
        (d % 100 + 0.5).alias("ageHours"),
        F.when(d % 4 != 0, d % 50 * 10_000 + 500).alias("subredditSubscribers"),
        F.when(F.col("link").isNotNull(), F.array("link")).otherwise(F.array().cast("array<string>")).alias("links"),
        F.when(d % 6 == 1, F.array(F.concat(F.lit("www.Example"), (d % 3).cast("string"), F.lit(".io")), F.lit("reddit.com"))).otherwise(F.array().cast("array<string>")).alias("outboundDomains"),
        (d % 3 == 0).alias("isDetailPage"),
        (d % 31 == 0).alias("brandAffiliateLabel"),
        F.when(d % 8 > 0, _comments(d)).otherwise(F.slice(_comments(F.lit(1)), 1, 0)).alias("visibleComments"),
        _history(d).alias("authorHistory"),
    )


_HOST = "regexp_replace(lower(regexp_extract({u}, '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '')"
_ASCII = "regexp_replace({x}, '[^\\x00-\\x7F]', '¤', 'g')"


def sql_host(u: str) -> str:
    return _HOST.format(u=u)


def sql_shadow(x: str) -> str:
    return _ASCII.format(x=x)


#: The same as common table expressions; x, b and t are the shadows that patterns read.
POSTS_SQL = f"""
linked AS (SELECT d.*, p.url AS link, nullif({sql_host("p.url")}, '') AS own_host FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id),
posts AS (
  SELECT doc_id, {as_sql_list(TITLES)}[doc_id % {len(TITLES)} + 1] || left(text, 80) AS title, {as_sql_list(OPENINGS)}[doc_id % {len(OPENINGS)} + 1] || text || chr(10) || {as_sql_list(PHRASES)}[doc_id % {len(PHRASES)} + 1] AS body0,
         doc_id * 37 % 6000 AS upvotes, CASE WHEN doc_id % 5 <> 0 THEN doc_id * 11 % 400 END AS comments, doc_id % 100 + 0.5 AS age,
         CASE WHEN doc_id % 4 <> 0 THEN doc_id % 50 * 10000 + 500 END AS members, doc_id % 3 = 0 AS detail, doc_id % 31 = 0 AS brand, link, own_host,
         CASE WHEN doc_id % 9 = 4 AND own_host IS NOT NULL THEN string_split(own_host, '.')[1] || '_dev' ELSE source END AS author
  FROM linked
), trimmed AS (SELECT *, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title1, trim(body0, E' \\n\\t\\r') AS body1 FROM posts),
shadows AS (SELECT *, {sql_shadow("title1")} || chr(10) || {sql_shadow("body1")} AS x, {sql_shadow("body1")} AS b, {sql_shadow("title1")} AS t, coalesce(own_host, '') AS host FROM trimmed)"""
