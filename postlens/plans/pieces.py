"""Queries of the sources and of the smaller operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import cache, feed, history, witness
from ..operators.posts import conform
from ..sources import listings
from ..streaming import limits
from .corpus import AS_OF, POSTS_SQL, SAYINGS, as_sql_list, posts, quote


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- JSON listings -------------------------------------------------------------------------------

STATUSES = [429, 403, 404, 503]


def _status(d: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, [*STATUSES, *[200] * 9])), (d % 13 + 1).cast("int"))


def _reply(d: Column, i: int, level: int, below: Column | None) -> Column:
    who = F.when((d + i + level) % 4 == 0, F.col("source")).otherwise(F.concat(F.lit("u"), ((d + i + level) % 5).cast("string")))
    said = F.when((d + i * 3 + level) % 9 == 0, "[deleted]").otherwise(F.concat_ws("-", F.lit("c"), d, F.lit(i), F.lit(level)))
    data = [who.alias("author"), said.alias("body"), F.when((d + i) % 2 == 0, (d + i + level) % 4 == 0).alias("is_submitter")]
    if below is not None:
        data.append(F.struct(F.struct(F.array(below).alias("children")).alias("data")).alias("replies"))
    kind = F.when((d + i) % 10 == 7, "more").otherwise("t1") if level == 0 else F.lit("t1")
    return F.struct(kind.alias("kind"), F.struct(*data).alias("data"))


def json_posts(spark: SparkSession, d: str) -> DataFrame:
    """Listings of JSON set from documents' columns, and read again."""
    i = F.col("doc_id")
    s = i.cast("string")
    post = F.struct(
        F.concat(F.lit("t3_"), s).alias("name"), F.concat(F.lit("/r/"), "lang", F.lit("/comments/"), s).alias("permalink"), F.when(i % 13 == 5, " ").otherwise(F.concat(F.lit("On "), s)).alias("title"),
        F.concat(F.left("text", F.lit(120)), F.lit("\nsee https://a"), (i % 3).cast("string"), F.lit(".example.com/x.")).alias("selftext"), F.col("source").alias("author"), F.col("lang").alias("subreddit"), (i * 7 % 500).alias("score"),
        (i % 90).alias("num_comments"), (AS_OF - i * 60).cast("double").alias("created_utc"), (i * 1000).alias("subreddit_subscribers"), F.when(i % 2 == 0, F.concat(F.lit("https://www.b"), (i % 4).cast("string"), F.lit(".example.org/y"))).otherwise("https://www.reddit.com/z").alias("url"), (i % 5 == 0).alias("is_self"),
    )
    tree = [_reply(i, k, 0, _reply(i, k, 1, _reply(i, k, 2, _reply(i, k, 3, None)))) for k in range(3)]
    one = lambda *x: F.to_json(F.struct(F.struct(F.array(*x).alias("children")).alias("data")))
    body = F.concat(F.lit("["), one(F.struct(post.alias("data"))), F.lit(","), one(*tree), F.lit("]"))
    raw = _read(spark, d, "documents").select("doc_id", _status(i).alias("status"), F.when(i % 13 == 6, "{no json").otherwise(body).alias("body"))
    p = listings.read_posts(raw, F.lit(float(AS_OF)))
    said = F.array_join(F.transform("post.visibleComments", lambda c: F.concat_ws("/", c["author"], c["depth"].cast("string"), c["isOp"].cast("string"), c["text"])), "|")
    return p.select("doc_id", "ok", "reason", "post.id", "post.url", "post.title", "post.body", "post.author", "post.subreddit", F.col("post.upvotes").cast("double").alias("upvotes"), F.col("post.commentsCount").cast("double").alias("comments"), F.round("post.ageHours", 6).alias("age"), F.col("post.subredditSubscribers").cast("double").alias("members"), F.array_join("post.links", "|").alias("links"), said.alias("said"))


JSON_POSTS_SQL = f"""WITH s AS (SELECT *, [429, 403, 404, 503, 200, 200, 200, 200, 200, 200, 200, 200, 200][doc_id % 13 + 1] AS status FROM documents),
r AS (SELECT *, CASE WHEN status = 429 THEN 'rate_limited' WHEN status = 403 THEN 'forbidden' WHEN status = 404 THEN 'not_found' WHEN status <> 200 THEN 'http_' || status WHEN doc_id % 13 IN (5, 6) THEN 'malformed' END AS reason FROM s),
c AS (SELECT doc_id, i, level, CASE WHEN (doc_id + i + level) % 4 = 0 THEN source ELSE 'u' || (doc_id + i + level) % 5 END AS who, CASE WHEN (doc_id + i) % 2 = 0 THEN (doc_id + i + level) % 4 = 0 END AS flag, source FROM documents, range(3) a(i), range(3) b(level) WHERE (doc_id + i) % 10 <> 7 AND (doc_id + i * 3 + level) % 9 <> 0),
t AS (SELECT doc_id, string_agg(concat_ws('/', who, level, CASE WHEN coalesce(flag, lower(who) = lower(source), FALSE) THEN 'true' ELSE 'false' END, 'c-' || doc_id || '-' || i || '-' || level), '|' ORDER BY i, level) AS said FROM c GROUP BY doc_id)
SELECT doc_id, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN 't3_' || doc_id END AS id, CASE WHEN reason IS NULL THEN 'https://www.reddit.com/r/' || lang || '/comments/' || doc_id END AS url, CASE WHEN reason IS NULL THEN 'On ' || doc_id END AS title,
  CASE WHEN reason IS NULL THEN left(text, 120) || chr(10) || 'see https://a' || doc_id % 3 || '.example.com/x.' END AS body, CASE WHEN reason IS NULL THEN source END AS author, CASE WHEN reason IS NULL THEN lang END AS subreddit, (CASE WHEN reason IS NULL THEN doc_id * 7 % 500 END)::DOUBLE AS upvotes,
  (CASE WHEN reason IS NULL THEN doc_id % 90 END)::DOUBLE AS comments, CASE WHEN reason IS NULL THEN round(doc_id / 60.0, 6)::DOUBLE END AS age, (CASE WHEN reason IS NULL THEN doc_id * 1000 END)::DOUBLE AS members,
  CASE WHEN reason IS NULL THEN CASE WHEN doc_id % 2 = 0 AND doc_id % 5 <> 0 THEN 'https://www.b' || doc_id % 4 || '.example.org/y|' ELSE '' END || 'https://a' || doc_id % 3 || '.example.com/x' END AS links, CASE WHEN reason IS NULL THEN coalesce(said, '') END AS said
FROM r LEFT JOIN t USING (doc_id)"""


def json_histories(spark: SparkSession, d: str) -> DataFrame:
    """Histories of JSON set from documents' columns, read, joined to posts of their authors."""
    i = F.col("doc_id")
    s = i.cast("string")
    items = lambda n, f: F.to_json(F.struct(F.struct(F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(f(k).alias("data"))).alias("children")).alias("data")))
    sub = lambda k: F.struct(F.concat(F.lit("t3_"), k.cast("string")).alias("name"), F.concat(F.lit("S"), (k % 3).cast("string")).alias("subreddit"), F.concat(F.lit("No "), k.cast("string")).alias("title"), F.lit("x.example").alias("domain"), F.concat(F.lit("https://x.example/"), k.cast("string")).alias("url"), F.left("text", F.lit(400)).alias("selftext"), (k * 1000).cast("double").alias("created_utc"), F.lit("/r/s").alias("permalink"))
    com = lambda k: F.struct(F.lit("T").alias("subreddit"), F.concat(F.lit("at https://www.y"), (k % 2).cast("string"), F.lit(".example/a and https://y0.example/b")).alias("body"), (k * 10).cast("double").alias("created_utc"), F.lit("On it").alias("link_title"))
    about = F.to_json(F.struct(F.struct((AS_OF - i * 86400).cast("double").alias("created_utc"), (i % 70).alias("link_karma"), (i % 30).alias("comment_karma")).alias("data")))
    at = _status(i)
    author = F.when(i % 17 == 3, "[deleted]").otherwise(F.concat(F.lit("Author"), s))
    raw = _read(spark, d, "documents").select("doc_id", author.alias("author"), about.alias("about"), items((i % 45 + 1).cast("int"), sub).alias("submitted"), items((i % 4 + 1).cast("int"), com).alias("comments"), F.when(at == 200, 200).otherwise(at).alias("about_status"), F.lit(200).alias("submitted_status"), F.when(i % 19 == 4, 403).otherwise(200).alias("comments_status"))
    found = listings.read_histories(raw, F.lit(float(AS_OF)))
    cards = _read(spark, d, "documents").select("doc_id", F.concat(F.lit("AUTHOR"), s).alias("author"))
    h = F.col("authorHistory")
    out = listings.with_history(conform(cards).select("doc_id", "author"), found)
    first = F.try_element_at(h["submissions"], F.lit(1))
    return out.select(
        "doc_id", h["available"].alias("available"), h["reason"].alias("reason"), F.round(h["accountAgeDays"], 6).alias("days"), h["linkKarma"].cast("double").alias("link_karma"), h["commentKarma"].cast("double").alias("karma"), h["truncated"].alias("truncated"),
        F.size(h["submissions"]).cast("double").alias("submissions"), F.length(first["excerpt"]).cast("double").alias("excerpt"), F.array_join(F.transform(h["comments"], lambda c: F.array_join(c["linkDomains"], "+")), "|").alias("hosts"), history.summarize(h, F.lit(float(AS_OF)), 3).alias("summary"), F.length(history.quotable(h)).alias("quotable"),
    )


JSON_HISTORIES_SQL = f"""WITH s AS (SELECT *, [429, 403, 404, 503, 200, 200, 200, 200, 200, 200, 200, 200, 200][doc_id % 13 + 1] AS a, CASE WHEN doc_id % 19 = 4 THEN 403 ELSE 200 END AS c FROM documents),
r AS (SELECT *, CASE WHEN greatest(a, c) = 429 THEN 'rate_limited' WHEN a = 404 THEN 'not_found' WHEN greatest(a, c) = 403 THEN 'private_or_suspended' WHEN greatest(a, c) >= 300 THEN 'http_' || greatest(a, c) END AS reason, doc_id % 45 + 1 AS n, doc_id % 4 + 1 AS m, least(length(text), 300) AS cut FROM s WHERE doc_id % 17 <> 3),
g AS (SELECT *, reason IS NULL AS good FROM r),
ago AS (SELECT doc_id, k, ': "No ' || k || '" -> x.example' AS tail, floor(({AS_OF} - k * 1000) / 86400.0 + 0.5) AS days FROM g, range(1, 4) t(k) WHERE k <= n),
cago AS (SELECT doc_id, k, ': "at https://www.y' || k % 2 || '.example/a and https://y0.example/b"' AS tail, floor(({AS_OF} - k * 10) / 86400.0 + 0.5) AS days FROM g, range(1, 4) t(k) WHERE k <= m AND k <= 3 - least(n, 3)),
lines AS (SELECT doc_id, 0 AS kind, k, '- [post] r/S' || k % 3 || ' ' || floor(days / 30 + 0.5)::BIGINT || ' months ago' || tail AS line FROM ago UNION ALL SELECT doc_id, 1, k, '- [comment] r/T ' || floor(days / 30 + 0.5)::BIGINT || ' months ago' || tail FROM cago),
told AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY kind, k) AS line FROM lines GROUP BY doc_id)
SELECT d.doc_id, good AS available, reason, CASE WHEN good THEN d.doc_id::DOUBLE END AS days, (CASE WHEN good THEN d.doc_id % 70 END)::DOUBLE AS link_karma, (CASE WHEN good THEN d.doc_id % 30 END)::DOUBLE AS karma, CASE WHEN good THEN n >= 40 END AS truncated, (CASE WHEN good THEN n WHEN reason IS NOT NULL THEN 0 END)::DOUBLE AS submissions, (CASE WHEN good THEN cut END)::DOUBLE AS excerpt,
  CASE WHEN good THEN array_to_string(list_transform(range(1, m + 1), lambda k: CASE WHEN k % 2 = 1 THEN 'y1.example+y0.example' ELSE 'y0.example' END), '|') WHEN reason IS NOT NULL THEN '' END AS hosts,
  CASE WHEN g.doc_id IS NULL THEN 'author history: not checked' WHEN NOT good THEN 'author history: unavailable (' || CASE reason WHEN 'rate_limited' THEN 'Reddit rate limit reached; try again later' WHEN 'not_found' THEN 'profile not found' WHEN 'private_or_suspended' THEN 'profile is private, suspended or deleted' ELSE reason END || ')'
    ELSE 'author history: ' || n || ' recent posts, ' || m || ' recent comments, account age ' || d.doc_id || ' days, karma ' || (d.doc_id % 70 + d.doc_id % 30) || coalesce(chr(10) || line, '') END AS summary,
  CASE WHEN good THEN n * (cut + 1) + list_sum(list_transform(range(1, n + 1), lambda k: length('No ' || k))) + m * length('at https://www.y0.example/a and https://y0.example/b') + n + m - 1 ELSE 0 END::INT AS quotable
FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN told USING (doc_id)"""


def json_bodies(spark: SparkSession, d: str) -> DataFrame:
    body = F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.to_json(F.struct("conv_id", "text")))
    raw = _read(spark, d, "conversations").select("conv_id", "turn", body.alias("body"), F.when(F.col("turn") % 7 == 6, 1_000).otherwise(10).alias("declared"))
    return listings.read_bodies(raw, 400, declared="declared").select("conv_id", "turn", "status", "ok")


JSON_BODIES_SQL = """WITH b AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text ELSE to_json({'conv_id': conv_id, 'text': text})::VARCHAR END AS body, turn % 7 = 6 AS large FROM conversations),
s AS (SELECT conv_id, turn, CASE WHEN large OR coalesce(octet_length(encode(body)), 0) > 400 THEN 413 WHEN coalesce(json_valid(body), FALSE) THEN 200 ELSE 400 END::INT AS status FROM b)
SELECT conv_id, turn, status, status = 200 AS ok FROM s"""


# ---- text and addresses --------------------------------------------------------------------------

NAMES = ["Notion", "Trello", "FlowMatic", "a+b (c)"]
NOTES = ["What a SCAM, such a liar", "it’s “fine” – mostly", "  shill  ", "plain"]
ORIGINS = ["https://app.example.com", "https://x.pages.example.com", "https://evil.example.org", "chrome-extension://abcdef"]
ALLOWED = ["https://app.example.com", "https://*.pages.example.com", "chrome-extension://*"]
ERRORS = ["Request timed out", "HTTP 401 bad", "rate_limit hit", "HTTP 503 down", "no JSON here", "socket closed"]
FAILED = ["api_disabled", "http_500", "http_429", "http_418", "network", "odd_one", "quota_exceeded"]
LICENCES = ['{"valid": true, "license_key": {"status": "active"}, "meta": {"product_id": 7}}', '{"valid": true, "meta": {"product_id": 8}}', '{"valid": false, "error": "license_key not found"}', '{"valid": false, "license_key": {"status": "expired"}}', '{"valid": false, "error": "This license has reached the activation limit."}', '{"activated": true, "license_key": {"status": "disabled"}}', None]
KEYS = ["ABCD-1234-EFGH-5678", "short", "0f8fad5b-d9cb-469f-a165-70867728950e", "no key here at all!"]


def _of(items: list, d: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x).cast("string") for x in items]), (d % len(items) + 1).cast("int"))


def _urls(d: Column) -> Column:
    s = d.cast("string")
    made = [F.concat(F.lit("https://www.reddit.com/r/x_1/comments/a"), s, F.lit("/t/?x=1")), F.concat(F.lit("http://old.reddit.com/user/me-2/comments/b"), s), F.concat(F.lit("/r/Abc/comments/c"), s), F.lit("https://example.com/r/x/comments/1"), F.lit("not an address"), F.concat(F.lit("https://new.reddit.com/r/x/comments/d"), s, F.lit(".json?limit=3"))]
    return F.element_at(F.array(*made), (d % 6 + 1).cast("int"))


def text_tools(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    name, note = _of(NAMES, i), _of(NOTES, i)
    text = F.concat(F.left("text", F.lit(60)), F.lit(" Then a+b (c) met Notion, and notion again."))
    df = _read(spark, d, "documents").select("doc_id", _urls(i).alias("u"), name.alias("name"), note.alias("note"), text.alias("t"), _of(KEYS, i).alias("k"))
    licence = feed.licence_check(_of(LICENCES, i), 7)
    age = F.lit(float(AS_OF)) - (i * 40_000)
    return df.select(
        "doc_id", listings.permalink_path(F.col("u")).alias("path"), listings.data_api_url(F.col("u")).alias("api"), X.is_familiar(F.col("name")).alias("familiar"), X.count_matches(F.col("t"), "(?i)notion").alias("times"), F.regexp_like("t", X.literal(F.col("name"))).alias("there"),
        X.first_match(F.col("t"), F.col("t"), "(?i)met [a-z]+").alias("first"), F.round(X.position(F.col("t"), "(?i)notion"), 6).alias("position"), X.days_ago(age, F.lit(float(AS_OF))).alias("ago"), X.normalize_for_match(F.col("note")).alias("match"), X.sanitize_note(F.col("note")).alias("clean"),
        X.origin_allowed(_of(ORIGINS, i), ALLOWED).alias("origin"), limits.is_install_id(F.col("k")).alias("install"), limits.is_license_key(F.col("k")).alias("licence"), history.permalink(F.when(i % 3 == 0, F.col("u"))).alias("link"), history.bare_id(F.concat(F.lit("T3_A"), i.cast("string"))).alias("bare"),
        X.disclosure_label(_of(["clear", "unclear", "missing", "unknown"], i)).alias("openness"), X.confidence_label(_of(["low", "medium", "high"], i)).alias("sure"), X.ring_state(i % 101, _of(["clear", "missing"], i)).alias("ring"), feed.describe_failure(_of(FAILED, i)).alias("failure"), feed.model_failure(_of(ERRORS, i)).alias("error"),
        licence["valid"].alias("paid"), licence["reason"].alias("unpaid"), listings.status_reason(_of(["200", "429", "403", "404", "500", None], i).cast("int")).alias("status"),
    )


def _case(items: list, values: list) -> str:
    return f"CASE doc_id % {len(items)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


_Q = lambda *x: list(map(quote, x))
TEXT_TOOLS_SQL = f"""WITH a AS (SELECT doc_id, left(text, 60) || ' Then a+b (c) met Notion, and notion again.' AS t, {_case([0] * 6, ["'https://www.reddit.com/r/x_1/comments/a' || doc_id || '/t/?x=1'", "'http://old.reddit.com/user/me-2/comments/b' || doc_id", "'/r/Abc/comments/c' || doc_id", "'https://example.com/r/x/comments/1'", "'not an address'", "'https://new.reddit.com/r/x/comments/d' || doc_id || '.json?limit=3'"])} AS u FROM documents),
b AS (SELECT *, floor(doc_id * 40000 / 86400.0 + 0.5)::BIGINT AS days FROM a)
SELECT doc_id, {_case([0] * 6, ["'/r/x_1/comments/a' || doc_id", "'/user/me-2/comments/b' || doc_id", "'/r/Abc/comments/c' || doc_id", "NULL", "NULL", "'/r/x/comments/d' || doc_id"])} AS path,
  {_case([0] * 6, ["'https://oauth.reddit.com/r/x_1/comments/a' || doc_id || '/t/?x=1'", "'https://oauth.reddit.com/user/me-2/comments/b' || doc_id", "u", "u", "u", "'https://oauth.reddit.com/r/x/comments/d' || doc_id || '?limit=3'"])} AS api,
  doc_id % 4 < 2 AS familiar, len(regexp_extract_all(t, '(?i)notion'))::INT AS times, {_case(NAMES, ["contains(t, 'Notion')", "contains(t, 'Trello')", "contains(t, 'FlowMatic')", "contains(t, 'a+b (c)')"])} AS there, 'met Notion' AS first, round((length(regexp_extract(t, '(?is)^(.*?)notion', 1)) / length(t))::DOUBLE, 6) AS position,
  CASE WHEN days = 0 THEN 'today' WHEN days = 1 THEN '1 day ago' WHEN days < 60 THEN days || ' days ago' ELSE floor(days / 30 + 0.5)::BIGINT || ' months ago' END AS ago, {_case(NOTES, _Q("what a scam, such a liar", "it's \"fine\" - mostly", "shill", "plain"))} AS match, {_case(NOTES, _Q("What a promotional, such a promotional", "it’s “fine” – mostly", "promotional", "plain"))} AS clean,
  doc_id % 4 <> 2 AS origin, doc_id % 4 = 2 AS install, doc_id % 4 IN (0, 2) AS licence, CASE WHEN doc_id % 3 = 0 THEN {_case([0] * 6, ["u", "u", "'https://www.reddit.com' || u", "u", "'https://www.reddit.com/' || u", "u"])} END AS link, 'a' || doc_id AS bare,
  {_case([0] * 4, _Q("Connection disclosed by author", "Connection mentioned but unclear", "Connection not disclosed", "No connection to disclose detected"))} AS openness, {_case([0] * 3, _Q("Low confidence", "Medium confidence", "High confidence"))} AS sure,
  CASE WHEN doc_id % 101 < 40 THEN 'green' WHEN doc_id % 2 = 0 THEN 'blue' WHEN doc_id % 101 < 60 THEN 'amber' ELSE 'red' END AS ring,
  {_case(FAILED, _Q("deeper analysis is switched off", "the API reported a server error", "the API is rate limited", "the API answered http 418", "the API is not running or not reachable", "odd one", "this month's included analyses are used up; upgrade to Plus or add your own key in the popup"))} AS failure, {_case(ERRORS, _Q("timeout", "bad_key", "http_429", "http_503", "invalid_response", "unreachable"))} AS error,
  doc_id % 7 = 0 AS paid, {_case(LICENCES, _Q(None, "wrong_product", "not_found", "expired", "limit_reached", "inactive", "provider_error"))} AS unpaid, {_case([0] * 6, _Q(None, "rate_limited", "forbidden", "not_found", "http_500", "fetch_failed"))} AS status FROM b"""


def content_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key of each post's content, and which posts an earlier result answers."""
    keyed = cache.with_key(posts(spark, d)).select("doc_id", "contentHash")
    old = keyed.where("doc_id % 3 = 0").select("contentHash").distinct()
    return cache.known(keyed, old).select("doc_id", "contentHash", F.lit(True).alias("known")).unionByName(cache.unknown(keyed, old).select("doc_id", "contentHash", F.lit(False).alias("known")))


_FNV = lambda seed: f"format('{{:08x}}', list_reduce(list_prepend({seed}::BIGINT, list_transform(string_split(content, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295))"
CONTENT_KEYS_SQL = f"""WITH {POSTS_SQL},
talk AS (SELECT doc_id, string_agg(CASE WHEN (doc_id + j) % 11 <> 0 THEN 'c' || (doc_id + j * j) % 3 ELSE '' END || ':' || replace({as_sql_list(SAYINGS)}[CASE WHEN doc_id % 45 = 30 THEN 9 ELSE doc_id // 3 * 5 + j * (doc_id // 9 % 4) END % {len(SAYINGS)} + 1], 'LINK', coalesce(link, 'https://other.example/x')), '' ORDER BY j) AS said FROM posts, range(0, 7) r(j) WHERE j < doc_id % 8 GROUP BY doc_id),
c AS (SELECT doc_id, concat_ws(' ', 'v2', CASE WHEN doc_id % 5 = 0 THEN 'h:none' WHEN doc_id % 5 = 1 THEN 'h:0:{AS_OF * 1000}:0:0' ELSE 'h:1:{AS_OF * 1000}:' || doc_id // 5 % 13 || ':' || doc_id // 7 % 8 END, doc_id, p.title, p.body0, coalesce(p.author, ''), coalesce(lang, ''), coalesce(p.link, ''), CASE WHEN doc_id % 6 = 1 THEN 'www.Example' || doc_id % 3 || '.io|reddit.com' ELSE '' END, CASE WHEN detail THEN 'detail' ELSE 'feed' END, coalesce(said, '')) AS content FROM posts p JOIN documents USING (doc_id) LEFT JOIN talk USING (doc_id))
SELECT doc_id, {_FNV(0x811C9DC5)} || {_FNV(0x9747B28C)} AS "contentHash", doc_id % 3 = 0 AS known FROM c"""


# ---- a model's claims ----------------------------------------------------------------------------


def witness_weights(spark: SparkSession, d: str) -> DataFrame:
    """The signals that a model's claims and observations make, quotes taken from the whole text."""
    i = F.col("doc_id")
    n = len(witness.ELIGIBLE)
    ids = F.array(*map(F.lit, witness.ELIGIBLE))
    at = lambda j: F.substr("text", (F.length("text") * ((i * 7 + j * 3) % 10) / 10).cast("int") + 1, F.lit(15))
    claim = lambda j: F.struct(F.element_at(ids, ((i * 11 + j * 5) % n + 1).cast("int")).alias("id"), F.when(j < 3, at(j)).otherwise("zz not there zz").alias("quote"), (((i + j * 31) % 100) / 100.0).cast("double").alias("confidence"), F.when(j == 1, "such a shill").alias("note"))
    seen = lambda j: F.struct(F.when(j % 2 == 0, at(j + 5)).otherwise("qq nowhere qq").alias("quote"), F.when((i + j) % 2 == 0, "organic").otherwise("promotional").alias("direction"), F.lit("as seen").alias("note"), (((i * 3 + j * 17) % 100) / 100.0).cast("double").alias("confidence"))
    out = F.struct(F.transform(F.sequence(F.lit(0), F.lit(3)), claim).alias("signals"), F.array().cast("array<struct<id: string, reason: string>>").alias("retract"), F.transform(F.sequence(F.lit(0), F.lit(4)), seen).alias("observations"))
    docs = _read(spark, d, "documents").select("doc_id", F.lit("Of it").alias("title"), F.col("text").alias("body"), "text")
    raw = F.concat(F.lit("```json\n"), F.to_json(out), F.lit("\n```"))
    df = conform(docs.withColumn("raw", raw)).withColumns({"signals": F.array().cast(witness.SIGNAL_LIST), "output": witness.parse_output(F.col("raw"))})
    merged = witness.merge(df).select("doc_id", "accepted", "observed", "rejected", F.explode("signals").alias("s"))
    return merged.select("doc_id", "accepted", "observed", "rejected", "s.id", F.col("s.weight").alias("weight"), F.when(F.col("s.id") != "api.llm-witness", F.col("s.explanation")).alias("note"))


def direct_results(spark: SparkSession, d: str) -> DataFrame:
    """A model's own verdicts, as JSON, made results."""
    i = F.col("doc_id")
    made = F.struct(
        (i % 101).cast("double").alias("promoLikelihood"), _of(["clear", "unclear", "missing", "unknown", "odd"], i).alias("disclosure"), F.when(i % 3 == 0, "medium").alias("undisclosedRisk"), _of(["low", "medium", "high"], i).alias("confidence"),
        F.array(F.lit("It is a scam"), F.lit("Plain words")).alias("reasons"), F.array(F.struct(F.left("text", F.lit(20)).alias("quote"), F.lit("cta.direct").alias("criterionId")), F.struct(F.lit("zz not there zz").alias("quote"), F.lit(None).cast("string").alias("criterionId"))).alias("evidence"), F.when(i % 4 == 1, "by a shill").alias("note"),
    )
    docs = _read(spark, d, "documents").where("length(trim(left(text, 20))) >= 3").select("doc_id", F.lit("Of it").alias("title"), F.col("text").alias("body"), "text")
    df = conform(docs).withColumn("output", witness.parse_direct(F.when(i % 9 == 8, "no answer").otherwise(F.to_json(made))))
    r = witness.direct_result(df)
    return r.select("doc_id", F.col("promoLikelihood").cast("double").alias("score"), "label", "disclosure", F.col("undisclosedRisk").alias("risk"), "confidence", F.array_join("reasons", "|").alias("reasons"), F.size("signals").cast("double").alias("signals"), F.element_at("signals", -1)["explanation"].alias("note"))


DIRECT_SQL = """WITH a AS (SELECT doc_id, doc_id % 9 <> 8 AND doc_id % 5 <> 4 AS ok, doc_id % 101 AS score, ['clear', 'unclear', 'missing', 'unknown', 'odd'][doc_id % 5 + 1] AS disclosure, contains(trim(regexp_replace(lower('Of it' || chr(10) || text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(left(text, 20)), '\\s+', ' ', 'g'))) AS found FROM documents WHERE length(trim(left(text, 20))) >= 3)
SELECT doc_id, (CASE WHEN ok THEN score END)::DOUBLE AS score, CASE WHEN ok THEN CASE WHEN score <= 19 THEN 'Unlikely promotional' WHEN score <= 39 THEN 'Some promotional characteristics' WHEN score <= 59 THEN 'Possibly promotional' WHEN score <= 79 THEN 'Likely promotional' ELSE 'Highly likely promotional' END END AS label, CASE WHEN ok THEN disclosure END AS disclosure,
  CASE WHEN ok THEN CASE WHEN doc_id % 3 = 0 THEN 'medium' WHEN disclosure = 'clear' THEN 'low' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END END AS risk, CASE WHEN ok THEN ['low', 'medium', 'high'][doc_id % 3 + 1] END AS confidence, CASE WHEN ok THEN 'It is a promotional|Plain words' END AS reasons,
  (CASE WHEN ok THEN found::INT + 1 END)::DOUBLE AS signals, CASE WHEN ok THEN 'EXPERIMENTAL: score produced directly by a language model (model); ' || found::INT || ' quote(s) verified, ' || (2 - found::INT) || ' could not be found in the post' || CASE WHEN doc_id % 4 = 1 THEN '. Model note: by a promotional' ELSE '' END END AS note FROM a"""


def _weights_sql() -> str:
    from ..functions import fixed as P

    lit = lambda v: "NULL" if v is None else str(v)
    crit = ", ".join(f"({quote(r[0])}, {float(r[3])}, {lit(r[4])}, {quote(r[5])})" for r in P.CRITERIA)
    norm = lambda x: f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"
    at = lambda j: f"substr(text, floor(length(text) * ((doc_id * 7 + ({j}) * 3) % 10) / 10)::INT + 1, 15)"
    n = len(witness.ELIGIBLE)
    return f"""WITH crit(id, weight, top, description) AS (VALUES {crit}), d AS (SELECT doc_id, text, {norm("'Of it' || chr(10) || text")} AS hay FROM documents),
c AS (SELECT doc_id, hay, j, {as_sql_list(witness.ELIGIBLE)}[(doc_id * 11 + j * 5) % {n} + 1] AS id, CASE WHEN j < 3 THEN {at("j")} ELSE 'zz not there zz' END AS quote, (doc_id + j * 31) % 100 / 100.0 AS sure, j = 1 AS noted FROM d, range(4) t(j)),
o AS (SELECT doc_id, hay, j, CASE WHEN j % 2 = 0 THEN {at("j + 5")} ELSE 'qq nowhere qq' END AS quote, (doc_id + j) % 2 = 0 AS organic, (doc_id * 3 + j * 17) % 100 / 100.0 AS sure FROM d, range(5) t(j)),
ok AS (SELECT doc_id, bool_and(length(quote) BETWEEN 3 AND 240) AS ok FROM (SELECT doc_id, quote FROM c UNION ALL SELECT doc_id, quote FROM o) GROUP BY doc_id),
c1 AS (SELECT c.*, contains(hay, {norm("quote")}) AS good FROM c JOIN ok USING (doc_id) WHERE ok AND sure >= 0.6),
c2 AS (SELECT *, bool_or(good) OVER (PARTITION BY doc_id, id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had FROM c1),
c3 AS (SELECT * FROM c2 WHERE NOT coalesce(had, FALSE)),
o1 AS (SELECT o.*, contains(hay, {norm("quote")}) AS good FROM o JOIN ok USING (doc_id) WHERE ok AND sure >= 0.6),
o2 AS (SELECT *, coalesce(sum(good::INT) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o1),
t AS (SELECT doc_id, coalesce(a, 0)::INT AS accepted, coalesce(b, 0)::INT AS observed, (coalesce(x, 0) + coalesce(y, 0))::INT AS rejected FROM (SELECT doc_id FROM ok WHERE ok) LEFT JOIN (SELECT doc_id, count(*) FILTER (good) AS a, count(*) FILTER (NOT good) AS x FROM c3 GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) FILTER (good AND before < 3) AS b, count(*) FILTER (NOT good AND before < 3) AS y FROM o2 GROUP BY doc_id) USING (doc_id)),
s AS (SELECT doc_id, c3.id, least(floor(weight * CASE WHEN sure >= 0.85 THEN 1.0 ELSE 0.6 END + 0.5), coalesce(top, 1e9)) AS weight, CASE WHEN noted THEN 'such a promotional' ELSE description END AS note FROM c3 JOIN crit USING (id) WHERE good
  UNION ALL SELECT doc_id, 'model.observation', CASE WHEN organic THEN -8 ELSE 8 END, 'Model observation: as seen' FROM o2 WHERE good AND before < 3 UNION ALL SELECT doc_id, 'api.llm-witness', 0, NULL FROM t)
SELECT doc_id, accepted, observed, rejected, id, weight::DOUBLE AS weight, note FROM s JOIN t USING (doc_id)"""


# ---- stores ----------------------------------------------------------------------------------------


def quota_records(spark: SparkSession, d: str) -> DataFrame:
    """What a quota store holds of each install after all events, and whether it still does at the end of 2024's first quarter."""
    u = F.col("user_id")
    r = _read(spark, d, "events").select(u.alias("install"), "ts", F.when(u % 4 == 0, "plus").otherwise("free").alias("plan"), (F.col("event_id") % 7 == 0).alias("failed"), F.when(u % 4 == 0, "key").alias("licence"))
    records = limits.quota_store(r)
    last = records.agg(F.max("last").alias("end"))
    kept = limits.stored(records.crossJoin(F.broadcast(last)), F.expr("end + interval 60 days")).select(F.col("install").alias("i"), F.lit(True).alias("kept"))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + x)
    return records.join(kept, F.col("install") == F.col("i"), "left").select("install", "first_month", "licence", total("months").alias("used"), total("plus_months").alias("plus"), F.size("months").alias("months"), F.coalesce("kept", F.lit(False)).alias("kept"))


QUOTA_RECORDS_SQL = """WITH e AS (SELECT user_id AS install, ts, user_id % 4 = 0 AS plus, strftime(ts, '%Y-%m') AS month, (event_id % 7 <> 0)::BIGINT AS kept FROM events),
m AS (SELECT install, plus, month, sum(kept) AS used, max(ts) AS last FROM e GROUP BY ALL)
SELECT install, min(month) AS first_month, CASE WHEN bool_or(plus) THEN 'key' END AS licence, coalesce(sum(used) FILTER (NOT plus), 0)::BIGINT AS used, coalesce(sum(used) FILTER (plus), 0)::BIGINT AS plus, (count(*) FILTER (NOT plus AND used > 0))::INT AS months, bool_or(plus) OR max(last) + INTERVAL 70 DAY > (SELECT max(ts) FROM events) + INTERVAL 60 DAY AS kept FROM m GROUP BY install"""


def licence_plans(spark: SparkSession, d: str) -> DataFrame:
    """The plan of each event by the licence checks of other events."""
    e = _read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("licence"), F.unix_millis(F.col("ts").cast("timestamp")).alias("now"))
    status = F.when(F.col("seq") % 5 == 0, "provider_error").when(F.col("seq") % 3 == 0, "valid").otherwise("expired")
    checks = e.where("seq % 2 = 0").select("licence", F.col("now").alias("at"), status.alias("status"), "seq").drop("seq")
    return limits.plans_at(e, checks).select("seq", "plan")


LICENCE_PLANS_SQL = """WITH e AS (SELECT event_id AS seq, user_id, epoch_us(ts) // 1000 AS now FROM events), c AS (SELECT user_id, now AS made, seq % 3 = 0 AS valid FROM e WHERE seq % 2 = 0 AND seq % 5 <> 0),
j AS (SELECT e.seq, arg_max(valid, made) AS valid FROM e LEFT JOIN c ON c.user_id = e.user_id AND c.made <= e.now AND c.made + 21600000 > e.now GROUP BY e.seq)
SELECT seq, CASE WHEN valid THEN 'plus' ELSE 'free' END AS plan FROM j"""


def result_cache(spark: SparkSession, d: str) -> DataFrame:
    """A cache of results by content after the events' results are put in: the newest 100 that are fresh."""
    e = _read(spark, d, "events").select((F.col("event_id") % 400).cast("string").alias("contentHash"), F.unix_millis(F.col("ts").cast("timestamp")).alias("stored_at"), F.col("event_id").alias("result"))
    last = e.agg(F.max("stored_at").alias("m")).first()["m"] or 0
    return cache.stored(e.where("result % 2 = 0"), e.where("result % 2 = 1"), F.lit(last), 3 * 86_400_000, 100)


RESULT_CACHE_SQL = """WITH e AS (SELECT (event_id % 400)::VARCHAR AS "contentHash", epoch_us(ts) // 1000 AS stored_at, event_id AS result FROM events), n AS (SELECT "contentHash", max(stored_at) AS stored_at, arg_max(result, stored_at) AS result FROM e GROUP BY ALL)
SELECT * FROM n WHERE stored_at + 259200000 > (SELECT max(stored_at) FROM e) ORDER BY stored_at DESC, "contentHash" DESC LIMIT 100"""


def feed_posts(spark: SparkSession, d: str) -> DataFrame:
    """Cards with what fetched pages add."""
    i = F.col("doc_id")
    docs = _read(spark, d, "documents")
    cards = docs.select("doc_id", F.concat(F.lit("t3_"), i.cast("string")).alias("id"), F.lit("Card").alias("title"), F.lit("cut").alias("body"), (i % 3 == 0).alias("isDetailPage"), (i % 4 == 0).alias("brandAffiliateLabel"))
    post = F.struct(F.when(i % 2 == 0, F.concat(F.lit("f"), i.cast("string"))).alias("id"), F.lit("Page").alias("title"), F.col("text").alias("body"), F.lit(True).alias("isDetailPage"))
    fetched = docs.where("doc_id % 5 != 4").select(F.concat(F.lit("t3_"), i.cast("string")).alias("id"), (i % 5 < 2).alias("ok"), F.when(i % 5 == 2, "rate_limited").when(i % 5 == 3, "http_500").alias("reason"), F.when(i % 5 < 2, post).alias("post"))
    return feed.with_fetched(cards, fetched).select("doc_id", "id", "title", F.length("body").alias("length"), "isDetailPage", "brandAffiliateLabel", "ready")


FEED_SQL = """WITH a AS (SELECT *, doc_id % 3 <> 0 AND doc_id % 5 < 2 AS used FROM documents)
SELECT doc_id, CASE WHEN used AND doc_id % 2 = 0 THEN 'f' || doc_id ELSE 't3_' || doc_id END AS id, CASE WHEN used THEN 'Page' ELSE 'Card' END AS title, CASE WHEN used THEN length(text) ELSE 3 END::INT AS length, used OR doc_id % 3 = 0 AS "isDetailPage", doc_id % 4 = 0 AS "brandAffiliateLabel", NOT (doc_id % 3 <> 0 AND doc_id % 5 = 2) AS ready FROM a"""


def queue_turns(spark: SparkSession, d: str) -> DataFrame:
    """The waves in which the events' posts are analysed, by priority."""
    e = _read(spark, d, "events").select((F.col("event_id") % 700).alias("key"), (F.col("event_id") % 700 * 7 % 5).alias("priority"), F.col("event_id").alias("seq"))
    return feed.queued(e, "key", 50)


QUEUE_SQL = """WITH e AS (SELECT event_id % 700 AS key, event_id % 700 * 7 % 5 AS priority, min(event_id) AS seq FROM events GROUP BY ALL)
SELECT key, priority, seq, (row_number() OVER (ORDER BY priority DESC, seq) - 1) // 50 AS turn FROM e"""


QUERIES = {f.__name__: f for f in (json_posts, json_histories, json_bodies, text_tools, content_keys, witness_weights, direct_results, quota_records, licence_plans, result_cache, feed_posts, queue_turns)}
ORACLE_SQL = {
    "json_posts": JSON_POSTS_SQL, "json_histories": JSON_HISTORIES_SQL, "json_bodies": JSON_BODIES_SQL, "text_tools": TEXT_TOOLS_SQL, "content_keys": CONTENT_KEYS_SQL, "witness_weights": _weights_sql(), "direct_results": DIRECT_SQL, "quota_records": QUOTA_RECORDS_SQL,
    "licence_plans": LICENCE_PLANS_SQL, "result_cache": RESULT_CACHE_SQL, "feed_posts": FEED_SQL, "queue_turns": QUEUE_SQL,
}
