"""The engine's queries over the synthetic tables, and the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as P
from ..functions import text as X
from ..operators import evaluate, witness
from ..operators.catalog import criteria
from ..operators.comments import similar_pairs
from ..operators.detectors import detect
from ..operators.history import near_posts
from ..operators.scoring import analyze, score_signals
from ..operators.verdict import of_result
from ..sources.pages import extract_posts
from ..streaming import limits
from .corpus import AS_OF, POSTS_SQL, as_sql_list, posts, quote
from . import pieces
from .oracle import PRODUCT_NAMES_SQL, has, signals_sql

def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- whole posts -------------------------------------------------------------------------------


def post_scores(spark: SparkSession, d: str) -> DataFrame:
    done = analyze(posts(spark, d), F.lit(float(AS_OF))).withColumn("verdict", of_result())
    return done.select("doc_id", "promoLikelihood", "label", "disclosure", "undisclosedRisk", "confidence", F.col("reach.level").alias("reach"), F.col("verdict.kind").alias("verdict"), "verdict.headline", "reasons", F.size("signals").alias("n_signals"))


def _detected(spark: SparkSession, d: str) -> DataFrame:
    return detect(posts(spark, d), F.lit(float(AS_OF)))


def post_signals(spark: SparkSession, d: str) -> DataFrame:
    """Every signal of every post, with its weight."""
    return _detected(spark, d).select("doc_id", F.explode("signals").alias("s")).select("doc_id", "s.id", "s.weight", "s.verified")


def signal_counts(spark: SparkSession, d: str) -> DataFrame:
    return _detected(spark, d).select(F.explode("signals.id").alias("id")).groupBy("id").agg(F.count("*").alias("posts"))


def post_results(spark: SparkSession, d: str) -> DataFrame:
    """What an analysis of each post says, but for its sentences."""
    done = analyze(posts(spark, d), F.lit(float(AS_OF))).withColumn("v", of_result())
    return done.select("doc_id", F.col("promoLikelihood").alias("score"), F.col("styleOnlyCapApplied").alias("style_capped"), "label", "disclosure", F.col("undisclosedRisk").alias("risk"), "confidence", F.col("reach.level").alias("reach"), "v.kind", "v.headline", "v.technique", F.col("v.hiddenConnection").alias("hidden"))


def product_names(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.context import with_context

    return with_context(posts(spark, d)).select("doc_id", F.col("_primary.name").alias("primary"), F.coalesce(F.col("_primary.mentions"), F.lit(0)).alias("mentions"), F.size("_names").alias("names"))


# ---- scoring, on signals drawn from the catalogue by arithmetic --------------------------------

_DRAWN = 10
_PLACE = "(doc_id * 7 + j * j * 13 + j * 29) % 130"


def drawn(spark: SparkSession, d: str, n: int = _DRAWN) -> DataFrame:
    """documents with n signals each, and a post's other columns."""
    c = criteria(spark)
    s = F.struct("id", "category", F.col("description").alias("explanation"), F.col("weight").cast("double").alias("weight"), "evidenceSource", F.lit(False).alias("verified"), "affects", "strength", "correlationGroup", F.lit(None).cast("string").alias("excerpt"), F.lit(None).cast("string").alias("sourceUrl"))
    table = c.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", s.alias("s")))), lambda x: x["s"]).alias("all"))  # one row: the catalogue
    docs = posts(spark, d).drop("title", "body").crossJoin(F.broadcast(table))
    pick = lambda j: F.element_at("all", ((F.col("doc_id") * 7 + j * j * 13 + j * 29) % 130 + 1).cast("int"))
    signals = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: pick(j).withField("verified", (F.col("doc_id") + j) % 3 == 0))
    return docs.withColumn("signals", signals).drop("all")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.posts import conform

    df = drawn(spark, d)
    return score_signals(conform(df))


def signal_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", F.col("promoLikelihood").alias("score"), F.col("styleOnlyCapApplied").alias("style_capped"), "label", "disclosure", F.col("undisclosedRisk").alias("risk"), "confidence", F.col("reach.level").alias("reach"), F.col("reach.explanation").alias("reach_text"))


def category_points(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", F.explode("categoryPoints").alias("category", "points"))


def top_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", F.posexplode("reasons").alias("place", "reason"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    v = _scored(spark, d).withColumn("v", of_result())
    return v.select("doc_id", "v.kind", "v.headline", "v.technique", F.col("v.hiddenConnection").alias("hidden"))


def _values() -> str:
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else quote(v) if isinstance(v, str) else str(v)
    rows = [f"({k}, {lit(r[0])}, {lit(r[1])}, {lit(r[2])}, {float(r[3])}, {lit(r[5])}, {lit('promotion' in r[6])}, {lit(r[7])}, {lit(r[8])}, {lit(r[9])}, {lit(r[10])})" for k, r in enumerate(P.CRITERIA)]
    return "crit(seq, id, category, strength, weight, description, promo, src, verify, availability, grp) AS (VALUES " + ", ".join(rows) + ")"


_IN = lambda x: "(" + ", ".join(map(quote, x)) + ")"
_DRAWN_SQL = f"""
WITH {POSTS_SQL}, {_values()},
sig AS (SELECT doc_id, detail, j, c.*, (doc_id + j) % 3 = 0 AS verified FROM posts CROSS JOIN range({_DRAWN}) t(j) JOIN crit c ON c.seq = {_PLACE})
"""
_CHAIN_SQL = f""",
caps(category, cap) AS (VALUES {", ".join(f"({quote(k)}, {float(v)})" for k, v in P.CATEGORY_CAPS.items())}),
promoted AS (SELECT *, weight * CASE WHEN verify AND NOT verified THEN 0.25 ELSE 1 END AS w0 FROM sig WHERE promo AND weight <> 0),
weighed AS (SELECT *, CASE WHEN grp IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, grp ORDER BY abs(w0) DESC, j) > 1 THEN w0 * 0.25 ELSE w0 END AS w FROM promoted),
points AS (SELECT doc_id, category, CASE WHEN any_value(cap) >= 0 THEN least(sum(w), any_value(cap)) ELSE greatest(sum(w), any_value(cap)) END AS points FROM weighed JOIN caps USING (category) GROUP BY doc_id, category),
sums AS (SELECT doc_id, sum(CASE WHEN points >= 0 AND category IN {_IN(P.BEHAVIORAL)} THEN points ELSE 0 END) AS behavioral, sum(CASE WHEN points >= 0 AND category NOT IN {_IN(P.BEHAVIORAL)} THEN points ELSE 0 END) AS style, sum(CASE WHEN points < 0 THEN points ELSE 0 END) AS negative FROM points GROUP BY doc_id),
flags AS (SELECT doc_id, bool_or(id IN {_IN(P.SELF_CONNECTION)}) AS own, bool_or(id IN {_IN(P.ASK)}) AS asks, bool_or(id IN {_IN(P.CLEAR)}) AS clear, bool_or(id = 'disclosure.buried') AS buried, bool_or(id IN {_IN(P.UNCLEAR)}) AS unclear,
  bool_or(promo AND weight >= 8 AND category IN {_IN(P.COMMERCIAL)}) AS commercial, bool_or(id = 'community.coordinated-accusations') AS copied, list(id) AS ids,
  list(CASE id WHEN 'availability.profile-history-unavailable' THEN 'Limited evidence: author history was not available' WHEN 'availability.comments-unavailable' THEN 'Limited evidence: comments were not visible' END ORDER BY j) FILTER (id IN ('availability.profile-history-unavailable', 'availability.comments-unavailable')) AS unseen FROM sig GROUP BY doc_id),
sure AS (SELECT doc_id, sum(CASE WHEN verify AND NOT verified THEN 0.25 WHEN strength = 'very-strong' THEN 3 WHEN strength = 'strong' THEN 2 WHEN strength IN ('medium', 'counter') THEN 1 WHEN strength = 'weak' THEN 0.25 ELSE 0 END) + greatest(0, count(DISTINCT src) - 1) * 0.5 AS pts, bool_or(strength = 'very-strong' AND NOT (verify AND NOT verified)) AS strong FROM weighed GROUP BY doc_id),
raw AS (SELECT f.*, p.* EXCLUDE (doc_id), coalesce(behavioral, 0) AS bh, coalesce(style, 0) AS st, coalesce(negative, 0) AS ng, coalesce(pts, 0) AS pts, coalesce(strong, FALSE) AS strong FROM flags f JOIN posts p USING (doc_id) LEFT JOIN sums USING (doc_id) LEFT JOIN sure USING (doc_id)),
based AS (SELECT *, bh < 8 AND st > 39 AS style_capped, greatest(0, least(100, floor(CASE WHEN bh < 8 AND st > 39 THEN bh + 39 ELSE bh + st END + ng + 0.5))) AS s0 FROM raw),
scored AS (SELECT *, CAST(CASE WHEN own AND asks THEN greatest(s0, 80) ELSE s0 END AS INTEGER) AS score FROM based),
judged AS (SELECT *, CASE WHEN clear AND NOT buried THEN 'clear' WHEN clear THEN 'unclear' WHEN unclear THEN 'unclear' WHEN (commercial AND score >= 20) OR score >= 40 THEN 'missing' ELSE 'unknown' END AS disclosure,
  CASE WHEN pts < 2.5 THEN 0 WHEN pts < 6 THEN 1 WHEN NOT detail AND NOT strong THEN 1 ELSE 2 END AS c0, members >= 1000 AND members IS NOT NULL AS big, upvotes / age AS hourly, coalesce(comments, 0) AS cc FROM scored)
"""
SCORES_SQL = _DRAWN_SQL + _CHAIN_SQL
_FOUND_SQL = signals_sql(_values())
POST_SIGNALS_SQL = _FOUND_SQL + " SELECT doc_id, id, weight::DOUBLE AS weight, verified FROM sig"
SIGNAL_COUNTS_SQL = _FOUND_SQL + " SELECT id, count(*) AS posts FROM sig GROUP BY id"
SIGNAL_SCORES_SQL = (
    SCORES_SQL
    + """
SELECT doc_id, score, style_capped, CASE WHEN score <= 19 THEN 'Unlikely promotional' WHEN score <= 39 THEN 'Some promotional characteristics' WHEN score <= 59 THEN 'Possibly promotional' WHEN score <= 79 THEN 'Likely promotional' ELSE 'Highly likely promotional' END AS label, disclosure,
  CASE WHEN disclosure = 'clear' THEN 'low' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS risk,
  ['low', 'medium', 'high'][CASE WHEN copied THEN CASE WHEN c0 = 2 THEN 1 ELSE 0 END ELSE c0 END + 1] AS confidence,
  CASE WHEN big THEN CASE WHEN (upvotes * 1000.0 / members >= 2 AND upvotes >= 50) OR (cc * 1000.0 / members >= 0.5 AND cc >= 30) OR upvotes >= 5000 THEN 'high' WHEN (upvotes * 1000.0 / members >= 0.4 AND upvotes >= 15) OR (cc * 1000.0 / members >= 0.1 AND cc >= 10) OR upvotes >= 500 THEN 'medium' ELSE 'low' END
       WHEN upvotes >= 1000 OR hourly >= 150 OR cc >= 300 THEN 'high' WHEN upvotes >= 100 OR hourly >= 25 OR cc >= 50 THEN 'medium' ELSE 'low' END AS reach,
  format('{:,}', upvotes) || ' upvotes' || CASE WHEN comments IS NOT NULL THEN ' and ' || format('{:,}', comments) || ' comments' ELSE '' END || ' on a ' || CASE WHEN age < 1 THEN 'less-than-an-hour-old' WHEN age < 48 THEN CAST(floor(age + 0.5) AS BIGINT) || '-hour-old' ELSE CAST(floor(age / 24 + 0.5) AS BIGINT) || '-day-old' END || ' post'
    || CASE WHEN big THEN ' in a ' || CAST(floor(members / 1000.0 + 0.5) AS BIGINT) || 'k-member community' ELSE '' END || ' (approximate; reach is not evidence of promotion)' AS reach_text
FROM judged"""
)
CATEGORY_POINTS_SQL = SCORES_SQL + " SELECT doc_id, category, points FROM points"
TOP_REASONS_SQL = (
    SCORES_SQL
    + """,
ranked AS (SELECT w.doc_id, description, row_number() OVER (PARTITION BY w.doc_id ORDER BY CASE WHEN score < 40 AND w >= 0 THEN 1 ELSE 0 END, abs(w) DESC, j) AS r FROM weighed w JOIN judged USING (doc_id) WHERE abs(w) >= 2),
firsts AS (SELECT doc_id, description, min(r) AS r FROM ranked GROUP BY doc_id, description),
tops AS (SELECT doc_id, list(description ORDER BY r)[1:3] AS top FROM firsts GROUP BY doc_id),
filled AS (SELECT doc_id, list_concat(coalesce(top, []), CASE WHEN disclosure = 'missing' AND score >= 40 AND len(list_filter(coalesce(top, []), lambda t: regexp_matches(t, '(?i)disclos'))) = 0 THEN ['No author-product connection is disclosed'] ELSE [] END, coalesce(unseen, []))[1:3] AS reasons FROM judged LEFT JOIN tops USING (doc_id))
SELECT doc_id, CAST(i - 1 AS INTEGER) AS place, reasons[i] AS reason FROM filled, range(1, 4) t(i) WHERE i <= len(reasons)"""
)


def _verdict_sql(scores: str, more: str = "") -> str:
    from ..operators.verdict import ELSEWHERE, FRAMINGS, LATE, RECURRING, RECURS

    has = lambda x: f"list_has_any(ids, {as_sql_list(x)})"
    ladder = " ".join(f"WHEN {' AND '.join(map(has, g))} THEN " + (f"CASE WHEN disclosure = 'clear' THEN {quote(d)} ELSE {quote(p)} END" if d else quote(p)) for g, p, d in FRAMINGS)
    return (
        scores
        + f""",
v0 AS (SELECT *, list_contains(ids, 'account.self-identified-elsewhere') AND disclosure <> 'clear' AS hid, CASE {ladder} END AS framing, CASE WHEN {has(RECURRING)} THEN {quote(RECURS)} END AS recurs FROM judged),
v1 AS (SELECT *, concat_ws('; ', framing, recurs) AS rest, score < 40 AND NOT hid AS organic FROM v0),
v2 AS (SELECT *, CASE WHEN hid THEN {quote(ELSEWHERE + ".")} || CASE WHEN rest = '' THEN '' ELSE ' ' || rest || '.' END WHEN rest <> '' THEN rest || '.' END AS technique0 FROM v1)
SELECT doc_id, {more} CASE WHEN organic THEN 'organic' WHEN disclosure = 'clear' THEN 'transparent' WHEN disclosure = 'unclear' THEN 'unclear' ELSE 'undisclosed' END AS kind,
  CASE WHEN organic THEN CASE WHEN score < 20 THEN 'Looks organic' ELSE 'Mostly organic, a few promotional signals' END WHEN disclosure = 'clear' THEN 'Transparent promotion'
    WHEN disclosure = 'unclear' THEN CASE WHEN list_contains(ids, 'disclosure.buried') THEN 'Promotion, disclosed late in the post' WHEN list_contains(ids, 'disclosure.comments-only') THEN 'Promotion, disclosed only in the comments' ELSE 'Promotion with an unclear connection' END
    WHEN hid OR score >= 60 THEN 'Possible undisclosed promotion' ELSE 'Possibly promotional, connection not disclosed' END AS headline,
  CASE WHEN organic THEN NULL WHEN disclosure = 'unclear' AND list_contains(ids, 'disclosure.buried') THEN {quote(LATE + ".")} || coalesce(' ' || technique0, '') ELSE technique0 END AS technique, hid AND NOT organic AS hidden
FROM v2"""
    )


_LEVELS = """score, style_capped, CASE WHEN score <= 19 THEN 'Unlikely promotional' WHEN score <= 39 THEN 'Some promotional characteristics' WHEN score <= 59 THEN 'Possibly promotional' WHEN score <= 79 THEN 'Likely promotional' ELSE 'Highly likely promotional' END AS label, disclosure,
  CASE WHEN disclosure = 'clear' THEN 'low' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS risk,
  ['low', 'medium', 'high'][CASE WHEN copied THEN CASE WHEN c0 = 2 THEN 1 ELSE 0 END ELSE c0 END + 1] AS confidence,
  CASE WHEN big THEN CASE WHEN (upvotes * 1000.0 / members >= 2 AND upvotes >= 50) OR (cc * 1000.0 / members >= 0.5 AND cc >= 30) OR upvotes >= 5000 THEN 'high' WHEN (upvotes * 1000.0 / members >= 0.4 AND upvotes >= 15) OR (cc * 1000.0 / members >= 0.1 AND cc >= 10) OR upvotes >= 500 THEN 'medium' ELSE 'low' END
       WHEN upvotes >= 1000 OR hourly >= 150 OR cc >= 300 THEN 'high' WHEN upvotes >= 100 OR hourly >= 25 OR cc >= 50 THEN 'medium' ELSE 'low' END AS reach, """
VERDICTS_SQL = _verdict_sql(SCORES_SQL)
POST_RESULTS_SQL = _verdict_sql(_FOUND_SQL + _CHAIN_SQL, _LEVELS)


# ---- text functions ------------------------------------------------------------------------------


def text_stats(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _read(spark, d, "documents").select("doc_id", X.word_count(t).cast("long").alias("words"), F.size(X.split_sentences(t)).cast("long").alias("sentences"), X.count_matches(t, "[A-Z]").cast("long").alias("capitals"), F.size(X.extract_urls(t)).cast("long").alias("urls"))


TEXT_STATS_SQL = """SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words,
  len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s, E' \\t\\r\\n') <> '')) AS sentences,
  len(regexp_extract_all(text, '[A-Z]')) AS capitals, len(regexp_extract_all(text, '(?i)\\bhttps?://[^\\s<>()"'']+')) AS urls FROM documents"""


def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    u, h = F.col("url"), F.col("host")
    df = _read(spark, d, "pages").withColumn("host", X.host_of(u))
    return df.select("page_id", "host", X.host_label(h).alias("label"), X.first_label(h).alias("first_label"), X.is_product_host(h).alias("product"), (u.rlike(P.AFFILIATE_PARAM) | u.rlike(P.AFFILIATE_PATH)).alias("tracked"), h.isin(P.REDIRECT_HOSTS).alias("redirect"))


URL_HOSTS_SQL = f"""WITH h AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages), s AS (SELECT *, string_split(host, '.') AS p FROM h)
SELECT page_id, host, CASE WHEN len(p) < 2 THEN p[1] WHEN p[-2] IN ('co', 'com', 'org', 'net') AND len(p) >= 3 THEN p[-3] ELSE p[-2] END AS label, p[1] AS first_label,
  NOT list_contains({as_sql_list(P.NON_PRODUCT_HOSTS)}, host) AND NOT ends_with(host, '.reddit.com') AS product, {has(P.AFFILIATE_PARAM, "url")} OR {has(P.AFFILIATE_PATH, "url")} AS tracked, list_contains({as_sql_list(P.REDIRECT_HOSTS)}, host) AS redirect FROM s"""


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pages").select("page_id", X.fnv_hash(F.col("url")).alias("hash"))


_FNV = lambda seed: f"format('{{:08x}}', list_reduce(list_prepend({seed}::BIGINT, list_transform(string_split(url, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295))"
CONTENT_HASH_SQL = f"SELECT page_id, {_FNV(0x811C9DC5)} || {_FNV(0x9747B28C)} AS hash FROM pages"


# ---- history, comments ---------------------------------------------------------------------------


#: Earlier posts of its source that a post is compared with.
BEFORE = 20


def near_duplicate_posts(spark: SparkSession, d: str) -> DataFrame:
    """Each document against those before it of its source, as a post against its author's history."""
    docs = _read(spark, d, "documents").select("doc_id", "source", F.left("text", F.lit(80)).alias("title"), F.col("text").alias("body"), F.left("text", F.lit(400)).alias("excerpt"))
    return near_posts(docs, "source", "doc_id", BEFORE).select("doc_id", F.col("other").alias("other_id"))


_SET = lambda x: f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2))"
NEAR_SQL = f"""WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, {_SET("left(text, 80)")} AS t, {_SET("left(text, 1500)")} AS b, {_SET("left(text, 400)")} AS e FROM documents WHERE source IS NOT NULL), p AS (SELECT a.doc_id, o.doc_id AS other_id, a.t AS t, a.b AS b, o.t AS t2, o.e AS e FROM d a JOIN d o ON a.source = o.source AND a.n - o.n BETWEEN 1 AND {BEFORE})
SELECT doc_id, other_id FROM p WHERE (len(t) >= 5 AND len(t2) > 0 AND len(list_intersect(t, t2)) / (len(t) + len(t2) - len(list_intersect(t, t2))) >= 0.6) OR (len(b) >= 20 AND len(e) >= 15 AND len(list_intersect(b, e)) / (len(b) + len(e) - len(list_intersect(b, e))) >= 0.6)"""


def comment_similarity(spark: SparkSession, d: str) -> DataFrame:
    turns = _read(spark, d, "conversations").where(f"text is not null and turn < {P.MAX_COMMENTS}")
    by = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    return by.select("conv_id", F.size("texts").cast("long").alias("comments"), similar_pairs(F.col("texts")).cast("long").alias("pairs"))


COMMENTS_SQL = f"""WITH c AS (SELECT row_number() OVER () AS k, conv_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: length(w) > 2)) AS w FROM conversations WHERE text IS NOT NULL AND turn < {P.MAX_COMMENTS}),
p AS (SELECT a.conv_id, count(*) AS pairs FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.k < b.k WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.7 GROUP BY a.conv_id)
SELECT conv_id, count(*) AS comments, coalesce(any_value(pairs), 0) AS pairs FROM c LEFT JOIN p USING (conv_id) GROUP BY conv_id"""


# ---- evaluation, merging --------------------------------------------------------------------------


def _cases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    y = _read(spark, d, "labels").where("doc_id is not null")
    low = F.when(F.col("quality") == 1, 0).otherwise(30)
    cases = y.select(F.col("doc_id").alias("case_id"), low.alias("low"), (low + 45).alias("high"), F.when(F.col("toxic") == 1, "missing").when(F.col("doc_id") % 2 == 0, "clear").alias("disclosure"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1).alias("invariant_with"))
    runs = y.select(F.col("doc_id").alias("case_id"), F.explode(F.array(F.lit("rules"), F.lit("model"))).alias("provider")).withColumn("r", F.explode(F.array(F.lit(0), F.lit(1))))
    c, r, m = F.col("case_id"), F.col("r"), F.when(F.col("provider") == "model", 1).otherwise(0)
    runs = runs.withColumns({"score": (c * 17 + r * 7 * m + m * 3) % 101, "disclosure": F.when((c + r) % 3 == 0, "missing").otherwise("clear"), "ms": c % 50 + m * 900, "error": F.when((c + r * 5) % 23 == 0, "timeout")})
    return cases, runs


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.summarize(*_cases(spark, d))
    return s.select("provider", *[F.round(c, 6).alias(c) for c in s.columns if c not in ("provider", "failed")], "failed")


def invariant_pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.invariant_pairs(*_cases(spark, d))


EVAL_SQL = """
WITH cases AS (SELECT doc_id AS case_id, CASE WHEN quality = 1 THEN 0 ELSE 30 END AS low, CASE WHEN quality = 1 THEN 45 ELSE 75 END AS high, CASE WHEN toxic = 1 THEN 'missing' WHEN doc_id % 2 = 0 THEN 'clear' END AS expected, CASE WHEN doc_id % 3 = 0 THEN doc_id + 1 END AS other_id FROM labels WHERE doc_id IS NOT NULL),
runs AS (SELECT case_id, provider, r, (case_id * 17 + r * 7 * m + m * 3) % 101 AS score, CASE WHEN (case_id + r) % 3 = 0 THEN 'missing' ELSE 'clear' END AS disclosure, case_id % 50 + m * 900 AS ms, (case_id + r * 5) % 23 = 0 AS bad FROM cases CROSS JOIN (VALUES ('rules', 0), ('model', 1)) v(provider, m) CROSS JOIN range(2) t(r)),
means AS (SELECT provider, case_id, avg(score) AS mean, max(score) - min(score) AS spread, count(*) AS n FROM runs WHERE NOT bad GROUP BY ALL),
pairs AS (SELECT a.provider, c.case_id, c.other_id, abs(a.mean - b.mean) AS difference, abs(a.mean - b.mean) <= 5 AS held FROM cases c JOIN means a ON a.case_id = c.case_id JOIN means b ON b.case_id = c.other_id AND b.provider = a.provider)
"""
EVAL_SUMMARY_SQL = (
    EVAL_SQL
    + """, base AS (SELECT provider, avg(CASE WHEN NOT bad THEN CASE WHEN score BETWEEN low AND high THEN 1.0 ELSE 0.0 END END) AS in_range, avg(CASE WHEN NOT bad THEN greatest(low - score, score - high, 0) END) AS mean_range_error, avg(CASE WHEN NOT bad AND expected IS NOT NULL THEN CASE WHEN disclosure = expected THEN 1.0 ELSE 0.0 END END) AS disclosure_accuracy, count(*) FILTER (bad) AS failed, avg(CASE WHEN NOT bad THEN ms END) AS mean_latency_ms FROM runs JOIN cases USING (case_id) GROUP BY provider)
SELECT provider, round(coalesce(in_range, 0)::DOUBLE, 6) AS in_range, round(coalesce(mean_range_error, 0)::DOUBLE, 6) AS mean_range_error, round(coalesce(disclosure_accuracy, 0)::DOUBLE, 6) AS disclosure_accuracy, round(coalesce((SELECT avg(spread) FROM means m WHERE m.provider = b.provider AND n >= 2), 0)::DOUBLE, 6) AS mean_spread, round(coalesce((SELECT avg(held::INT) FROM pairs p WHERE p.provider = b.provider), 1)::DOUBLE, 6) AS pairs_held, failed, round(coalesce(mean_latency_ms, 0)::DOUBLE, 6) AS mean_latency_ms FROM base b"""
)
PAIRS_SQL = EVAL_SQL + " SELECT provider, case_id, other_id, difference::DOUBLE AS difference, held FROM pairs"


def witness_merge(spark: SparkSession, d: str) -> DataFrame:
    n = len(witness.ELIGIBLE)
    df = drawn(spark, d, 3).join(_read(spark, d, "documents").select("doc_id", F.left("text", F.lit(60)).alias("title"), F.col("text").alias("body")), "doc_id")
    i = F.col("doc_id")
    ids = F.array(*map(F.lit, witness.ELIGIBLE))
    claim = lambda j: F.struct(F.element_at(ids, ((i * 5 + j * 17) % n + 1).cast("int")).alias("id"), F.when(j % 3 < 2, F.substr("body", (i * 3 + j * 11) % 40 + 1, F.lit(12))).otherwise("zz not there zz").alias("quote"), ((i * 13 + j * 7) % 100 / 100.0).cast("double").alias("confidence"), F.lit(None).cast("string").alias("note"))
    out = F.struct(F.transform(F.sequence(F.lit(0), F.lit(3)), claim).alias("signals"), F.array(F.struct(F.element_at("signals", 1)["id"].alias("id"), F.lit(None).cast("string").alias("reason"))).alias("retract"), F.array().cast("array<struct<quote: string, direction: string, note: string, confidence: double>>").alias("observations"))
    from ..operators.posts import conform

    return witness.merge(conform(df).withColumn("output", out)).select("doc_id", "accepted", "rejected", "retracted", F.size("signals").alias("signals"))


_NORM = lambda x: f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"
WITNESS_SQL = f"""
WITH {_values()}, rules AS (SELECT doc_id, j, c.* FROM documents CROSS JOIN range(3) t(j) JOIN crit c ON c.seq = {_PLACE}),
gone AS (SELECT DISTINCT r.doc_id, r.id FROM rules r JOIN rules f ON f.doc_id = r.doc_id AND f.j = 0 AND f.id = r.id WHERE r.category IN {_IN(P.RETRACTABLE)} AND r.id NOT IN {_IN(P.NEVER_RETRACT)} AND r.weight > 0),
claims AS (SELECT doc_id, j, {as_sql_list(witness.ELIGIBLE)}[(doc_id * 5 + j * 17) % {len(witness.ELIGIBLE)} + 1] AS id, CASE WHEN j % 3 < 2 THEN substr(text, (doc_id * 3 + j * 11) % 40 + 1, 12) ELSE 'zz not there zz' END AS quote, (doc_id * 13 + j * 7) % 100 / 100.0 AS confidence, {_NORM("left(text, 60) || chr(10) || text")} AS hay FROM documents CROSS JOIN range(4) t(j)),
tried AS (SELECT c.doc_id, contains(hay, {_NORM("quote")}) AS ok FROM claims c WHERE confidence >= 0.6 AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.doc_id = c.doc_id AND r.id = c.id)),
tally AS (SELECT doc_id, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected FROM tried GROUP BY doc_id),
kept AS (SELECT r.doc_id, count(*) FILTER (g.id IS NULL) AS kept, count(DISTINCT g.id) AS retracted FROM rules r LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.id = r.id GROUP BY r.doc_id)
SELECT doc_id, coalesce(accepted, 0)::INT AS accepted, coalesce(rejected, 0)::INT AS rejected, retracted::INT AS retracted, (kept + coalesce(accepted, 0) + 1)::INT AS signals FROM kept LEFT JOIN tally USING (doc_id)"""


# ---- limits ----------------------------------------------------------------------------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "events")


def quota_usage(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select(F.col("user_id").alias("install"), "ts", F.col("event_id").alias("seq"), F.when(F.col("user_id") % 4 == 0, "plus").otherwise("free").alias("plan"))
    q = limits.quota(e, 20, 5, 30)
    return q.groupBy("install", "plan", "month").agg(F.count("*").alias("requests"), F.sum(F.col("allowed").cast("long")).alias("allowed"), F.max("allowance").alias("allowance"), F.max("resets_at").cast("date").alias("resets_at"))


QUOTA_SQL = """
WITH e AS (SELECT user_id AS install, ts, event_id, CASE WHEN user_id % 4 = 0 THEN 'plus' ELSE 'free' END AS plan, strftime(ts, '%Y-%m') AS month, min(strftime(ts, '%Y-%m')) OVER (PARTITION BY user_id) AS first FROM events),
r AS (SELECT *, CASE WHEN plan = 'plus' THEN 30 WHEN month = first THEN 20 ELSE 5 END AS allowance, row_number() OVER (PARTITION BY install, plan, month ORDER BY ts, event_id) AS n FROM e)
SELECT install, plan, month, count(*) AS requests, count(*) FILTER (n <= allowance) AS allowed, max(allowance) AS allowance, max(date_trunc('month', ts) + INTERVAL 1 MONTH)::DATE AS resets_at FROM r GROUP BY install, plan, month"""


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return limits.debounced(_events(spark, d), "user_id", "ts", "30 minutes")


SESSIONS_SQL = """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS events FROM b GROUP BY user_id, s"""


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select(F.concat(F.lit("u"), "user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("now"), F.col("event_id").alias("seq"))


def rate_limits(spark: SparkSession, d: str) -> DataFrame:
    return limits.rate_limit(_timed(spark, d), 2, window=6 * 3_600_000)


def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    return limits.ttl_cache(_timed(spark, d), 24 * 3_600_000)


_TIMED_SQL = """WITH RECURSIVE e AS (SELECT 'u' || user_id AS key, epoch_us(ts) // 1000 AS now, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""
RATE_SQL = (
    _TIMED_SQL
    + """, run AS (SELECT key, now, seq, n, [now] AS kept, TRUE AS allowed, 0::BIGINT AS wait FROM e WHERE n = 1
UNION ALL SELECT key, now, seq, n, CASE WHEN len(live) >= 2 THEN live ELSE list_append(live, now) END, len(live) < 2, CASE WHEN len(live) >= 2 THEN live[1] + 21600000 - now ELSE 0 END FROM (SELECT e.*, list_filter(run.kept, lambda t: t > e.now - 21600000) AS live FROM run JOIN e ON e.key = run.key AND e.n = run.n + 1))
SELECT key, now, seq, allowed, wait::BIGINT AS retry_after_ms FROM run"""
)
CACHE_SQL = (
    _TIMED_SQL
    + """, run AS (SELECT key, now, seq, n, now AS stored, FALSE AS hit FROM e WHERE n = 1
UNION ALL SELECT e.key, e.now, e.seq, e.n, CASE WHEN stored + 86400000 > e.now THEN stored ELSE e.now END, stored + 86400000 > e.now FROM run JOIN e ON e.key = run.key AND e.n = run.n + 1)
SELECT key, now, seq, hit FROM run"""
)


def criteria_summary(spark: SparkSession, d: str) -> DataFrame:
    return criteria(spark).groupBy("availability", "strength").agg(F.count("*").alias("criteria"), F.sum("weight").alias("weight"), F.sum(F.col("requiresVerification").cast("int")).alias("verified"))


CRITERIA_SQL = f"WITH {_values()} SELECT availability, strength, count(*) AS criteria, sum(weight)::BIGINT AS weight, sum(verify::INT)::BIGINT AS verified FROM crit GROUP BY availability, strength"


def html_posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts set into HTML from documents' columns, and read again."""
    i = F.col("doc_id").cast("string")
    html = F.concat(
        F.lit('<main><shreddit-post id="t3_'), i, F.lit('" permalink="/r/'), "lang", F.lit("/comments/"), i, F.lit('/x" post-title="A title of '), i, F.lit('" author="'), "source", F.lit('" subreddit-prefixed-name="r/'), "lang", F.lit('" score="'), F.format_number(F.col("doc_id") * 37, 0),
        F.lit('" comment-count="'), i, F.lit('" created-timestamp="2024-01-01T00:00:00Z" content-href="https://www.Example'), i, F.lit('.com/a?ref=x"><span slot="credit-bar">Brand Affiliate</span><div slot="text-body"><p>First &amp; <b>bold</b></p><p>See <a href="https://shop.example/'), i, F.lit('">this</a></p><script>no</script></div></shreddit-post></main>'),
    )
    pages = _read(spark, d, "documents").select("doc_id", html.alias("html"))
    p = extract_posts(pages, F.lit(1_704_067_200.0 + 7_200))
    return p.select("doc_id", "id", "url", "title", "body", "author", "subreddit", "upvotes", "commentsCount", "ageHours", F.array_join("links", "|").alias("links"), F.array_join("outboundDomains", "|").alias("hosts"), "brandAffiliateLabel")


HTML_SQL = """SELECT doc_id, 't3_' || doc_id AS id, 'https://www.reddit.com/r/' || lang || '/comments/' || doc_id || '/x' AS url, 'A title of ' || doc_id AS title, 'First & bold' || chr(10) || 'See this' AS body, source AS author, lang AS subreddit, doc_id * 37 AS upvotes, doc_id AS "commentsCount", 2.0::DOUBLE AS "ageHours",
  'https://shop.example/' || doc_id || '|https://www.Example' || doc_id || '.com/a?ref=x' AS links, 'shop.example|example' || doc_id || '.com' AS hosts, TRUE AS "brandAffiliateLabel" FROM documents"""

QUERIES = {
    f.__name__: f
    for f in (
        post_scores, post_signals, post_results, signal_counts, product_names, signal_scores, category_points, top_reasons, verdicts, text_stats, url_hosts, content_hash, near_duplicate_posts,
        comment_similarity, eval_summary, invariant_pairs, witness_merge, quota_usage, sessions, rate_limits, cache_hits, criteria_summary, html_posts,
    )
}
ORACLE_SQL = {
    "post_signals": POST_SIGNALS_SQL, "post_results": POST_RESULTS_SQL, "product_names": PRODUCT_NAMES_SQL, "signal_counts": SIGNAL_COUNTS_SQL, "signal_scores": SIGNAL_SCORES_SQL, "category_points": CATEGORY_POINTS_SQL, "top_reasons": TOP_REASONS_SQL, "verdicts": VERDICTS_SQL, "text_stats": TEXT_STATS_SQL,
    "url_hosts": URL_HOSTS_SQL, "content_hash": CONTENT_HASH_SQL, "near_duplicate_posts": NEAR_SQL, "comment_similarity": COMMENTS_SQL, "eval_summary": EVAL_SUMMARY_SQL, "invariant_pairs": PAIRS_SQL,
    "witness_merge": WITNESS_SQL, "quota_usage": QUOTA_SQL, "sessions": SESSIONS_SQL, "rate_limits": RATE_SQL, "cache_hits": CACHE_SQL, "criteria_summary": CRITERIA_SQL, "html_posts": HTML_SQL,
}
QUERIES |= pieces.QUERIES
ORACLE_SQL |= pieces.ORACLE_SQL
