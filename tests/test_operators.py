import json

import pytest
from pyspark.sql import functions as F

from postlens.functions import text as X
from postlens.functions.gate import literals
from postlens.functions.names import candidates
from postlens.operators import evaluate, witness
from postlens.operators.catalog import criteria, criterion
from postlens.operators.posts import POST
from postlens.operators.scoring import analyze
from postlens.sources import listings
from postlens.sources.pages import parse_integer, parse_page
from postlens.streaming import limits


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_text(spark):
    t = F.col("t")
    assert one(spark, X.extract_urls(t), t="at https://a.b/c?d=1). and http://x.y/z!") == ["https://a.b/c?d=1", "http://x.y/z"]
    assert one(spark, X.host_of(t), t="HTTPS://u@WWW.Shop.Example:8080/p") == "shop.example"
    assert one(spark, X.host_of(t), t="no address") is None
    assert one(spark, X.host_label(t), t="shop.zorbly.co.uk") == "zorbly"
    assert one(spark, X.split_sentences(t), t="One. Two!\nThree? four") == ["One.", "Two!", "Three?", "four"]
    assert one(spark, X.fnv_hash(t), t="hello") == "4f9f2cab39d0e0ec"
    assert one(spark, X.normalize_for_match(t), t=" “It’s \n A – b” ") == "\"it's a - b\""
    assert one(spark, X.last_position(t, "b"), t="abcb") == 0.75
    assert one(spark, X.origin_allowed(t, ["https://*.a.b", "http://c"]), t="https://x.a.b") is True
    assert one(spark, X.ascii_shadow(t), t="cafés →") == "caf¤s →"


def test_names():
    assert candidates("We love FlowMatic. Then FlowMatic and flowmatic.io won.", ["flowmatic.io"])[0][0] == "FlowMatic"
    got = dict(candidates("I used Tensor Space daily. Tensor Space is fine. The Monday plan.", []))
    assert got == {"Tensor Space": 2}


def test_gate_is_necessary():
    import re

    from postlens.functions import fixed

    said = ["Join the waitlist", "wait list soon", "use CODE and promo code", "DM me now", "i'll dm you", "Game-changer!", "it has downsides", "I work for a company", "my friend built it", "sign up today", "Buy it"]
    for name in ("WAITLIST", "COUPON", "DM", "HYPE", "LIMITATION", "CLEAR_EMPLOYMENT", "FRIENDS_PRODUCT", "CTA"):
        pattern = getattr(fixed, name)
        needed = literals(pattern)
        for text in said:
            if needed and re.search(pattern, text, re.A):
                assert any(x in text.lower() for x in needed), (name, text)
    assert set(literals(r"(?i)\b(?:wait ?list|early access)\b")) == {"wait", "early access"}
    assert literals(r"(?i)[a-z]+") == ()


def test_catalog(spark):
    assert criteria(spark).count() == 130
    assert criteria(spark, "local").count() == 57
    with pytest.raises(KeyError):
        criterion("no.such")


def merged(spark, output, **post):
    rows = [json.dumps({"title": "A quiet note", "body": "You can buy now. It saves time, a lot of it.", **post})]
    df = analyze(spark.read.schema(POST).json(spark.sparkContext.parallelize(rows, 1)), F.lit(1.7e9))
    return witness.rescore(df.drop("disclosure", "label", "reach").withColumn("raw", F.lit(output)).withColumn("output", witness.parse_output(F.col("raw")))).first()


def test_witness(spark):
    out = {
        "signals": [{"id": "story.testimonial", "quote": "It SAVES  time", "confidence": 0.7, "note": "a shill note"}, {"id": "lang.slogans", "quote": "not there at all", "confidence": 0.9}, {"id": "cta.direct", "quote": "buy now", "confidence": 0.9}, {"id": "link.affiliate-params", "quote": "buy now", "confidence": 0.9}, {"id": "lang.hype-phrases", "quote": "buy now", "confidence": 0.5}],
        "retract": [{"id": "cta.direct"}, {"id": "counter.no-cta"}],
        "observations": [{"quote": "a lot of it", "direction": "organic", "note": "plain words", "confidence": 0.9}],
    }
    r = merged(spark, "```json\n" + json.dumps(out) + "\n```")
    ids = {s.id: s for s in r.signals}
    assert (r.accepted, r.observed, r.rejected, r.retracted) == (1, 1, 1, 1)
    assert ids["story.testimonial"].weight == 6 and ids["story.testimonial"].explanation == "a promotional note"
    assert ids["model.observation"].weight == -8 and "cta.direct" not in ids and "api.llm-witness" in ids and r.source == "api"
    r = merged(spark, "no json")
    assert r.output is None and {s.id for s in r.signals} >= {"cta.direct"}


def test_evaluation(spark):
    cases = spark.createDataFrame([("a", 0, 20, "clear", None), ("b", 10, 30, None, "a")], "case_id string, low int, high int, disclosure string, invariant_with string")
    runs = spark.createDataFrame([("p", "a", 10, "clear", 5, None), ("p", "a", 30, "missing", 7, None), ("p", "b", 20, "clear", 9, None), ("p", "b", None, None, 9, "timeout")], "provider string, case_id string, score int, disclosure string, ms int, error string")
    r = evaluate.summarize(cases, runs).first()
    assert (r.in_range, r.mean_range_error, r.disclosure_accuracy, r.mean_spread, r.pairs_held, r.failed) == (pytest.approx(2 / 3), pytest.approx(10 / 3), 0.5, 20.0, 1.0, 1)
    assert evaluate.duplicate_cases(cases.union(cases)).count() == 2


def test_rate_limit(spark):
    e = spark.createDataFrame([("k", t, i) for i, t in enumerate([0, 10, 20, 60_000, 60_011])], "key string, now long, seq long")
    got = [(r.allowed, r.retry_after_ms) for r in limits.rate_limit(e, 2).orderBy("seq").collect()]
    assert got == [(True, 0), (True, 0), (False, 59_980), (True, 0), (True, 0)]


def test_rate_limit_stream(spark, tmp_path):
    spark.createDataFrame([("k", t, i) for i, t in enumerate([0, 10, 20])], "key string, now long, seq long").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("key string, now long, seq long").parquet(f"{tmp_path}/in")
    q = limits.rate_limit_stream(s, 2).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.allowed for r in spark.table("limited").orderBy("seq").collect()] == [True, True, False]


def test_caches(spark):
    e = spark.createDataFrame([("k", t, i) for i, t in enumerate([0, 1499, 1500, 2999])], "key string, now long, seq long")
    assert [r.hit for r in limits.ttl_cache(e, 1500).orderBy("seq").collect()] == [False, True, False, True]
    kept = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, stored_at long")
    assert {r.key for r in limits.within_capacity(kept, 2).collect()} == {"b", "c"}
    assert limits.fresh(kept, F.lit(12), 10).count() == 1


def test_quota(spark):
    rows = [("i", f"2024-01-{d:02d} 00:00:00", d, "free", d == 1) for d in range(1, 5)] + [("i", "2024-02-01 00:00:00", 9, "free", False), ("i", "2024-02-02 00:00:00", 10, "free", False)]
    e = spark.createDataFrame(rows, "install string, ts string, seq long, plan string, failed boolean").withColumn("ts", F.to_timestamp("ts"))
    assert [r.allowed for r in limits.quota(e, 3, 1).orderBy("seq").collect()] == [True, True, True, False, True, False]
    assert [r.allowed for r in limits.quota_with_refunds(e, 3, 1).orderBy("seq").collect()] == [True, True, True, True, True, False]


def test_listings(spark):
    comment = lambda who, text, *replies: {"kind": "t1", "data": {"author": who, "body": text, "replies": {"data": {"children": list(replies)}} if replies else ""}}
    tree = [comment("u", "one", comment("me", "two", comment("v", "three", comment("w", "too deep")))), {"kind": "more"}, comment("x", "[deleted]"), comment("y", "four")]
    body = [{"data": {"children": [{"kind": "t3", "data": {"name": "t3_1", "title": "T", "selftext": "see https://a.b/c", "author": "me", "subreddit": "s", "score": 5, "num_comments": 2, "created_utc": 0, "permalink": "/r/s/comments/1", "url": "https://z.example/q", "is_self": False, "subreddit_subscribers": 9}}]}}, {"data": {"children": tree}}]
    df = spark.createDataFrame([(json.dumps(body), 200), ("{", 200), ("", 429), (None, None)], "body string, status int")
    a, b, c, d = listings.read_posts(df, F.lit(7200.0)).collect()
    assert a.ok and a.post.title == "T" and a.post.links == ["https://z.example/q", "https://a.b/c"] and a.post.ageHours == 2.0
    assert [(x.text, x.depth, x.isOp) for x in a.post.visibleComments] == [("one", 0, False), ("two", 1, True), ("three", 2, False), ("four", 0, False)]
    assert (b.reason, c.reason, d.reason) == ("malformed", "rate_limited", "fetch_failed")
    assert one(spark, listings.permalink_path(F.col("t")), t="https://www.reddit.com/r/abc/comments/1x2/title/") == "/r/abc/comments/1x2"
    h = spark.createDataFrame([("me", json.dumps({"data": {"created_utc": 0, "link_karma": 3}}), json.dumps({"data": {"children": [{"data": {"title": "t", "subreddit": "s"}}]}}), "{}", 200, 200, 200), ("x", None, None, None, 404, 200, 200)], "author string, about string, submitted string, comments string, about_status int, submitted_status int, comments_status int")
    a, b = (r.authorHistory for r in listings.read_histories(h, F.lit(864000.0)).collect())
    assert a.available and a.accountAgeDays == 10 and a.linkKarma == 3 and a.submissions[0].title == "t"
    assert not b.available and b.reason == "not_found"


def test_pages(spark):
    posts, comments = parse_page('<shreddit-post id="t3_x" author="me"><h1 slot="title">A  b</h1><div slot="text-body"><p>x</p><a href="/u">y</a></div></shreddit-post><shreddit-post></shreddit-post><shreddit-comment author="c" depth="2"><div slot="comment"><p>hi</p></div></shreddit-comment><shreddit-comment author="d"><div slot="comment">[removed]</div></shreddit-comment>')
    assert [(p["title"], p["body"], p["anchors"]) for p in posts] == [("A b", "x\ny", ["/u"])]
    assert comments == [{"author": "c", "text": "hi", "depth": 2}]
    assert one(spark, parse_integer(F.col("t")), t="1,2 34") == 1234


def test_content_keys(spark):
    from postlens.operators.cache import known, unknown, with_key

    posts = with_key(spark.createDataFrame([("a", "t", 5), ("a", "t", 9), ("b", "t", 5)], "id string, title string, upvotes long"))
    keys = [r.contentHash for r in posts.orderBy("id", "upvotes").collect()]
    assert keys[0] == keys[1] != keys[2] and len(keys[0]) == 16
    done = posts.where("id = 'b'").select("contentHash", F.lit(7).alias("score"))
    assert known(posts, done).count() == 1 and unknown(posts, done).count() == 1


def test_case_files(spark, tmp_path):
    from postlens.sources.evaluation import posts_of, read_cases, write_report

    case = lambda i: {"id": i, "expected": {"min": 0, "max": 19, "disclosure": "unknown"}, "post": {"title": "t"}}
    (tmp_path / "a.json").write_text(json.dumps({"cases": [case("x"), case("y")]}))
    cases = read_cases(spark, str(tmp_path / "a.json"))
    assert posts_of(cases).count() == 2 and cases.first().high == 19
    write_report(cases.select("case_id"), str(tmp_path / "out"))
    (tmp_path / "b.json").write_text(json.dumps({"cases": [case("x")]}))
    with pytest.raises(ValueError, match="repeated case ids: x"):
        read_cases(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"))
