"""Posts of our own, through detection, scoring and verdict, in one pass."""

import json

import pytest
from pyspark.sql import functions as F

from postlens.operators.posts import POST, rejected, valid
from postlens.operators.scoring import analyze, clamp
from postlens.operators.verdict import of_result, summary

LONG = " ".join(f"Paragraph {k} tells what happened on an ordinary evening at home." for k in range(18))
CASES = {
    "ask": dict(title="Small news", body="Sign up today at https://zorbly.io/start and tell me."),
    "described": dict(title="Small news", body="It has a one-click install from the shop and people who download it are few."),
    "coupon": dict(title="Deal", body="There is a promo code for all, 20% off until Friday."),
    "token": dict(title="Deal", body="My code: SAVE2024 still works."),
    "dm": dict(title="Template", body="DM me for the link and the template."),
    "tracked": dict(title="A thing", body="See https://shop.zorbly.io/x?ref=me for it", links=["https://shop.zorbly.io/x?ref=me", "https://shop.zorbly.io/y"]),
    "familiar host": dict(title="Code", body="It is at https://github.com/a/b only."),
    "short link": dict(title="A thing", body="Here https://bit.ly/abc it is."),
    "maker": dict(title="Launch", body="I built Zorblatt over the winter. Please check it out: https://zorblatt.app"),
    "employee": dict(title="Hello", body="I work for a company in this field, by the way."),
    "buried": dict(title="Notes", body=LONG + " And, full disclosure, the last one is mine."),
    "friend": dict(title="Look", body="My friend built a little app."),
    "organic": dict(title="How to sleep", body=LONG + " One downside is the price, and another drawback is the noise."),
    "dup": dict(title="Seven quiet ways to keep your desk tidy", body="See https://zorbly.io", author="zorbly_fan", authorHistory=dict(author="zorbly_fan", fetchedAt=1, available=True, accountAgeDays=9.0, linkKarma=3, commentKarma=4, submissions=[dict(id="t3_a", subreddit=s, title=t, url="https://zorbly.io/p", domain="zorbly.io", createdUtc=1_699_913_600) for s, t in (("one", "Seven quiet ways to keep your desk tidy today"), ("two", "I made Zorbly for this"), ("three", "Zorbly again"), ("four", "zorbly.io works"))], comments=[])),
    "no history": dict(title="x", body="y", authorHistory=dict(author="a", fetchedAt=1, available=False, reason="rate_limited", submissions=[], comments=[])),
    "accused": dict(title="A cup", body="It is a cup.", author="op", isDetailPage=True, visibleComments=[dict(author="u1", text="This is an ad for sure, you can tell"), dict(author="u2", text="shill account if I ever saw one"), dict(author="OP", text="DM me, I made it: my app is on https://cup.example"), dict(author="u3", text="posted this before")]),
    "copied": dict(title="A cup", body="It is a cup.", author="op", isDetailPage=True, visibleComments=[dict(author=f"u{k}", text="obvious ad, do not trust this person") for k in range(3)]),
    "praise": dict(title="A cup", body="It is a cup.", isDetailPage=True, visibleComments=[dict(author=f"u{k}", text="amazing cup, exactly what i needed today") for k in range(3)]),
    "viral": dict(title="How to sleep", body=LONG + " One downside is the price, and another drawback is the noise.", upvotes=90_000, commentsCount=4_000, ageHours=3.0),
    "numbers": dict(title="n", body="m", upvotes=12_345, commentsCount=7, ageHours=50.0, subredditSubscribers=2_500_000),
    "bare": dict(title="t"),
    "compare": dict(title="Tools", body="I weighed Notion vs Obsidian, and also tried Evernote. Depends on your needs."),
}
EXPECT = {
    "ask": ({"cta.direct", "link.product-link"}, {"counter.no-cta"}),
    "described": ({"counter.no-cta"}, {"cta.direct"}),
    "coupon": ({"cta.coupon"}, set()),
    "token": ({"cta.coupon"}, set()),
    "dm": ({"cta.dm-request"}, {"link.product-link"}),
    "tracked": ({"link.affiliate-params", "cta.repeated-links"}, {"link.redirect-tracking"}),
    "familiar host": ({"counter.no-cta"}, {"link.product-link"}),
    "short link": ({"link.redirect-tracking"}, set()),
    "maker": ({"disclosure.creator", "cta.direct"}, {"workflow.no-relationship-disclosed"}),
    "employee": ({"disclosure.employment"}, set()),
    "buried": ({"disclosure.creator", "disclosure.buried"}, set()),
    "friend": ({"disclosure.friends-product"}, {"disclosure.creator"}),
    "organic": ({"counter.limitations", "counter.useful-no-links", "counter.no-cta"}, {"cta.direct"}),
    "dup": ({"history.repeated-text", "history.cross-subreddit", "account.repeats-domain", "account.self-identified-elsewhere", "account.new-account", "account.low-karma", "account.username-matches", "availability.profile-history-checked"}, {"counter.incidental-product"}),
    "no history": ({"availability.profile-history-unavailable"}, set()),
    "accused": ({"community.several-independent-concerns", "community.author-admission", "community.repeated-posts-identified", "behavior.dm-for-link", "disclosure.comments-only"}, {"community.single-accusation", "availability.comments-unavailable"}),
    "copied": ({"community.coordinated-accusations"}, {"community.several-independent-concerns"}),
    "praise": ({"coord.similar-wording"}, set()),
    "compare": ({"counter.compares-alternatives"}, set()),
}


@pytest.fixture(scope="module")
def done(spark):
    rows = [json.dumps({"id": k, **v}) for k, v in CASES.items()]
    df = spark.read.schema(POST).json(spark.sparkContext.parallelize(rows, 2))
    out = analyze(df, F.lit(1_700_000_000.0)).withColumn("v", of_result()).withColumn("said", summary("Lens"))
    return {r.id: r for r in out.collect()}


@pytest.mark.parametrize("case", sorted(EXPECT))
def test_signals(done, case):
    ids = {s.id for s in done[case].signals}
    there, absent = EXPECT[case]
    assert there <= ids and not absent & ids, ids


def test_scores(done):
    assert done["maker"].promoLikelihood >= 80 and done["maker"].disclosure == "clear" and done["maker"].v.kind == "transparent"
    assert done["organic"].promoLikelihood < 20 and done["organic"].v.headline == "Looks organic"
    assert done["viral"].promoLikelihood == done["organic"].promoLikelihood and done["viral"].reach.level == "high"
    assert done["buried"].disclosure == "unclear"
    assert done["dup"].v.hiddenConnection and done["dup"].v.kind == "undisclosed"
    assert done["numbers"].reach.explanation == "12,345 upvotes and 7 comments on a 2-day-old post in a 2.5M-member community (approximate; reach is not evidence of promotion)"
    assert done["bare"].reach.explanation == "Vote and comment counts were not visible"
    assert done["copied"].confidence == "low"
    assert all(len(r.reasons) <= 3 and 0 <= r.promoLikelihood <= 100 for r in done.values())
    assert "rate limit" in next(s.explanation for s in done["no history"].signals if s.id == "availability.profile-history-unavailable")
    assert next(s for s in done["dup"].signals if s.id == "history.repeated-text").explanation.endswith("(1 day ago)")
    assert done["maker"].said.startswith("Lens: Transparent promotion.")


def test_limits_of_rows(spark):
    df = spark.createDataFrame([("ok", "b", 1), ("", "b", 1), ("x" * 601, None, 1), (None, "b", 1), ("t", "y" * 40_001, 1), ("t", "b", -5)], "title string, body string, commentsCount long")
    assert valid(df).count() == 1
    assert sorted(r.problems[0].split(":")[0] for r in rejected(df).collect()) == ["body", "commentsCount", "title", "title", "title"]


def test_clamp(spark):
    df = spark.createDataFrame([(1, -3.0), (2, 50.5), (3, 180.0), (4, float("nan")), (5, float("inf"))], "k int, x double")
    assert [r[0] for r in df.orderBy("k").select(clamp(F.col("x"))).collect()] == [0, 51, 100, 0, 0]
