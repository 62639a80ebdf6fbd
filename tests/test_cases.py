"""The labelled cases: every one inside its range, with the disclosure it asks for, by rules alone."""

import os

import pytest
from pyspark.sql import functions as F

from postlens.operators import evaluate, witness
from postlens.operators.feed import queued, with_fetched
from postlens.operators.scoring import analyze
from postlens.sources.evaluation import posts_of, read_cases
from postlens.streaming import limits

CASES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "cases.json")


@pytest.fixture(scope="module")
def judged(spark):
    cases = read_cases(spark, CASES)
    done = analyze(posts_of(cases), F.lit(1_700_000_000.0))
    return cases, done.select("case_id", "promoLikelihood", "disclosure").cache()


def test_every_case(judged):
    cases, done = judged
    got = {r.case_id: r for r in done.collect()}
    want = cases.select("case_id", "low", "high", "disclosure").collect()
    assert len(want) == len(got) == 17
    for c in want:
        assert c.low <= got[c.case_id].promoLikelihood <= c.high, c.case_id
        assert got[c.case_id].disclosure == c.disclosure, c.case_id


def test_the_summary_of_the_cases(judged):
    cases, done = judged
    runs = done.select("case_id", F.lit("rules").alias("provider"), F.col("promoLikelihood").alias("score"), "disclosure", F.lit(1).alias("ms"), F.lit(None).cast("string").alias("error"))
    s = evaluate.summarize(cases.select("case_id", "low", "high", "disclosure", "invariant_with"), runs).first()
    assert (s.in_range, s.mean_range_error, s.disclosure_accuracy, s.pairs_held, s.failed) == (1.0, 0.0, 1.0, 1.0, 0)


def test_direct_answers_that_are_none(spark):
    rows = [("no json",), ('{"promoLikelihood": 101}',), (None,), ('{"promoLikelihood": 5, "disclosure": "clear", "confidence": "low", "reasons": []}',), ('```json\n{"promoLikelihood": 5, "disclosure": "clear", "confidence": "low", "reasons": ["It is so"]}\n```',)]
    got = [r.o for r in spark.createDataFrame(rows, "raw string").select(witness.parse_direct(F.col("raw")).alias("o")).collect()]
    assert [x is not None for x in got] == [False, False, False, False, True] and got[4].evidence == []
    assert set(witness.PROVIDERS) == {"mock", "witness", "direct"}


def test_a_refused_card_waits(spark):
    cards = spark.createDataFrame([("a", "x", False), ("b", "x", False), ("c", "x", True)], "id string, title string, isDetailPage boolean")
    fetched = spark.createDataFrame([("a", False, "rate_limited", None), ("b", True, None, ("full",))], "id string, ok boolean, reason string, post struct<title: string>")
    got = {r.id: (r.title, r.ready) for r in with_fetched(cards, fetched).collect()}
    assert got == {"a": ("x", False), "b": ("full", True), "c": ("x", True)}


def test_queues(spark):
    tasks = spark.createDataFrame([("a", 0, 1), ("b", 5, 2), ("a", 9, 3), ("c", 5, 4)], "key string, priority int, seq long")
    assert [(r.key, r.turn) for r in queued(tasks, at_a_time=1).orderBy("turn").collect()] == [("b", 0), ("c", 1), ("a", 2)]


def test_a_busy_key_is_cut_where_it_pauses(spark):
    rows = [("k", t, n) for n, t in enumerate([0, 10, 20, 30, 1_000, 1_005, 1_010, 5_000])]
    events = spark.createDataFrame(rows, "key string, now long, seq long")
    got = {r.now: (r.allowed, r.retry_after_ms) for r in limits.rate_limit(events, 2, window=100).collect()}
    assert got == {0: (True, 0), 10: (True, 0), 20: (False, 80), 30: (False, 70), 1_000: (True, 0), 1_005: (True, 0), 1_010: (False, 90), 5_000: (True, 0)}
    assert limits.rate_limit(events.limit(0), 2).count() == 0 and limits.ttl_cache(events.limit(0)).count() == 0
