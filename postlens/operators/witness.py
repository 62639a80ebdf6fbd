"""Merging a language model's claims into rule signals: quotes are verified, powers are bounded.

The call to the model is outside; this is what happens to its answer, as array expressions of the
post's row. A claim needs a quote that stands in the post (or, for some categories, in the history
or the comments); retractions reach text judgments only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as P
from ..functions import text as X
from .catalog import BY_ID, SIGNAL, criterion, once, signal
from .history import quotable
from .scoring import clamp, reach, score_signals, undisclosed_risk

SIGNAL_LIST = f"array<{SIGNAL}>"
LEAST, FULL, PART, OBSERVATIONS = 0.6, 0.85, 0.6, 3
OUTPUT = "struct<signals: array<struct<id: string, quote: string, confidence: double, note: string>>, retract: array<struct<id: string, reason: string>>, observations: array<struct<quote: string, direction: string, note: string, confidence: double>>>"
ELIGIBLE = [c["id"] for c in BY_ID.values() if c["category"] in P.JUDGMENT and c["availability"] != "unavailable" and not c["requiresVerification"]]


def parse_output(raw: Column) -> Column:
    """A model's raw answer as OUTPUT; null if it is no JSON of that shape or passes its limits."""
    plain = _json(raw)
    out = F.from_json(plain, OUTPUT, {"mode": "PERMISSIVE"})
    list_ = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    sized = lambda c, low, high: F.coalesce(F.length(c).between(low, high), F.lit(False))
    sure = lambda c: F.coalesce(c.between(0, 1), F.lit(False))
    short = lambda c, n: c.isNull() | (F.length(c) <= n)
    signals, retract, seen = out["signals"], out["retract"], out["observations"]
    ok = (
        plain.rlike(r"\A\{")
        & F.coalesce((F.size(signals) <= 20) & F.forall(signals, lambda s: sized(s["id"], 1, 64) & sized(s["quote"], 3, 240) & sure(s["confidence"]) & short(s["note"], 200)), F.lit(True))
        & F.coalesce((F.size(retract) <= 20) & F.forall(retract, lambda r: sized(r["id"], 1, 64) & short(r["reason"], 200)), F.lit(True))
        & F.coalesce((F.size(seen) <= 6) & F.forall(seen, lambda o: sized(o["quote"], 3, 240) & o["direction"].isin("promotional", "organic") & sized(o["note"], 3, 200) & sure(o["confidence"])), F.lit(True))
    )
    found = F.struct(
        list_(signals, "array<struct<id: string, quote: string, confidence: double, note: string>>").alias("signals"),
        list_(retract, "array<struct<id: string, reason: string>>").alias("retract"),
        list_(seen, "array<struct<quote: string, direction: string, note: string, confidence: double>>").alias("observations"),
    )
    return F.when(out.isNotNull() & F.try_parse_json(plain).isNotNull() & ok, found)


def _excerpt(quote: Column) -> Column:
    return F.left(F.trim(quote), F.lit(80))


def _claimed(claim: Column, factor: Column) -> Column:
    """The signal of an eligible criterion that a claim makes."""
    made = F.try_element_at(F.create_map(*[x for id in ELIGIBLE for x in (F.lit(id), signal(id))]), claim["id"])
    note = F.when(F.trim(claim["note"]) != "", X.sanitize_note(claim["note"])).otherwise(F.lit(None).cast("string"))
    top = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for id in ELIGIBLE if criterion(id)["maxWeight"] is not None for x in (id, float(criterion(id)["maxWeight"]))] or [F.lit(""), F.lit(0.0)]), claim["id"]), F.lit(float("inf")))
    full = F.try_element_at(F.create_map(*[F.lit(x) for id in ELIGIBLE for x in (id, float(criterion(id)["weight"]))]), claim["id"])
    described = F.try_element_at(F.create_map(*[F.lit(x) for id in ELIGIBLE for x in (id, criterion(id)["description"])]), claim["id"])
    return made.withField("weight", F.least(F.floor(full * factor + 0.5).cast("double"), top)).withField("explanation", F.coalesce(note, described)).withField("excerpt", _excerpt(claim["quote"]))


def merge(df: DataFrame, output: str = "output", model: str = "model") -> DataFrame:
    """df (post columns, signals, a parsed model output) with signals merged.

    Adds accepted, observed, rejected and retracted counts. A null output leaves signals as they are.
    """
    f = F.col
    none = F.array().cast("array<struct<id: string, reason: string>>")
    post = X.normalize_for_match(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))))
    comments = F.array_join(F.transform(F.coalesce("visibleComments", F.array().cast("array<struct<author: string, text: string, isOp: boolean, depth: int>>")), lambda c: c["text"]), "\n")
    df = once(df, {"_post": post, "_history": X.normalize_for_match(quotable(f("authorHistory"))), "_comments": X.normalize_for_match(comments)})
    gone = F.filter(F.transform(F.coalesce(f(output)["retract"], none), lambda r: r["id"]), lambda id: F.exists("signals", lambda s: (s["id"] == id) & s["category"].isin(P.RETRACTABLE) & ~s["id"].isin(P.NEVER_RETRACT) & (s["weight"] > 0)))
    df = once(df, {"_gone": F.array_distinct(gone)})
    df = once(df, {"_kept": F.filter("signals", lambda s: ~F.array_contains("_gone", s["id"]))})
    history_ids = [i for i in ELIGIBLE if criterion(i)["category"] in P.QUOTES_HISTORY]
    comment_ids = [i for i in ELIGIBLE if criterion(i)["category"] in P.QUOTES_COMMENTS]

    def quoted(c: Column) -> Column:
        q = X.normalize_for_match(c["quote"])
        return F.contains(f("_post"), q) | (c["id"].isin(history_ids) & F.contains(f("_history"), q)) | (c["id"].isin(comment_ids) & F.contains(f("_comments"), q))

    kept_ids = F.transform("_kept", lambda s: s["id"])
    tried = F.filter(f(output)["signals"], lambda c: c["id"].isin(ELIGIBLE) & ~F.array_contains("_gone", c["id"]) & ~F.array_contains(kept_ids, c["id"]) & (c["confidence"] >= LEAST))
    df = once(df, {"_tried": F.coalesce(F.transform(tried, lambda c: F.struct(c.alias("c"), quoted(c).alias("ok"))), F.array().cast("array<struct<c: struct<id: string, quote: string, confidence: double, note: string>, ok: boolean>>"))})
    numbered = F.transform("_tried", lambda x, i: F.struct(x["c"].alias("c"), x["ok"].alias("ok"), i.alias("i")))
    earlier = lambda x: F.exists(F.filter(numbered, lambda y: y["ok"] & (y["i"] < x["i"])), lambda y: y["c"]["id"] == x["c"]["id"])
    df = once(df, {"_new": F.filter(numbered, lambda x: ~earlier(x))})
    taken = F.filter("_new", lambda x: x["ok"])
    claims = F.transform(taken, lambda x: _claimed(x["c"], F.when(x["c"]["confidence"] >= FULL, 1.0).otherwise(PART)))
    everywhere = F.concat("_post", F.lit("\n"), "_history", F.lit("\n"), "_comments")
    seen = F.filter(F.coalesce(f(output)["observations"], F.array().cast("array<struct<quote: string, direction: string, note: string, confidence: double>>")), lambda o: o["confidence"] >= LEAST)
    checked = F.transform(seen, lambda o: F.struct(o.alias("o"), F.contains(everywhere, X.normalize_for_match(o["quote"])).alias("ok")))
    df = once(df, {"_seen": checked, "_claims": claims})
    good = F.slice(F.filter("_seen", lambda x: x["ok"]), 1, OBSERVATIONS)
    done = F.transform(good, lambda x: signal("model.observation", F.when(x["o"]["direction"] == "organic", -8.0).otherwise(8.0), F.concat(F.lit("Model observation: "), X.sanitize_note(x["o"]["note"])), _excerpt(x["o"]["quote"])))
    # what is refused counts until enough is observed
    upto = F.transform("_seen", lambda x, i: F.struct(x["ok"].alias("ok"), F.size(F.filter(F.slice("_seen", F.lit(1), i), lambda y: y["ok"])).alias("before")))
    refused = F.size(F.filter("_new", lambda x: ~x["ok"])) + F.size(F.filter(upto, lambda x: ~x["ok"] & (x["before"] < OBSERVATIONS)))
    df = once(df, {"accepted": F.size("_claims"), "observed": F.size(good), "rejected": refused, "retracted": F.size("_gone"), "_done": done})
    name = f(model) if model in df.columns else F.lit("model")
    note = F.concat(
        F.lit("A language model ("), name, F.lit(") reviewed the post text"), F.when(f("_history") != "", " and the author's public history").otherwise(""), F.lit("; "), f("accepted").cast("string"),
        F.lit(" claim(s) with verified quotes were used, "), f("observed").cast("string"), F.lit(" observation(s) added, "), f("rejected").cast("string"),
        F.lit(" without a matching quote were discarded, "), f("retracted").cast("string"), F.lit(" rule signal(s) were withdrawn as false positives"),
    )
    told = F.struct(
        F.lit("api.llm-witness").alias("id"), F.lit("availability").alias("category"), note.alias("explanation"), F.lit(0.0).alias("weight"), F.lit("api").alias("evidenceSource"), F.lit(True).alias("verified"),
        F.array(F.lit("confidence")).alias("affects"), F.lit("info").alias("strength"), F.lit(None).cast("string").alias("correlationGroup"), F.lit(None).cast("string").alias("excerpt"), F.lit(None).cast("string").alias("sourceUrl"),
    )
    merged = F.when(f(output).isNull(), f("signals")).otherwise(F.concat("_kept", "_claims", "_done", F.array(told)))
    return df.withColumn("signals", merged).drop("_post", "_history", "_comments", "_gone", "_kept", "_tried", "_new", "_seen", "_claims", "_done")


def rescore(df: DataFrame, output: str = "output") -> DataFrame:
    """merge() and the scores of what it gives."""
    return score_signals(merge(df, output), "api")


def mock(df: DataFrame) -> DataFrame:
    """The provider that only notes that rules decided: signals with a weightless note."""
    note = F.transform(F.array(F.lit(0)), lambda _: signal("availability.comments-unavailable", explanation="Mock provider: rules only"))
    return score_signals(df.withColumn("signals", F.concat("signals", note)), "api")


DIRECT = "struct<promoLikelihood: double, disclosure: string, undisclosedRisk: string, confidence: string, reasons: array<string>, evidence: array<struct<quote: string, criterionId: string>>, note: string>"


def _json(raw: Column) -> Column:
    """A model's answer without the fence around it."""
    return F.regexp_replace(F.regexp_replace(X.trim_all(raw), r"(?i)\A```(?:json)?\s*", ""), r"\s*```\z", "")


def parse_direct(raw: Column) -> Column:
    """A model's own verdict as DIRECT; null if it is no JSON of that shape or passes its limits."""
    plain = _json(raw)
    out = F.from_json(plain, DIRECT, {"mode": "PERMISSIVE"})
    within = lambda c, low, high: F.coalesce(c.between(low, high), F.lit(False))
    levels = ["low", "medium", "high"]
    evidence = F.coalesce(out["evidence"], F.array().cast("array<struct<quote: string, criterionId: string>>"))
    ok = (
        plain.rlike(r"\A\{")
        & within(out["promoLikelihood"], 0, 100)
        & F.coalesce(out["disclosure"].isin("clear", "unclear", "missing", "unknown"), F.lit(False))
        & (out["undisclosedRisk"].isNull() | out["undisclosedRisk"].isin(levels))
        & F.coalesce(out["confidence"].isin(levels), F.lit(False))
        & within(F.size(out["reasons"]), 1, 3)
        & F.coalesce(F.forall(out["reasons"], lambda r: within(F.length(r), 3, 200)), F.lit(False))
        & (F.size(evidence) <= 12)
        & F.coalesce(F.forall(evidence, lambda e: within(F.length(e["quote"]), 3, 240) & (e["criterionId"].isNull() | (F.length(e["criterionId"]) <= 64))), F.lit(False))
        & (out["note"].isNull() | (F.length(out["note"]) <= 300))
    )
    return F.when(out.isNotNull() & F.try_parse_json(plain).isNotNull() & ok, out.withField("evidence", evidence))


def _noted(id: str, explanation: Column, excerpt: Column) -> Column:
    """A weightless signal that is no criterion's."""
    return F.struct(
        F.lit(id).alias("id"), F.lit("availability").alias("category"), explanation.alias("explanation"), F.lit(0.0).alias("weight"), F.lit("api").alias("evidenceSource"), F.lit(True).alias("verified"),
        F.array(F.lit("confidence")).alias("affects"), F.lit("info").alias("strength"), F.lit(None).cast("string").alias("correlationGroup"), excerpt.alias("excerpt"), F.lit(None).cast("string").alias("sourceUrl"),
    )


def direct_result(df: DataFrame, output: str = "output", model: str = "model") -> DataFrame:
    """A model's own verdict (DIRECT) as a result: quotes must stand in the post, reach stays the rules'.

    Signals are those quotes and a note; rows whose output is null get a null result.
    """
    df = df.select(*[c for c in df.columns if c != "signals"])
    out, name = F.col(output), F.col(model) if model in df.columns else F.lit("model")
    post = X.normalize_for_match(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))))
    df = df.withColumn("_post", post)
    found = F.filter(out["evidence"], lambda e: F.contains("_post", X.normalize_for_match(e["quote"])))
    df = df.withColumn("_found", found)
    score = clamp(out["promoLikelihood"])
    cited = F.transform("_found", lambda e: _noted("api.llm-direct-evidence", F.when(F.coalesce(e["criterionId"], F.lit("")) != "", F.concat(F.lit("Model cited "), e["criterionId"])).otherwise("Model-cited evidence"), _excerpt(e["quote"])))
    lost = (F.size(out["evidence"]) - F.size("_found")).cast("string")
    told = F.concat(
        F.lit("EXPERIMENTAL: score produced directly by a language model ("), name, F.lit("); "), F.size("_found").cast("string"), F.lit(" quote(s) verified, "), lost, F.lit(" could not be found in the post"),
        F.when(F.coalesce(out["note"], F.lit("")) != "", F.concat(F.lit(". Model note: "), X.sanitize_note(out["note"]))).otherwise(""),
    )
    there = out.isNotNull()
    only = lambda c: F.when(there, c)
    df = df.withColumns({"promoLikelihood": only(score), "disclosure": only(out["disclosure"])})
    df = df.withColumns(
        {
            "label": only(X.score_label(F.col("promoLikelihood"))), "undisclosedRisk": only(F.coalesce(out["undisclosedRisk"], undisclosed_risk(F.col("promoLikelihood"), F.col("disclosure")))), "confidence": only(out["confidence"]), "reach": only(reach()),
            "reasons": only(F.slice(F.transform(out["reasons"], lambda r: X.sanitize_note(r)), 1, 3)), "signals": only(F.concat(cited, F.array(_noted("api.llm-direct", told, F.lit(None).cast("string"))))), "analysisVersion": only(F.lit(P.VERSION)), "source": only(F.lit("api")),
        }
    )
    return df.drop("_post", "_found")


#: What gives a result for posts with signals (and, but for mock, a parsed output), by name.
PROVIDERS: dict[str, Callable[[DataFrame], DataFrame]] = {"mock": mock, "witness": rescore, "direct": direct_result}


def ask(df: DataFrame, complete: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """Adds raw, a model's answer to each prompt; complete is the caller's transport, called on executors."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(raw=[complete(p) for p in pdf[prompt]])

    from pyspark.sql import types as T

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("raw", T.StringType())]))
