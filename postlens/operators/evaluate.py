"""Evaluation of results against labelled cases: cases and runs in, metrics by provider out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD = 5.0


def range_error(score: Column, low: Column, high: Column) -> Column:
    """How far a score lies outside [low, high]."""
    return F.greatest(low - score, score - high, F.lit(0))


def duplicate_cases(cases: DataFrame) -> DataFrame:
    return cases.groupBy("case_id").agg(F.count("*").alias("times")).where("times > 1")


def case_means(runs: DataFrame) -> DataFrame:
    """(provider, case_id, mean, spread, runs) of the runs that did not fail."""
    return runs.where("error is null").groupBy("provider", "case_id").agg(F.avg("score").alias("mean"), (F.max("score") - F.min("score")).alias("spread"), F.count("*").alias("runs"))


def invariant_pairs(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """(provider, case_id, other_id, difference, held): cases whose score must not differ."""
    means = case_means(runs).select("provider", "case_id", "mean")
    pairs = cases.where("invariant_with is not null").select("case_id", F.col("invariant_with").alias("other_id")).join(means, "case_id")
    other = means.select("provider", F.col("case_id").alias("other_id"), F.col("mean").alias("other"))
    difference = F.abs(F.col("mean") - F.col("other"))
    return pairs.join(other, ["provider", "other_id"]).select("provider", "case_id", "other_id", difference.alias("difference"), (difference <= HELD).alias("held"))


def summarize(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """A row for each provider of runs (provider, case_id, score, disclosure, ms, error).

    cases: case_id, low, high, disclosure (null: any), invariant_with. Means over nothing are 0,
    held pairs over no pairs 1.
    """
    both = runs.join(cases.withColumnRenamed("disclosure", "expected").drop("invariant_with"), "case_id")
    ok = F.col("error").isNull()
    error = range_error(F.col("score"), F.col("low"), F.col("high"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    base = both.groupBy("provider").agg(
        zero(F.avg(F.when(ok, (error == 0).cast("double")))).alias("in_range"),
        zero(F.avg(F.when(ok, error.cast("double")))).alias("mean_range_error"),
        zero(F.avg(F.when(ok & F.col("expected").isNotNull(), (F.col("disclosure") == F.col("expected")).cast("double")))).alias("disclosure_accuracy"),
        F.sum(F.when(ok, 0).otherwise(1)).alias("failed"),
        zero(F.avg(F.when(ok, F.col("ms").cast("double")))).alias("mean_latency_ms"),
    )
    spread = case_means(runs).where("runs >= 2").groupBy("provider").agg(F.avg(F.col("spread").cast("double")).alias("mean_spread"))
    held = invariant_pairs(cases, runs).groupBy("provider").agg(F.avg(F.col("held").cast("double")).alias("pairs_held"))
    out = base.join(spread, "provider", "left").join(held, "provider", "left")
    return out.select("provider", "in_range", "mean_range_error", "disclosure_accuracy", zero(F.col("mean_spread")).alias("mean_spread"), F.coalesce("pairs_held", F.lit(1.0)).alias("pairs_held"), "failed", "mean_latency_ms")
