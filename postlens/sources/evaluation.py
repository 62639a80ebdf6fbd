"""Labelled cases from JSON files, and reports of an evaluation as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import duplicate_cases
from ..operators.posts import FIELDS

_POST = "struct<" + ", ".join(f"{k}: {v}" for k, v in FIELDS.items()) + ">"
CASES = f"cases array<struct<id: string, description: string, invariantWith: string, expected: struct<min: int, max: int, disclosure: string>, post: {_POST}>>"


def read_cases(spark: SparkSession, *paths: str) -> DataFrame:
    """(case_id, description, invariant_with, low, high, disclosure, post) of files {"cases": [...]}.

    A case id that occurs twice is an error.
    """
    found = spark.read.schema(CASES).option("multiLine", True).json(list(paths)).select(F.explode("cases").alias("c"))
    cases = found.select(F.col("c.id").alias("case_id"), "c.description", F.col("c.invariantWith").alias("invariant_with"), F.col("c.expected.min").alias("low"), F.col("c.expected.max").alias("high"), F.col("c.expected.disclosure").alias("disclosure"), "c.post")
    twice = [r.case_id for r in duplicate_cases(cases).limit(5).collect()]
    if twice:
        raise ValueError(f"repeated case ids: {', '.join(sorted(twice))}")
    return cases


def posts_of(cases: DataFrame) -> DataFrame:
    """The cases' posts, ready to be analysed, with case_id."""
    return cases.select("case_id", "post.*")


def write_report(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)
