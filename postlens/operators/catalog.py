"""The criteria catalogue, as a table, as literals, and as the signals made from it."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import CRITERIA, EXPLANATIONS

NAMES = ["id", "category", "strength", "weight", "maxWeight", "description", "affects", "evidenceSource", "requiresVerification", "availability", "correlationGroup"]
BY_ID = {r[0]: dict(zip(NAMES, r)) for r in CRITERIA}
SIGNAL = "struct<id: string, category: string, explanation: string, weight: double, evidenceSource: string, verified: boolean, affects: array<string>, strength: string, correlationGroup: string, excerpt: string, sourceUrl: string>"


def criterion(id: str) -> dict:
    if id not in BY_ID:
        raise KeyError(f"unknown criterion: {id}")
    return BY_ID[id]


def criteria(spark: SparkSession, availability: str | None = None) -> DataFrame:
    """The catalogue (or its part with an availability), one row for each criterion, with its place seq."""
    rows = [(k, *r[:6], list(r[6]), *r[7:]) for k, r in enumerate(CRITERIA)]
    df = spark.createDataFrame(rows, "seq int, id string, category string, strength string, weight int, maxWeight int, description string, affects array<string>, evidenceSource string, requiresVerification boolean, availability string, correlationGroup string")
    return df if availability is None else df.where(F.col("availability") == availability)


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


@lru_cache(maxsize=None)
def _plain(id: str) -> str:
    """The SQL of the signal that a criterion gives by itself."""
    c = criterion(id)
    top = c["weight"] if c["maxWeight"] is None else min(c["weight"], c["maxWeight"])
    group = "CAST(NULL AS STRING)" if c["correlationGroup"] is None else _quoted(c["correlationGroup"])
    affects = ", ".join(map(_quoted, c["affects"]))
    return (
        f"named_struct('id', {_quoted(c['id'])}, 'category', {_quoted(c['category'])}, 'explanation', {_quoted(EXPLANATIONS.get(id, c['description']))}, 'weight', {float(top)}D, 'evidenceSource', {_quoted(c['evidenceSource'])}, "
        f"'verified', {str(not c['requiresVerification']).lower()}, 'affects', array({affects}), 'strength', {_quoted(c['strength'])}, 'correlationGroup', {group}, 'excerpt', CAST(NULL AS STRING), 'sourceUrl', CAST(NULL AS STRING))"
    )


def signal(id: str, weight: Column | float | None = None, explanation: Column | str | None = None, excerpt: Column | None = None, verified: bool | None = None, url: Column | None = None) -> Column:
    """A signal of the criterion; its weight never passes the criterion's maximum."""
    c = criterion(id)
    made = F.expr(_plain(id))  # one expression for all that doesn't depend on the post
    if weight is not None:
        w = F.lit(float(weight)) if isinstance(weight, (int, float)) else weight.cast("double")
        made = made.withField("weight", w if c["maxWeight"] is None else F.least(w, F.lit(float(c["maxWeight"]))))
    if explanation is not None:
        made = made.withField("explanation", F.lit(explanation) if isinstance(explanation, str) else explanation)
    if verified is not None:
        made = made.withField("verified", F.lit(verified))
    if excerpt is not None:
        made = made.withField("excerpt", excerpt)
    return made if url is None else made.withField("sourceUrl", url)


def when(condition: Column, *args, **more) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), signal(*args, **more))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once for each row, however often they are used.

    The optimiser puts an expression wherever its column stands, inside lambdas too, where it would
    run for each element; a generator of one row is a wall it keeps to.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    return df.select(*kept, made).select(*kept, "_once.*")


def signals(*items: Column) -> Column:
    """Those of the items that are there, in order."""
    return F.filter(F.array(*items), lambda s: s.isNotNull())
