"""Rate limits, caches and quotas: as folds of a key's events, in batches and in streams.

Clocks are the events' own. A fold keeps a small state for each key, so a stream holds it in its
state store (applyInPandasWithState) and a batch folds sorted events as they stream by; both run the
same step functions. In a batch a key's events are cut where they pause for so long that the state
is empty anyway, and each part is folded apart, so that a busy key is no single task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW_MS, CACHE_TTL_MS, HISTORY_TTL_MS, MISS_AGE_MS = 60_000, 86_400_000, 21_600_000, 18_000_000


def limit_step(kept: list[int], now: int, limit: int, window: int = WINDOW_MS) -> tuple[list[int], bool, int]:
    """(times kept, allowed, milliseconds to wait): a sliding window in which denied calls don't count."""
    kept = [t for t in kept if t > now - window]
    if len(kept) >= limit:
        return kept, False, kept[0] + window - now
    return [*kept, now], True, 0


def ttl_step(stored: int | None, now: int, ttl: int = CACHE_TTL_MS) -> tuple[int, bool]:
    """(stored at, hit): an entry has expired when its time to live is over to the millisecond."""
    return (stored, True) if stored is not None and stored + ttl > now else (now, False)


def _folded(events: DataFrame, key: str, time: str, pause: int, kinds: list[T.StructField], step: Callable, start) -> DataFrame:
    """events with the columns kinds, which step(state, now) gives beside the next state.

    The state is start for each key, and after each pause of so many milliseconds.
    """
    order = Window.partitionBy(key).orderBy(time, "seq")
    quiet = F.coalesce(F.col(time) - F.lag(time).over(order) >= pause, F.lit(True))
    part = F.sum(quiet.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner, width = F.struct(*[F.col(f"`{c}`") for c in events.columns]), len(events.columns)
    cut = events.select(inner.alias("of"), F.col(key).alias("k"), F.col(time).alias("now"), F.col("seq").alias("seq"), part.alias("part"))
    cut = cut.repartition("k", "part").sortWithinPartitions("k", "part", "now", "seq").select("of.*", F.col("k").alias("k_"), F.col("part").alias("part_"), F.col("now").alias("now_"))
    names = [*events.columns, *[f.name for f in kinds]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, start
        for b in batches:
            out = []
            for k, part, now in zip(*[b.column(width + c).to_pylist() for c in range(3)]):
                if (k, part) != at:
                    at, state = (k, part), start
                state, *found = step(state, now)
                out.append(found)
            more = [pa.array(x) for x in zip(*out)] if out else [pa.array([], pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.int64()) for f in kinds]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *more], names)

    return cut.mapInArrow(run, T.StructType([*events.schema.fields, *kinds]))


def rate_limit(events: DataFrame, limit: int, key: str = "key", time: str = "now", window: int = WINDOW_MS) -> DataFrame:
    """events (key, now in ms, seq) with allowed and retry_after_ms, each key folded in order of now, seq."""
    kinds = [T.StructField("allowed", T.BooleanType()), T.StructField("retry_after_ms", T.LongType())]
    return _folded(events, key, time, window, kinds, lambda kept, now: limit_step(kept, now, limit, window), [])


def rate_limit_stream(events: DataFrame, limit: int, window: int = WINDOW_MS) -> DataFrame:
    """The same over a stream of (key string, now long, seq long); the state is the times kept."""

    def step(keys, batches: Iterator[pd.DataFrame], state):
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["now", "seq"])
        out = []
        for now, seq in zip(rows.now, rows.seq):
            kept, allowed, wait = limit_step(kept, int(now), limit, window)
            out.append((keys[0], int(now), int(seq), allowed, wait))
        state.update((kept,))
        yield pd.DataFrame(out, columns=["key", "now", "seq", "allowed", "retry_after_ms"])

    return events.groupBy("key").applyInPandasWithState(step, "key string, now long, seq long, allowed boolean, retry_after_ms long", "kept array<long>", "append", "NoTimeout")


def ttl_cache(lookups: DataFrame, ttl: int = CACHE_TTL_MS, key: str = "key", time: str = "now") -> DataFrame:
    """lookups (key, now in ms, seq) with hit: a miss stores, and what is stored lives for ttl."""
    return _folded(lookups, key, time, ttl, [T.StructField("hit", T.BooleanType())], lambda stored, now: ttl_step(stored, now, ttl), None)


def fresh(entries: DataFrame, now: Column, ttl: int = CACHE_TTL_MS) -> DataFrame:
    """The entries (stored_at in ms) that have not expired."""
    return entries.where(F.col("stored_at") + ttl > now)


def within_capacity(entries: DataFrame, most: int) -> DataFrame:
    """The newest entries (stored_at, key), most of them: the oldest go first."""
    return entries.orderBy(F.desc("stored_at"), F.desc("key")).limit(most)


def history_fresh(entries: DataFrame, now: Column) -> DataFrame:
    """Cached histories (stored_at, available) still good: a missing one counts as stored hours earlier."""
    age = F.when(F.col("available"), 0).otherwise(MISS_AGE_MS)
    return entries.where(F.col("stored_at") - age + HISTORY_TTL_MS > now)


def deduplicated(df: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """One row of a key within the watermark, for streams; of all rows for a batch."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def debounced(df: DataFrame, key: str, time: str, gap: str = "150 milliseconds", late: str = "1 minute") -> DataFrame:
    """(key, first, last, events) for each burst of events that lie less than gap apart."""
    df = df.withWatermark(time, late) if df.isStreaming else df
    bursts = df.groupBy(F.col(key), F.session_window(time, gap)).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("events"))
    return bursts.drop("session_window")


def month_key(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM")


def next_month(t: Column) -> Column:
    return F.add_months(F.trunc(t, "MM"), 1)


def plan_of(license_status: Column) -> Column:
    """plus for a valid licence, and while licences can't be checked; free otherwise."""
    return F.when(license_status.isin("valid", "provider_error"), "plus").otherwise("free")


# What an install's id and a licence key look like.
INSTALL_ID = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
LICENSE_KEY = r"\A[A-Za-z0-9-]{16,80}\z"


def quota(requests: DataFrame, free_initial: int = 20, free_monthly: int = 5, plus_monthly: int = 500) -> DataFrame:
    """requests (install, ts, seq, plan) with month, allowance, used before, allowed and resets_at.

    A calendar month's requests are counted by install and plan; an install's first month, found by
    an aggregate, has an allowance of its own. The window splits by install, plan and month.
    """
    df = requests.withColumn("month", month_key(F.col("ts")))
    first = df.groupBy(F.col("install").alias("_install")).agg(F.min("month").alias("_first"))
    df = df.join(first, F.col("install").eqNullSafe(F.col("_install"))).drop("_install")
    allowance = F.when(F.col("plan") == "plus", plus_monthly).when(F.col("month") == F.col("_first"), free_initial).otherwise(free_monthly)
    place = F.row_number().over(Window.partitionBy("install", "plan", "month").orderBy("ts", "seq"))
    df = df.withColumns({"allowance": allowance, "used": F.least(place - 1, allowance), "allowed": place <= allowance, "resets_at": next_month(F.col("ts"))})
    return df.drop("_first")


def quota_with_refunds(requests: DataFrame, free_initial: int = 20, free_monthly: int = 5, plus_monthly: int = 500) -> DataFrame:
    """quota() for requests that also say failed: a reserved request that fails gives its place back."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "seq"])
        months = pdf.ts.dt.strftime("%Y-%m")
        first, used, allowed = months.min(), {}, []
        for month, plan, failed in zip(months, pdf.plan, pdf.failed):
            most = plus_monthly if plan == "plus" else free_initial if month == first else free_monthly
            ok = used.get((plan, month), 0) < most
            used[plan, month] = used.get((plan, month), 0) + (ok and not failed)
            allowed.append(ok)
        return pdf.assign(allowed=allowed)

    return requests.groupBy("install").applyInPandas(fold, T.StructType([*requests.schema.fields, T.StructField("allowed", T.BooleanType())]))


#: How long an install without a licence is remembered, and a licence check is.
FREE_TTL_DAYS, CHECK_TTL_MS = 70, 21_600_000


def quota_store(requests: DataFrame) -> DataFrame:
    """A record for each install of requests (install, ts, plan, failed, licence): use by plan and month, the first month, when it expires.

    A failed request gives its place back in the month it was made in. Records with a licence don't expire.
    """
    month = month_key(F.col("ts"))
    kept = F.when(F.coalesce("failed", F.lit(False)), 0).otherwise(1)
    used = requests.groupBy("install", "plan", month.alias("month")).agg(F.sum(kept).alias("used"), F.max("ts").alias("last"), F.max("licence").alias("licence"))
    record = used.groupBy("install").agg(
        F.min("month").alias("first_month"), F.max("licence").alias("licence"), F.max("last").alias("last"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("plan") != "plus") & (F.col("used") > 0), F.struct("month", "used"))))).alias("months"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("plan") == "plus") & (F.col("used") > 0), F.struct("month", "used"))))).alias("plus_months"),
    )
    return record.withColumn("expires", F.when(F.col("licence").isNull(), F.col("last") + F.expr(f"interval {FREE_TTL_DAYS} days")))


def stored(records: DataFrame, as_of: Column) -> DataFrame:
    """The records that have not expired."""
    return records.where(F.col("expires").isNull() | (F.col("expires") > as_of))


def plans_at(requests: DataFrame, checks: DataFrame) -> DataFrame:
    """requests (licence, now in ms, seq) with plan, by the last check (licence, at, status) of CHECK_TTL_MS before, provider errors left out.

    Without one, or without a licence, the plan is free. Both are cut into spans of that time, and a
    request meets the checks of its span and the one before.
    """
    span = lambda t: F.floor(F.col(t) / CHECK_TTL_MS)
    good = checks.where("status != 'provider_error'").select(F.col("licence").alias("_licence"), "at", "status").withColumn("_span", F.explode(F.array(span("at"), span("at") + 1)))
    near = requests.withColumn("_here", span("now")).join(good, (F.col("licence") == F.col("_licence")) & (F.col("_here") == F.col("_span")) & (F.col("at") <= F.col("now")) & (F.col("at") + CHECK_TTL_MS > F.col("now")), "left")
    last = near.groupBy(*requests.columns).agg(F.max_by("status", "at").alias("_status"))
    return last.withColumn("plan", F.coalesce(plan_of(F.col("_status")), F.lit("free"))).drop("_status")


def active_installs(usage: DataFrame, as_of: Column) -> DataFrame:
    """Installs (month of last use, licensed) to keep: licensed ones, and those used this month or the last."""
    return usage.where(F.col("licensed") | (F.col("month") >= F.date_format(F.add_months(as_of, -1), "yyyy-MM")))


def is_install_id(x: Column) -> Column:
    return x.rlike(INSTALL_ID)


def is_license_key(x: Column) -> Column:
    return x.rlike(LICENSE_KEY)
