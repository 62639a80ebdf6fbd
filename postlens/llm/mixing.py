"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are hashed into blocks of a bounded size, and a source's blocks are permuted.
Its target fixes a quota of blocks: whole passes over the permutation and the head of one more, whose
last block is taken in part. A tree of hypergeometric draws splits the sources' quotas among the
output shards, exactly and without replacement; a shard then draws its own run of each source's
permuted blocks, and a document is taken as often as a shard drew its block. Inside a shard rows
are shuffled by a hash. Only block and source rows are gathered, never documents.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Documents that a block is meant to hold, the output shards, the weights in turn, the most passes.
BLOCK, SHARDS, WEIGHTS, MOST, SEED = 256, 64, (5.0, 2.0, 1.0), 3.0, 20_240_229
#: Blocks whose sizes are summed in one go, units listed in one row, rows of a shard's slice.
SPAN, UNITS, SLICE = 1_024, 4_096, 65_536
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: np.ndarray, weights: np.ndarray, most: float = MOST) -> np.ndarray:
    """The sum of sizes shared by weight; no share above most times its size, the excess reshared."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, cap = np.zeros(len(sizes)), most * sizes
    open_, left = sizes > 0, float(sizes.sum())
    while open_.any() and left > 0:
        share = left * weights / weights[open_].sum()
        over = open_ & (share > cap)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = cap[over]
        left = float(sizes.sum() - out[~open_ | over].sum())
        open_ &= ~over
    return out


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of n units drawn without replacement are good: inversion over all that is not next to impossible.

    Probabilities are built from the mode by their exact ratios, so no size is out of range.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    p = good / (good + bad)
    reach = int(14 * math.sqrt(n * p * (1 - p) * (good + bad - n) / (good + bad - 1))) + 40
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    ratio = (good - k) * (n - k) / ((k + 1) * (bad - n + k + 1))  # of the chance of k + 1 to that of k
    at = mode - a
    weight = np.concatenate([np.cumprod(1 / ratio[:at][::-1])[::-1], [1.0], np.cumprod(ratio[at:])])
    total = np.cumsum(weight)
    return a + int(np.searchsorted(total, rng.random() * total[-1], side="right").clip(0, b - a))


def split_tree(units: int, room: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How many of units each shard gets, drawn without replacement from the shards' free places."""
    if len(room) == 1 or units == 0:
        return np.full(len(room), units if len(room) == 1 else 0, np.int64)
    half = len(room) // 2
    x = hypergeometric(int(room[:half].sum()), int(room[half:].sum()), units, rng)
    return np.concatenate([split_tree(x, room[:half], rng), split_tree(units - x, room[half:], rng)])


def _size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _place(seed: int) -> Column:
    """A document's place in the hash order that deals its source into blocks."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(F.col("text").cast("string")))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


class Plan:
    """What of narrow (source, size, hash) is taken.

    sources: a row for each source (of, blocks, turn, shift, source_size, target, passes, rest).
    drawn: a row for each block (in_source, block, copies: which pass of it which shard drew, whole: whether
    the pass past the whole ones takes all of it). edges: of blocks taken in part, the words of each document.
    """

    def __init__(self, narrow: DataFrame, shards: int, weights, most: float, seed: int, block: int):
        per_source = narrow.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size"))

        def plan(batches):  # a row for each source
            frames = [x for x in batches if len(x)]
            if not frames:
                return
            s = pd.concat(frames).reset_index(drop=True)
            s = s.assign(last=s.source.isna(), name=s.source.fillna("")).sort_values(["last", "name"], kind="stable").reset_index(drop=True)
            s["target"] = targets(s["size"].to_numpy(), np.array([weights[k % len(weights)] for k in range(len(s))]), most)
            s["blocks"] = [max(1, -(-int(n) // block)) for n in s.n]
            rng, turn, shift = np.random.default_rng(seed), [], []
            for n in s.blocks:  # block b stands at place (b * turn + shift) % n of the permutation
                t = int(rng.integers(1, n + 1))
                while math.gcd(t, n) != 1:
                    t += 1
                turn.append(t % n if n > 1 else 1)
                shift.append(int(rng.integers(0, n)))
            yield s.assign(turn=turn, shift=shift)[["source", "n", "size", "target", "blocks", "turn", "shift"]].rename(columns={"source": "of", "n": "documents", "size": "source_size"})

        sources = per_source.coalesce(1).mapInPandas(plan, "of string, documents long, source_size long, target double, blocks long, turn long, shift long")
        words = F.round("target").cast("long")
        sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long"))
        self.sources = sources = materialize(sources.withColumn("rest", words - F.col("passes") * F.col("source_size")))

        blocks = narrow.join(sources.select("of", "blocks"), _same("source", "of")).groupBy("source", F.pmod("hash", "blocks").alias("block")).agg(F.sum("size").alias("size"))
        blocks = blocks.join(sources.select("of", "blocks", "turn", "shift", "rest", "passes"), _same("source", "of"))
        blocks = materialize(blocks.withColumn("index", (F.col("block") * F.col("turn") + F.col("shift")) % F.col("blocks")).withColumn("span", F.floor(F.col("index") / SPAN)).drop("of"))
        # the words up to each block, span by span
        spans = blocks.groupBy("source", "span").agg(F.sum("size").alias("in_span"))
        spans = spans.withColumn("before", F.sum("in_span").over(Window.partitionBy("source").orderBy("span")) - F.col("in_span")).select(F.col("source").alias("of"), F.col("span").alias("of_span"), "before")
        inside = F.sum("size").over(Window.partitionBy("source", "span").orderBy("index")) - F.col("size")
        blocks = blocks.withColumn("inside", inside).join(spans, _same("source", "of") & (F.col("span") == F.col("of_span"))).drop("of", "of_span")
        part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("inside")))
        blocks = materialize(blocks.withColumn("part", part).select("source", "block", "index", "size", "part", "blocks", "passes"))
        units = F.first("blocks") * F.first("passes") + F.coalesce(F.max(F.when(F.col("part") > 0, F.col("index") + 1)), F.lit(0))
        quota = blocks.groupBy("source").agg(units.alias("units"))

        def quotas(batches):  # a row for each source; the state is a number for each shard
            frames = [x for x in batches if len(x)]
            if not frames:
                return
            s = pd.concat(frames).reset_index(drop=True)
            s = s.assign(last=s.source.isna(), name=s.source.fillna("")).sort_values(["last", "name"], kind="stable")
            total = int(s.units.sum())
            room = np.full(shards, total // shards, np.int64)
            room[: total % shards] += 1
            rng, out = np.random.default_rng(seed), []
            for units in s.units.astype(int):
                got = split_tree(units, room, rng)
                room -= got
                out.append([{"shard": k, "first": int(e - n), "units": int(n)} for k, (n, e) in enumerate(zip(got, np.cumsum(got))) if n])
            yield pd.DataFrame({"source": s.source.to_numpy(), "draws": out})

        draws = quota.coalesce(1).mapInPandas(quotas, "source string, draws array<struct<shard: int, first: long, units: long>>")
        draws = draws.select("source", F.inline("draws"))
        # each shard's run of its source's permuted blocks, pass after pass
        draws = draws.withColumn("at", F.explode(F.sequence(F.lit(0), F.floor((F.col("units") - 1) / UNITS)))).withColumn("at", F.col("first") + F.col("at") * UNITS)
        draws = draws.withColumn("unit", F.explode(F.sequence("at", F.least(F.col("at") + UNITS, F.col("first") + F.col("units")) - 1)))
        draws = draws.join(sources.select("of", "blocks"), _same("source", "of"))
        draws = draws.select(F.col("source").alias("of"), (F.col("unit") % F.col("blocks")).alias("place"), F.struct(F.floor(F.col("unit") / F.col("blocks")).cast("int").alias("copy"), "shard").alias("copy"))
        draws = draws.groupBy("of", "place").agg(F.array_sort(F.collect_list("copy")).alias("copies"))
        none = F.array().cast("array<struct<copy:int,shard:int>>")
        drawn = blocks.join(draws, _same("source", "of") & (F.col("index") == F.col("place")), "left")
        self.drawn = materialize(drawn.select(F.col("source").alias("in_source"), "block", F.coalesce("copies", none).alias("copies"), (F.col("part") >= F.col("size")).alias("whole"), "part"))

        edge = self.drawn.where("not whole and part > 0").join(sources.select("of", "blocks"), _same("in_source", "of"))
        held = narrow.join(edge, _same("source", "of") & (F.pmod("hash", "blocks") == F.col("block")))
        held = held.groupBy("of", "part", "hash", "size").agg(F.count("*").alias("times"))
        all_ = F.col("size") * F.col("times")
        left = F.col("part") - F.sum(all_).over(Window.partitionBy("of").orderBy("hash", "size")) + all_
        own = F.floor(F.greatest(F.lit(0), F.least(all_, left)) / F.col("times"))  # rows alike take alike
        self.edges = materialize(held.select(F.col("of").alias("edge_source"), F.col("hash").alias("edge_hash"), F.col("size").alias("edge_size"), own.alias("own")))

    def place(self, docs: DataFrame) -> DataFrame:
        """docs (with source and hash) and what is taken of them: copies (copy, shard, whole, own), empty for none."""
        docs = docs.join(self.sources, _same("source", "of")).withColumn("block_", F.pmod("hash", "blocks"))
        docs = docs.join(self.drawn, _same("source", "in_source") & (F.col("block_") == F.col("block")))
        docs = docs.join(self.edges, _same("source", "edge_source") & (F.col("hash") == F.col("edge_hash")), "left")
        copies = F.transform("copies", lambda c: F.struct(c["copy"].alias("copy"), c["shard"].alias("shard"), ((c["copy"] < F.col("passes")) | F.col("whole") | (F.coalesce("own", F.lit(0)) >= F.col("edge_size"))).alias("whole"), F.coalesce("own", F.lit(0)).alias("own")))
        return docs.withColumn("copies", F.filter(copies, lambda c: c["whole"] | (c["own"] > 0)))


def mix(docs: DataFrame, shards: int = SHARDS, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """The mix's rows: the columns of docs with _size, _source_size, _target, _copy, _words, _whole, _shard, _place.

    A document appears once for each shard's draw that takes words of it (_copy counts the passes
    from 0), with the words taken (_words; _whole if all of them, as for all but a source's last
    block). lay_out() puts the rows into their shards. Null texts have size 0, null sources are a
    source of their own, ordered last; documents of size 0 are taken with their blocks, with no
    words. Documents that nothing is taken of appear once, with _copy and _shard null. Repeated rows
    are rows like any other; columns of docs named like those added give way; no rows give no rows.
    """
    added = ("_size", "_source_size", "_target", "_copy", "_words", "_whole", "_shard", "_place")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    source = F.col("source").cast("string").alias("source")
    plan = Plan(materialize(docs.select(source, _size().alias("size"), _place(seed).alias("hash"))), shards, weights, most, seed, block)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), source, _place(seed).alias("hash"), _size().alias("size"))
    rows = plan.place(rows).withColumn("taken", F.explode_outer("copies"))
    words = F.when(F.col("taken").isNull(), 0).when(F.col("taken.whole"), F.col("size")).otherwise(F.col("taken.own")).cast("long")
    place = F.xxhash64(F.lit("place"), "hash", "taken.copy")
    return rows.select("doc.*", F.col("size").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("taken.copy").alias("_copy"), words.alias("_words"), F.coalesce("taken.whole", F.lit(False)).alias("_whole"), F.col("taken.shard").alias("_shard"), place.alias("_place"))


def lay_out(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows of mix() dealt by their shards, each shard's shuffled (sorted by _place) slice by slice."""
    slices = max(1, -(-rows.count() // (shards * SLICE)))
    return rows.repartition("_shard", F.pmod("_place", F.lit(slices))).sortWithinPartitions("_shard", "_place")


def mix_digest(docs: DataFrame, shards: int = SHARDS, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """One row per document from the draws of mix(): doc_id, size, source_size, target, taken, shards.

    taken counts the words that the shards drew, repeats included; shards are where its copies go.
    Repeated rows take alike and are returned each. Empty tables give no rows.
    """
    narrow = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"), _place(seed).alias("hash")))
    rows = Plan(narrow.select("source", "size", "hash"), shards, weights, most, seed, block).place(narrow)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + F.when(c["whole"], F.col("size")).otherwise(c["own"]))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.transform("copies", lambda c: c["shard"]).alias("shards"))
