"""Connected components by alternating large-star and small-star steps.

Each step is a minimum per node (combined map-side) joined back to the edges, so no node's
neighbours are ever gathered in one row; AQE splits the join of a hub. Edges are first thinned to
a spanning forest inside each partition. Every round is written to the shared
folder, and the one before it deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, discard, edge_batch, materialize


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest, seen = Forest(), 0
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            forest.join(u, v)
        seen += b.num_rows
        if seen > 500_000:  # bounds the forest; the star steps join what is cut here
            yield edge_batch(*forest.edges())
            forest, seen = Forest(), 0
    yield edge_batch(*forest.edges())


def thin(edges: DataFrame) -> DataFrame:
    """A spanning forest of each partition's edges, for edges (u, v) of type long."""
    return edges.select("u", "v").mapInArrow(_thin, "u long, v long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v) that is not its own root.

    The root is the smallest node of the component. Self loops, repeated and reversed edges are
    harmless; rows with a null end are left out; no edges give no rows.
    """
    e = edges.where("u is not null and v is not null and u != v")
    e = materialize(thin(e).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(before)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            found = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            found._written = e._written  # for discard()
            return found
        mark = now
