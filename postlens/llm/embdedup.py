"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors are scaled to unit length and quantised to int8 with a scale per vector; what is lost has
a known norm, so the product of two quantised vectors bounds their cosine from both sides. Tiles
of blocks are multiplied as int8 values (exact in single precision); pairs surely above the
threshold link, pairs surely below do not, and only those between are computed again in double
precision. Equal vectors are one class; tiles give link numbers per vector and spanning edges,
never pairs. A block lies in the cell of a pivot, and a vector visits only blocks whose cell's
radius lets a member come near enough (triangle inequality), which prunes clustered data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, materialize
from .components import connected_components
from .vectors import keyed, matrix

THRESHOLD = 0.9
#: Vectors that a block is meant to hold, the most pivots, the rows they are drawn from.
BLOCK, PIVOTS, SAMPLE = 4_096, 256, 4_096
_SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, norm of what the codes miss) of unit vectors."""
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127.0
    code = np.rint(unit / scale).astype(np.int8)
    return code, scale[:, 0], np.linalg.norm(unit - code * scale, axis=1) + _SLACK


def _tile_links(code, scale, lost, vec, other, threshold) -> np.ndarray:
    """Which pairs of two small blocks have a cosine of threshold or more."""
    a, b = other
    dot = code[a].astype(np.float32) @ code[b].astype(np.float32).T
    about = dot * scale[a][:, None] * scale[b][None, :]
    slack = lost[a][:, None] * (1 + lost[b][None, :]) + lost[b][None, :] * (1 + lost[a][:, None]) + 1e-6
    hit = about - slack >= threshold
    i, j = np.nonzero((about + slack >= threshold) & ~hit)
    for k in range(0, len(i), 65_536):
        x, y = vec[a[i[k : k + 65_536]]], vec[b[j[k : k + 65_536]]]
        cos = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        hit[i[k : k + 65_536], j[k : k + 65_536]] = cos >= threshold
    return hit


def _join_tile(hit: np.ndarray, left: np.ndarray, right: np.ndarray, forest: Forest) -> None:
    """Joins what a tile links, with few steps for a dense group: a column remembers who joined it last."""
    label = np.full(len(right), -1, np.int64)
    for r in np.flatnonzero(hit.any(axis=1)):
        c = np.flatnonzero(hit[r])
        me, before = int(left[r]), label[c]
        for x in right[c[before < 0]].tolist():
            forest.join(me, x)
        for x in np.unique(before[before >= 0]).tolist():
            forest.join(me, x)
        label[c] = me


def _tile(threshold: float, step: int = 1024):
    def run(key: tuple[pa.Scalar, ...], tile: pa.Table) -> pa.Table:
        i, j = key[0].as_py(), key[1].as_py()
        node, times, own = (tile.column(c).to_numpy() for c in ("node", "times", "block"))
        _, vec = matrix(tile.column("vector"))
        code, scale, lost = quantise(vec / np.linalg.norm(vec, axis=1, keepdims=True))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        links, forest = np.zeros(len(node), np.int64), Forest()
        for p in range(0, len(left), step):
            for q in range(p if i == j else 0, len(right), step):
                a, b = left[p : p + step], right[q : q + step]
                hit = _tile_links(code, scale, lost, vec, (a, b), threshold)
                same = i == j and p == q
                if same:
                    np.fill_diagonal(hit, False)
                if not hit.any():
                    continue
                links[a] += hit @ times[b]
                if not same:
                    links[b] += hit.T @ times[a]
                _join_tile(hit, node[a], node[b], forest)
        u, v = forest.edges()
        some = links > 0
        cols = [(node[some], u), (links[some], np.zeros(len(u), np.int64)), (node[some], v)]
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in cols], ["node", "links", "to"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding).

    Rows link if the cosine of their vectors, in double precision, is threshold or more, whatever
    their other columns. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing. n_links counts other rows linked directly, repeated rows included;
    component_id is the smallest vec_id reachable, the row's own included (null only if there is
    none); kept says that the row's vec_id is that. No rows give no rows.
    """
    spark = vectors.sparkSession
    rows, kind = keyed(vectors)
    rows = materialize(rows)
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("times"), F.first("vector").alias("vector"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))  # numbers that stay, whoever reads them
    n = classes.count()

    pivots = classes.orderBy("key").limit(SAMPLE).select("vector").toPandas().vector if n else []
    count = min(PIVOTS, -(-n // BLOCK), len(pivots))
    if count:
        pick = np.stack(list(pivots)).astype(float)
        pick /= np.linalg.norm(pick, axis=1, keepdims=True)
        chosen = [0]
        near = pick @ pick[0]
        for _ in range(count - 1):  # each the farthest from those chosen
            chosen.append(int(near.argmin()))
            near = np.maximum(near, pick @ pick[chosen[-1]])
        centre = spark.sparkContext.broadcast(pick[chosen])
    else:
        centre = spark.sparkContext.broadcast(np.zeros((1, 1)))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, m = matrix(b.column("vector"))
            if not len(m):
                continue
            dist = _distance(m, centre.value)
            cell = dist.argmin(axis=1).astype("i4")
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(cell), pa.array(dist[np.arange(len(m)), cell])], ["node", "cell", "far"])

    cell = materialize(classes.select("node", "vector").mapInArrow(cells, "node long, cell int, far double"))
    spec = cell.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # PIVOTS rows at most
    blocks, first = {}, 0
    for r in sorted(spec):
        k = -(-r.n // BLOCK)
        blocks[r.cell] = (first, k, r.radius)
        first += k
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    layout = spark.sparkContext.broadcast(blocks)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, m = matrix(b.column("vector"))
            if not len(m):
                continue
            dist = _distance(m, centre.value)
            cell, node = dist.argmin(axis=1), b.column("node").to_numpy()
            mixed = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own = np.array([layout.value[c][0] for c in cell]) + mixed.astype(np.int64) % np.array([layout.value[c][1] for c in cell])
            for c, (at, k, radius) in layout.value.items():
                hit = np.flatnonzero((dist[:, c] <= radius + reach) | (cell == c))
                for other in range(at, at + k):
                    yield pa.RecordBatch.from_arrays(
                        [b.column("node").take(pa.array(hit)), b.column("times").take(pa.array(hit)), b.column("vector").take(pa.array(hit)), pa.array(own[hit]), pa.array(np.minimum(own[hit], other)), pa.array(np.maximum(own[hit], other))],
                        ["node", "times", "vector", "block", "i", "j"],
                    )

    visits = classes.select("node", "times", "vector").mapInArrow(visit, f"node long, times long, vector {kind}, block long, i long, j long")
    out = materialize(visits.groupBy("i", "j").applyInArrow(_tile(threshold), "node long, links long, to long"))
    roots = connected_components(out.where("node != to").select(F.col("node").alias("u"), F.col("to").alias("v")))
    links = out.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "key", "first", "times").join(links, "node", "left").join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    named = named.join(named.groupBy("root").agg(F.min("first").alias("component")), "root")
    named = named.select("key", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    done = rows.select("vec_id", "key").join(named, "key", "left")
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _distance(m: np.ndarray, centre: np.ndarray) -> np.ndarray:
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    return np.sqrt(np.maximum(0, 2 - 2 * (unit @ centre.T)))
