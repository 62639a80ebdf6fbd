"""SimHash near-duplicate detection with pigeonring filtering.

The 64 bits of a fingerprint form a ring of nine segments. If two fingerprints differ in at most
tau bits, some segment starts a chain in which every prefix of l segments differs in at most
floor(l * tau / 9) bits (the pigeonring principle). For tau = 4 such a chain begins with two equal
segments, has at most one difference in the next two and at most two in the next four, so one of
five sets of four equal segments holds. Those sets at the nine starts are the 45 keys under which
distinct fingerprints meet; pairs that meet must pass the chain test from that start before the
Hamming distance is taken. Buckets give spanning edges, never pairs; a bucket too large for one
task is split into block pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, edge_batch, fresh, lean, materialize, runs
from .components import connected_components

BITS, SEGMENTS, TAU, WORDS, SEED = 64, 9, 4, 4, 42
#: Fingerprints of one bucket that a task compares itself, larger buckets being split; nodes of a task's forest.
BUCKET, MEMBERS = 4_096, 500_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(data: bytes, width: int = WORDS) -> int:
    """SimHash of the text's word shingles by XXH64 (seed 42); 0 if it has no words."""
    words = data.translate(_LOWER).split()  # bytes.split() cuts at 20 and 09-0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return _majority([xxhash.xxh64_intdigest(joined, SEED)])
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    starts = [0, *ends]
    return _majority([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])])


def _majority(hashes: list[int]) -> int:
    total, n = np.zeros(BITS, np.int64), len(hashes)
    for k in range(0, n, 65_536):
        h = np.array(hashes[k : k + 65_536], np.uint64).astype("<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _segment_masks(segments: int = SEGMENTS) -> list[int]:
    edges = [round(k * BITS / segments) for k in range(segments + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]


def key_masks(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(start, mask of the four equal segments) of each of the 45 keys."""
    seg = _segment_masks(segments)
    out = []
    for start in range(segments):
        at = lambda k: seg[(start + k) % segments]
        sets = [(0, 1, 2, 3)] + [(0, 1, a, b) for a in (2, 3) for b in (4, 5)]
        out += [(start, at(w) | at(x) | at(y) | at(z)) for w, x, y, z in sets]
    return out


def chains(segments: int = SEGMENTS, tau: int = TAU) -> np.ndarray:
    """[start, l]: mask of the l + 1 consecutive segments from start."""
    seg = _segment_masks(segments)
    return np.array([[sum(seg[(s + k) % segments] for k in range(n)) for n in range(1, segments + 1)] for s in range(segments)], np.uint64)


_CHAINS, _BUDGET = chains(), [(n * TAU) // SEGMENTS for n in range(1, SEGMENTS + 1)]
_KEYS = key_masks()
_START = np.array([s for s, _ in _KEYS])


def linked(a: np.ndarray, b: np.ndarray, start) -> np.ndarray:
    """Which pairs are viable along the ring from start and differ in TAU bits at most."""
    x = a ^ b
    ok = np.ones(x.shape, bool)
    for n in (3, 5, 8):  # prefixes of 4, 6 and 9 segments; the last is the full Hamming check
        ok &= np.bitwise_count(x & _CHAINS[start, n]) <= _BUDGET[n]
    return ok


def _spanning(fp: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Tree edges (child, parent) of the link graph of one bucket, by breadth-first search."""
    out, rest = [], np.arange(len(fp))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            hit = linked(fp[rest], fp[p], start)
            if hit.any():
                found = rest[hit]
                out += [(int(c), int(p)) for c in found]
                queue += found.tolist()
                rest = rest[~hit]
    return out


def _bucket_edges(pos: np.ndarray, key: np.ndarray, fp: np.ndarray, forest: Forest) -> None:
    """Joins in forest what links inside runs of equal (pos, key); fp is uint64."""
    cut = runs(pos, key)
    length = np.diff(cut)
    signed = fp.view(np.int64)
    small = np.repeat((length > 1) & (length <= 16), length)
    for shift in range(1, 16):
        i = np.flatnonzero(small[:-shift])
        i = i[(pos[i] == pos[i + shift]) & (key[i] == key[i + shift])]
        if not len(i):
            break
        i = i[linked(fp[i], fp[i + shift], _START[pos[i]])]
        for a, b in zip(signed[i].tolist(), signed[i + shift].tolist()):
            forest.join(a, b)
    for k in np.flatnonzero(length > 16):
        a, b = cut[k], cut[k + 1]
        part = signed[a:b]
        for c, p in _spanning(fp[a:b], int(_START[pos[a]])):
            forest.join(int(part[c]), int(part[p]))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (pos, key, fp) to rows (kind 0, link) or (kind 1, row of a bucket too large)."""
    forest, held, large = Forest(), None, None

    def out(kind, a, b, c):
        n = len(b)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, "i4")), pa.array(a), pa.array(b), pa.array(c)], ["kind", "pos", "a", "b"])

    def work(pos, key, fp):
        _bucket_edges(pos, key, fp.view(np.uint64), forest)

    for b in batches:
        pos, key, fp = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        pos = pos.astype(np.int64)
        if held is not None:
            pos, key, fp = np.concatenate([held[0], pos]), np.concatenate([held[1], key]), np.concatenate([held[2], fp])
        if not len(pos):
            continue
        if large is not None:  # the rest of a large bucket streams through
            same = (pos == large[0]) & (key == large[1])
            n = len(pos) if same.all() else int(np.argmin(same))
            yield out(1, pos[:n].astype("i4"), key[:n], fp[:n])
            pos, key, fp = pos[n:], key[n:], fp[n:]
            held = None
            if not len(pos):
                continue
            large = None
        cut = runs(pos, key)
        last = int(cut[-2])
        for k in np.flatnonzero(np.diff(cut[:-1]) > BUCKET):
            i, j = cut[k], cut[k + 1]
            yield out(1, pos[i:j].astype("i4"), key[i:j], fp[i:j])
        ok = np.repeat(np.diff(cut[:-1]) <= BUCKET, np.diff(cut[:-1]))
        work(pos[:last][ok], key[:last][ok], fp[:last][ok])
        held = pos[last:], key[last:], fp[last:]
        if len(held[0]) > BUCKET:
            large = held[0][0], held[1][0]
            yield out(1, held[0].astype("i4"), held[1], held[2])
            held = None
        if len(forest.up) > MEMBERS:  # bounds it; what is cut here the star steps join
            u, v = forest.edges()
            yield out(0, np.zeros(len(u), "i4"), u, v)
            forest = Forest()
    if held is not None and large is None:
        work(*held)
    u, v = forest.edges()
    yield out(0, np.zeros(len(u), "i4"), u, v)


def _meet_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (pos, key, i, j, fp) of block pairs of large buckets, each of a bounded size."""
    forest, held = Forest(), None
    for b in batches:
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        cols = [np.concatenate(x) for x in zip(held, cols)] if held is not None else cols
        if not len(cols[0]):
            continue
        cut = runs(*cols[:4])
        for i, j in zip(cut[:-2], cut[1:-1]):
            _one_block(cols, i, j, forest)
        if len(forest.up) > MEMBERS:
            yield edge_batch(*forest.edges())
            forest = Forest()
        held = [c[cut[-2] :] for c in cols]
    if held is not None:
        _one_block(held, 0, len(held[0]), forest)
    yield edge_batch(*forest.edges())


def _one_block(cols, i, j, forest):
    fp = cols[4][i:j]
    for c, p in _spanning(fp.view(np.uint64), int(_START[cols[0][i]])):
        forest.join(int(fp[c]), int(fp[p]))


def hamming_edges(fingerprints: DataFrame) -> DataFrame:
    """Edges (u, v) whose components are those of distinct fingerprints (fp) within TAU bits."""
    masks = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for _, m in _KEYS])
    rows = fingerprints.select("fp", F.posexplode(masks).alias("pos", "key")).select("pos", "key", "fp")
    met = rows.repartition("pos", "key").sortWithinPartitions("pos", "key").mapInArrow(_meet, "kind int, pos int, a long, b long")
    met = materialize(met)
    edges = met.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v"))
    large = met.where("kind = 1").select("pos", F.col("a").alias("key"), F.col("b").alias("fp"))
    sizes = large.groupBy("pos", "key").agg(F.ceil(F.count("*") / (BUCKET // 2)).cast("int").alias("n"))
    if sizes.isEmpty():
        return edges
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    parts = large.join(sizes, ["pos", "key"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    parts = parts.select("pos", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    order = ["pos", "key", "i", "j"]
    return edges.unionByName(parts.repartition(*order).sortWithinPartitions(*order).mapInArrow(_meet_blocks, "u long, v long"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [_signed(fingerprint(x)) if x else 0 for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.encode(F.col("text").cast("string"), "utf-8")).mapInArrow(lean(run), "doc_id long, fp long")


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text).

    fingerprint has 16 lowercase hexadecimal digits. component_id is the smallest doc_id that is
    reachable over links of TAU differing bits at most, the row's own included; null only if no
    row of the component has a doc_id. Null, empty and blank texts have fingerprint zero and link
    like any other. Repeated rows and copies are returned each; other columns are ignored; no rows
    give no rows.
    """
    prints = materialize(fingerprints(docs))
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(hamming_edges(classes.select("fp")))
    classes = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = classes.join(least, "root").select("fp", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(classes, "fp", "left").select("doc_id", text.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest doc_id.

    Repeated rows of that doc_id stay; a document without doc_id stays only where its component
    has no doc_id at all. Null, empty and blank texts are copies of one another. Columns stay,
    whatever their names; no rows give no rows.
    """
    found = simhash_components(docs)
    (mine,) = fresh(docs, "kept_doc")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(mine)).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col(mine)), "left_semi")
