"""Packing of token sequences by minimum bin slack.

Pieces of one length are alike, so the packing is made over the histogram of lengths, which never
has more rows than a sequence has places. For each bin a bitset subset-sum over the lengths left
finds the fullest feasible combination that holds the longest one; it is taken as often as the
counts allow and removed. Pieces then find their bin by their rank among the pieces of their
length; a rank is a count per (length, salt) cell plus the place inside a cell. A length has as many
salts as its pieces need for cells of a bounded size, so there are few cells more than pieces / CELL.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialize
from .tokens import Counter2, default_vocabulary

#: Pieces that a salt's cell is meant to hold.
CELL = 1_024


def token_pieces(docs: DataFrame, capacity: int = 2048, path: str | None = None, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Cuts each document's ids (with end_id at the end) into pieces of at most capacity.

    A document that fits is one piece; of a longer one only the first piece may be shorter.
    Null and empty texts are one piece of length 1 (the end_id). Rows: doc_id, piece, start,
    length, ids_crc32, and ids if keep_ids.
    """
    path = path or default_vocabulary()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Counter2(path, "ids")
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = (encode(text) if text else b"") + end
                n = len(data) // 4
                first = n % capacity or capacity
                edges = [0, *range(first, n, capacity), n] if n > capacity else [0, n]
                for k, (i, j) in enumerate(zip(edges, edges[1:])):
                    part = data[4 * i : 4 * j]
                    rows.append((doc, k, i, j - i, zlib.crc32(part)) + ((np.frombuffer(part, "<u4").astype("i4").tolist(),) if keep_ids else ()))
            cols = list(zip(*rows)) if rows else [()] * (5 + keep_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(cut), schema)


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """The (length, times) whose sum comes nearest to room without passing it; lengths fall."""
    usable = [x for x in lengths if x <= room]
    reach, steps, goal, mask = 1, [], 1 << room, (1 << (room + 1)) - 1
    for x in usable:
        steps.append((x, reach))
        left, part = min(counts[x], room // x), 1
        while left:  # so many times at most, by doubling
            part = min(part, left)
            reach |= (reach << (x * part)) & mask
            left -= part
            part *= 2
        if reach & goal:
            break
    at, out = reach.bit_length() - 1, []
    for x, before in reversed(steps):
        k = 0
        while not before >> (at - k * x) & 1:
            k += 1
        if k:
            out.append((x, k))
            at -= k * x
    return out


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[(combination, how many bins have it)] that uses up the histogram {length: count}."""
    counts = {x: n for x, n in histogram.items() if n > 0}
    out = []
    while counts:
        lengths = sorted(counts, reverse=True)
        longest = lengths[0]
        counts[longest] -= 1
        inner = dict(fullest({**counts}, [x for x in lengths if counts[x]], capacity - longest)) if capacity > longest else {}
        counts[longest] += 1
        inner[longest] = inner.get(longest, 0) + 1
        times = min(counts[x] // k for x, k in inner.items())
        for x, k in inner.items():
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
        out.append((sorted(inner.items(), reverse=True), times))
    return out


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces with a column length (1 to capacity).

    Every piece goes to exactly one sequence; a sequence's pieces stand gapless from 0. Repeated
    rows are placed each, in any order; other columns stay, whatever their names but sequence_id
    and offset, which give way; no rows give no rows. A length outside 1..capacity, or none, is an
    error, as no sequence can hold it.
    """
    pieces = pieces.select(*[F.col(f"`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset")])
    ok = F.coalesce(F.col("length").between(1, capacity), F.lit(False))
    pieces = pieces.withColumn("length", F.when(ok, F.col("length")).otherwise(F.raise_error(F.lit(f"a piece's length must be 1 to {capacity}")).cast("long")))
    number = F.xxhash64(F.monotonically_increasing_id())  # written, so that it stays, and no two rows share a cell for being equal
    rows = materialize(pieces.select(F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("of"), F.col("length").cast("long").alias("length"), number.alias("number")))
    histogram = {int(r[0]): int(r[1]) for r in rows.groupBy("length").count().collect()}  # capacity rows at most
    salts = pieces.sparkSession.createDataFrame([(x, -(-n // CELL)) for x, n in histogram.items()] or [(0, 1)], "of_length long, salts int")
    salted = rows.join(F.broadcast(salts), F.col("length") == F.col("of_length")).withColumn("salt", F.pmod("number", "salts").cast("int"))  # a row for each length
    cells = materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))

    ranges: dict[int, list[tuple[int, int, int, int]]] = {}  # length: (first rank, first bin, times in a bin, place in it)
    used, bins = dict.fromkeys(histogram, 0), 0
    for combination, times in plan_bins(histogram, capacity):
        place = 0
        for x, k in combination:
            ranges.setdefault(x, []).append((used[x], bins, k, place))
            used[x] += k * times
            place += k * x
        bins += times
    lookup = pieces.sparkSession.sparkContext.broadcast({x: np.array(r, np.int64).T for x, r in ranges.items()})

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("length", "salt").orderBy("number")
    ranked = salted.join(starts, ["length", "salt"]).select("of", "length", (F.col("start") + F.row_number().over(inside) - 1).alias("rank"))
    ranked = ranked.select("of.*", F.col("length").alias("length_"), "rank")
    names, width = pieces.columns, len(pieces.columns)

    def place_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(width + k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            seq, at = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                hit = length == x
                first, bin0, times, place = lookup.value[int(x)]
                k = np.searchsorted(first, rank[hit], side="right") - 1
                more = rank[hit] - first[k]
                seq[hit] = bin0[k] + more // times[k]
                at[hit] = place[k] + more % times[k] * x
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(seq), pa.array(at)], [*names, "sequence_id", "offset"])

    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place_all, schema)


def pack_documents(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """token_pieces() packed by pack(): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of length 1; texts of any length are encoded whole. Null
    doc_ids and repeated rows are packed like any other; other columns are ignored; no rows give
    no rows.
    """
    return pack(token_pieces(docs, capacity, path), capacity)
