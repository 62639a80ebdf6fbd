"""Exact substring deduplication by bucket-pointer refinement.

A string of LENGTH bytes is known by the bucket identifiers at its offsets: a position's q-gram
identifier is refined by those of later offsets (2, 4, ... 64 bytes, each made of two of the round
before), and two overlapping ones name the whole string. Identifiers are hashes of the bytes, so
they agree on every executor without a global sort.

Not every position is dealt out. Each string is filed under the q-gram in it whose identifier is
least, so neighbours share an entry and equal strings meet in the same bucket. Inside a bucket,
entries are refined by the identifiers of the whole range they stand for: equal ones but the first
are repeats at once. What differs, and has company in its bucket, goes on in cells of a few strings,
filed under what all strings of a cell share, and only what still has company string by string.
Buckets are read as sorted streams, whatever their size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean, materialize

LENGTH, GRAM, CELL = 100, 32, 8
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)
_PLACE = (1 << 24) - 1
_CHUNK = 1 << 22


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def identifiers(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket identifiers at each position: of the q-gram (GRAM bytes), of the whole string, of its largest power of two.

    The arrays end where a string would pass the end of data.
    """
    at, size, gram = _BYTE[data], 1, None
    power = int(_BASE)
    while size * 2 <= length:
        at = at[:-size] * np.uint64(power) + at[size:]
        power = power * power % (1 << 64)
        size *= 2
        if size == GRAM:
            gram = _mix(at)
    rest = length - size
    whole = _mix(_mix(at[: len(at) - rest]) * _BASE + at[rest:])
    return gram, whole, at


def entries(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(bucket, refined, start, count) of the entries of documents laid end to end.

    An entry stands for the strings at start, start + 1, ... (count of them) of one document.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.view(np.uint64), none.view(np.uint64), none, none
    gram, whole, _ = identifiers(data, length)
    span, n = length - GRAM + 1, len(data) - length + 1
    low = (gram & ~np.uint64(_PLACE)) | np.arange(len(gram), dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[span - size : span - size + n])
    anchor = (low & np.uint64(_PLACE)).astype(np.int64)
    p = np.arange(n)
    doc = np.searchsorted(ends, p, side="right")
    ok = p + length <= ends[doc]
    p, anchor, doc = p[ok], anchor[ok], doc[ok]
    if not len(p):
        return none.view(np.uint64), none.view(np.uint64), none, none
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(p)))
    lo = p[first]
    refined = _mix(whole[lo] * _BASE + whole[lo + count - 1] + count.astype(np.uint64))
    return gram[anchor[first]], refined, lo, count


def _settle(bucket: np.ndarray, refined: np.ndarray, row: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """What a chunk's entries leave for the shuffle: the first of equal ones as it is, the others as spans of repeats.

    Equal refined identifiers stand for equal strings. Repeats are known at once, since their first
    is in the chunk; neighbouring ones become one span, whose count is negative. So a bucket that
    many copies hit gets one entry of each chunk, and the spans are dealt by their rows.
    """
    order = np.lexsort((start, row, refined))
    bucket, refined, row, start, count = (x[order] for x in (bucket, refined, row, start, count))
    equal = refined[1:] == refined[:-1]
    same = np.append(False, equal & (row[1:] == row[:-1]) & (start[1:] == start[:-1]))  # a row that is there twice
    again = np.append(False, equal) & ~same
    first = np.flatnonzero(~again & ~same)
    r, a, n = row[again], start[again], count[again]
    order = np.lexsort((a, r))
    r, a, n = r[order], a[order], n[order]
    cut = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (a[1:] > a[:-1] + n[:-1] - 1 + LENGTH))) if len(r) else np.zeros(0, np.int64)
    last = np.append(cut[1:], len(r)) - 1 if len(cut) else cut
    spans = a[last] + n[last] - a[cut]
    dealt = _mix(r[cut].astype(np.uint64)).view(np.int64)
    cols = [np.concatenate(x) for x in ((bucket[first], dealt), (refined[first], dealt), (row[first], r[cut]), (start[first], a[cut]), (count[first], -spans))]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, ("i8", "i8", "i8", "i4", "i4"))], ["bucket", "refined", "row", "start", "count"])


def _file_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) to (bucket, refined, row, start, count)."""
    for b in batches:
        numbers, one = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_index=True)
        texts = b.column(1).take(pa.array(one)).to_pylist()
        for i, j in chunks([len(x) for x in texts], _CHUNK):
            if j - i == 1 and len(texts[i]) > _CHUNK:  # a very long text goes on in overlapping parts
                parts = [(texts[i][a : a + _CHUNK + LENGTH - 1], a) for a in range(0, len(texts[i]), _CHUNK)]
            else:
                parts = [(b"".join(texts[i:j]), 0)]
            for text, shift in parts:
                lengths = [len(x) for x in texts[i:j]] if len(parts) == 1 else [len(text)]
                ends = np.cumsum(lengths)
                bucket, refined, lo, count = entries(np.frombuffer(text, np.uint8), ends)
                k = np.searchsorted(ends, lo, side="right")
                yield _settle(bucket.view(np.int64), refined.view(np.int64), numbers[i:j][k], lo - (ends - lengths)[k] + shift, count)


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by bucket, refined, row, start: repeats (kind 0), and firsts with company (kind 1)."""
    last, wait = None, None  # the current first; and whether it was told

    def out(kind, bucket, row, start, count):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), kind, "i4")), pa.array(bucket), pa.array(row), pa.array(start), pa.array(count)], ["kind", "bucket", "row", "start", "count"])

    for b in batches:
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        span = cols[4] < 0
        if span.any():  # settled before the shuffle
            yield out(0, cols[0][span], cols[2][span], cols[3][span], -cols[4][span])
            cols = [c[~span] for c in cols]
        if not len(cols[0]):
            continue
        if last is not None:
            cols = [np.concatenate([[x], c]).astype(c.dtype) for x, c in zip(last, cols)]
        bucket, refined, row, start, count = cols
        new = np.append(True, (bucket[1:] != bucket[:-1]) | (refined[1:] != refined[:-1]))
        first = np.flatnonzero(new)
        of = first[np.cumsum(new) - 1]
        again = (row != row[of]) | (start != start[of])
        yield out(0, *(c[again] for c in (bucket, row, start, count)))
        fb = bucket[first]
        near = fb[1:] == fb[:-1]
        company = np.append(near, False) | np.append(False, near)
        told = np.zeros(len(first), bool)
        if wait is not None:
            told[0] = wait
        tell = first[company & ~told]
        yield out(1, *(c[tell] for c in (bucket, row, start, count)))
        wait = bool(company[-1] or told[-1])
        last = tuple(c[first[-1]] for c in cols)


def _again(single: bool):
    """(row, text, [(bucket, start, count)]) to finer entries: cells, or single strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(0).to_numpy(zero_copy_only=False)
            lists = b.column(2)
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            bucket, start, count = (lists.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            found, size = [], 0
            for k, text in enumerate(b.column(1).to_pylist()):
                mine = slice(at[k], at[k + 1])
                filed, refined, lo, n = (_single if single else _cells)(np.frombuffer(text, np.uint8), bucket[mine], start[mine], count[mine])
                found.append((filed, refined.view(np.int64), np.full(len(lo), rows[k]), lo, n))
                size += len(lo)
                if size > _CHUNK // 8:
                    yield _settle(*map(np.concatenate, zip(*found)))
                    found, size = [], 0
            if found:
                yield _settle(*map(np.concatenate, zip(*found)))

    return run


def _spread(count: np.ndarray) -> np.ndarray:
    """0, 1, ... count - 1 for each count in turn."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _single(data, bucket, lo, count):
    _, whole, _ = identifiers(data)
    p = np.repeat(lo, count) + _spread(count)
    return np.repeat(bucket, count), whole[p], p, np.ones_like(p)


def _cells(data, bucket, lo, count):
    """Entries cut along a grid of CELL places before their q-gram, filed by what a cell's strings share."""
    gram, whole, half = identifiers(data)
    low = gram & ~np.uint64(_PLACE)
    anchor = np.concatenate([lo[i : i + 4096] + low[lo[i : i + 4096][:, None] + np.arange(LENGTH - GRAM + 1)].argmin(axis=1) for i in range(0, len(lo), 4096)])
    far, near = anchor - lo, anchor - lo - count + 1  # of a string's start before the q-gram
    cells = far // CELL - near // CELL + 1
    cell = np.repeat(near // CELL, cells) + _spread(cells)
    anchor = np.repeat(anchor, cells)
    top = np.minimum(np.repeat(far, cells), cell * CELL + CELL - 1)
    bottom = np.maximum(np.repeat(near, cells), cell * CELL)
    lo, count = anchor - top, top - bottom + 1
    shared = anchor - cell * CELL  # LENGTH - CELL + 1 bytes from here are in every string of the cell
    size = 1 << (LENGTH.bit_length() - 1)
    core = _mix(half[shared] * _BASE + half[shared + LENGTH - CELL + 1 - size])
    filed = _mix(core * _BASE + cell.astype(np.uint64)) ^ np.repeat(bucket, cells).view(np.uint64)
    refined = _mix(whole[lo] * _BASE + whole[lo + count - 1] + count.astype(np.uint64))
    return filed.view(np.int64), refined, lo, count


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            n = len(text)
            if not found:
                rows.append((n, 0, 0, hashlib.sha256(text).hexdigest()))
                continue
            lo, count = np.array([x["start"] for x in found], np.int64), np.array([x["count"] for x in found], np.int64)
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, lo, 1)
            np.add.at(step, lo + count - 1 + LENGTH, -1)
            gone = np.cumsum(step[:n]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((n, int(gone.sum()), spans, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()))
        cols = list(zip(*rows)) if rows else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text as binary), written: row numbers the distinct (doc_id, text) in their order.

    Rows of one doc_id go by a digest of their texts; a null doc_id comes last.
    """
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    distinct = docs.select("doc_id", "digest").distinct().orderBy(F.asc_nulls_last("doc_id"), "digest")
    numbers = materialize(distinct.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), F.monotonically_increasing_id().alias("row")))
    return materialize(docs.join(numbers, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g"))).select("row", "doc_id", "text"))


def repeated_strings(docs: DataFrame) -> DataFrame:
    """(row, start, count) of what starts earlier too, for docs (row, text as binary): count neighbouring strings."""
    order = ["bucket", "refined", "row", "start"]
    long_enough = docs.where(F.length("text") >= LENGTH).select("row", "text")
    schema = "bucket long, refined long, row long, start int, count int"

    def met(entries: DataFrame) -> DataFrame:
        return materialize(entries.repartition("bucket").sortWithinPartitions(*order).mapInArrow(_refine, "kind int, bucket long, row long, start int, count int"))

    found = [met(long_enough.mapInArrow(lean(_file_entries), schema))]
    for single in (False, True):
        firsts = found[-1].where("kind = 1").groupBy("row").agg(F.collect_list(F.struct("bucket", "start", "count")).alias("entries"))
        found.append(met(long_enough.join(firsts, "row").select("row", "text", "entries").mapInArrow(lean(_again(single)), schema)))
    return reduce(DataFrame.unionByName, [x.where("kind = 0").select("row", "start", "count") for x in found])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs (doc_id, text).

    Removes each byte covered by a string of LENGTH bytes that starts earlier too, in a smaller
    doc_id or earlier in the same document, judged on the input. Null texts count as empty. A null
    doc_id comes after all others. Rows that share a doc_id but not the text are documents of
    their own, in an order that their contents fix; rows equal in both are one document, returned
    each. Texts of any length are read whole, in overlapping parts. Other columns are ignored; no
    rows give no rows.
    """
    docs = numbered(docs)
    gone = repeated_strings(docs).groupBy("row").agg(F.collect_list(F.struct("start", "count")).alias("gone"))
    done = docs.join(gone, "row", "left").select("doc_id", "text", "gone")
    return done.mapInArrow(lean(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
