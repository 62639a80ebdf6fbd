"""Validity and classes of equal vectors, shared by search and near-duplicate detection."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a usable vector, those vectors in double precision) of a list column.

    Unusable: null, empty, holding null or non-finite components, or zero. A column of differing
    lengths is an error, as products of such vectors have no meaning.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    flat = column.flatten()
    length = np.where(np.asarray(column.is_valid()), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)), 0)
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become nan
    starts = np.concatenate([[0], np.cumsum(length)])
    some = np.flatnonzero(length > 0)
    if not len(some):
        return some, np.zeros((0, 0))
    width = int(length[some[0]])
    if (length[some] != width).any():
        raise ValueError("vectors of differing lengths")
    m = values[starts[some][:, None] + np.arange(width)]
    with np.errstate(invalid="ignore", over="ignore"):
        ok = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
    return some[ok], m[ok]


def lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), kind))


def keyed(vectors: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, key, vector) for each row of vectors (vec_id, embedding), and the type of vector.

    key is a 128-bit digest of a usable vector in double precision, null for others; equal vectors
    have one key. Single precision is carried as such, as it loses nothing.
    """
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind, arrow = ("array<float>", pa.float32()) if single else ("array<double>", pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, m = matrix(b.column(1))
            m = m + 0.0  # one zero
            back = np.full(b.num_rows, -1)
            back[ok] = np.arange(len(ok))
            back = pa.array(back, mask=back < 0)
            key = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in m], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), key.take(back), lists(m, arrow).take(back)], ["vec_id", "key", "vector"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    return rows.mapInArrow(run, f"vec_id long, key binary, vector {kind}"), kind
