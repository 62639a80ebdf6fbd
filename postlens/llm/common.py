"""Shared pieces of the training-data operators: reading, durable cuts of lineage, forests."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Whether shuffle files go when a query has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is set on a single machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="postlens-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts the lineage.

    The copy is on shared storage, so a lost executor costs the running tasks only, and the
    planner knows its size. by: a column whose values get folders of their own, for those who read a few.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/postlens-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")  # the copy is what is read from now on
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df, which nothing may read any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lean(run, rows: int = 1_000):
    """run over slices of the batches; gives freed memory back to the system when it has ended.

    Workers serve one stage after another, so what an allocator holds back would add up.
    """

    def sliced(batches):
        for b in batches:
            for k in range(0, max(1, b.num_rows), rows):
                yield b.slice(k, rows)

    def whole(batches):
        yield from run(sliced(batches))
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores at its end as keep it apart from df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to most, or of one that is larger."""
    i, total = 0, 0
    for k, n in enumerate(sizes):
        if k > i and total + n > most:
            yield i, k
            i, total = k, 0
        total += n
    if i < len(sizes):
        yield i, len(sizes)


class Forest:
    """Union-find over integers that appear in it; the root is the smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (nxt := up.get(root, root)) != root:
            root = nxt
        while x != root:
            up[x], x = root, up.get(x, root)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """One (member, root) pair for each member that is not a root."""
        found = [(x, r) for x in list(self.up) if (r := self.find(x)) != x]
        out = np.array(found, dtype=np.int64).reshape(-1, 2)
        return out[:, 0], out[:, 1]


def edge_batch(u, v) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in arrays sorted by them, with the length at the end."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)
