"""Helpers shared by the operators: staging tables, ordered buckets and vectorised word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: whole texts are some kilobytes each, so a batch stays at a few megabytes.
BATCH_ROWS = 512
#: Bytes of one Arrow batch, about; a row is never cut.
BATCH_BYTES = 8 << 20
#: Bytes of text handled by one vectorised step; a longer text is one step of its own.
STEP_BYTES = 1 << 18

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LEFT: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a session of one process (tests) without one gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sheaf-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def ready(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by rows and bytes, as texts are wide.

    It stays so: the setting is read when a plan runs, which is after the operator that made it has returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _LEFT:
        try:
            remove(spark, path)
        except Exception:  # the session is gone: nothing to do at exit
            return


def write(df: DataFrame, path: str) -> None:
    """Write df, and drop its shuffle files when that is done: what was written is read from the folder from now on."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: it cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write(df, path)
    _LEFT.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, path: str) -> None:
    """Drop a staged table that nothing reads any more."""
    remove(spark, path)
    if (spark, path) in _LEFT:
        _LEFT.remove((spark, path))


def bucket_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending cuts of an integer key, by approximate quantiles (n numbers on the driver)."""
    if n < 2:
        return []
    cuts = df.select(F.col(key).cast("double")).approxQuantile(key, [i / n for i in range(1, n)], 1 / (4 * n))
    return sorted({int(c) for c in cuts})


def bucket_of(key: str, bounds: list[int]) -> Column:
    """The number of cuts at or below a column of integers, as a tree of comparisons; null keys come first."""

    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"CASE WHEN `{key}` < {bounds[middle]}L THEN {tree(low, middle)} ELSE {tree(middle + 1, high)} END"

    return F.when(F.col(key).isNull(), 0).otherwise(F.expr(tree(0, len(bounds)))).cast("int")


def left_since(mark: int, keep: str) -> None:
    """Drop the tables staged since mark (see ``staged_so_far``) but the one to keep."""
    for spark, path in _LEFT[mark:]:
        if path != keep:
            release(spark, path)


def staged_so_far() -> int:
    return len(_LEFT)


def settle(spark: SparkSession) -> None:
    """Collect the driver's garbage, in Python and the JVM: what a long plan or a trained model leaves is given back."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()


_OWNER = ""
_FORGET: dict[str, Callable[[], None]] = {}


def claim(owner: str, forget: Callable[[], None] | None = None) -> None:
    """Say whose task this worker runs: what it remembers for other operators' tasks is dropped."""
    global _OWNER
    if forget is not None:
        _FORGET[owner] = forget
    if _OWNER != owner:
        for name, drop in _FORGET.items():
            if name != owner:
                drop()
        trim()
        _OWNER = owner


def trim() -> None:
    """Give memory that a task no longer uses back to the system: a reused worker would keep it from the others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


# ---------------------------------------------------------------- Arrow columns as bytes


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n, shift = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], dtype="int64")[shift : shift + n + 1] if n else np.zeros(1, "int64")
    data = column.buffers()[2]
    return np.frombuffer(data, dtype="uint8") if data is not None and data.size else np.zeros(0, "uint8"), offsets


def steps(offsets: np.ndarray, limit: int = STEP_BYTES):
    """Ranges of rows of about limit bytes each."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = last


# ---------------------------------------------------------------- word hashes

_LOWER = np.arange(256, dtype="uint8")
_LOWER[65:91] += 32
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15 | 1), 1 << 16
_POWERS: list[np.ndarray] = [np.ones(1, "uint64"), np.ones(1, "uint64")]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each bit depends on all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, STEP_BYTES)
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            x = np.full(size, base, dtype="uint64")
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(data: np.ndarray, ends: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes outside gaps, A-Z lower-cased) and, by row, the n + 1 offsets of its words.

    data holds the rows' bytes one after another, ends the n + 1 offsets of rows from 0.
    """
    n = len(data)
    at = np.zeros(len(ends), dtype="int64")
    if not n:
        return np.zeros(0, "uint64"), at
    low = _LOWER[data]
    inside = ~gaps[low]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = ends[(ends > 0) & (ends < n)]
    before[edges] = False
    after[edges - 1] = False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
    powers, inverse = _powers(n)
    total = np.cumsum((low.astype("uint64") + np.uint64(1)) * powers, dtype="uint64")
    h = total[last]
    h[first > 0] -= total[first[first > 0] - 1]
    h *= inverse[first]
    return mix(h), np.searchsorted(first, ends)


def shingles(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words within rows, and the rows' n + 1 offsets; a row of fewer words is one run, of none no run."""
    counts = np.diff(at)
    if not len(words):
        return np.zeros(0, "uint64"), np.zeros(len(at), "int64")
    h = np.zeros(len(words), "uint64")
    row_end = np.repeat(at[1:], counts)
    here = np.arange(len(words))
    for j in range(k):
        there = here + j
        ok = there < row_end
        part = np.where(ok, words[np.minimum(there, len(words) - 1)], np.uint64(0))
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + part + np.uint64(j + 1))
    keep = here + k <= row_end
    short = np.flatnonzero((counts > 0) & (counts < k))
    keep[at[short]] = True
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype("int64"))
    return h[keep], np.concatenate([[0], np.cumsum(sizes)])
