"""Packing of token sequences by best-fit decreasing.

Texts are tokenized once; overlong ones are first cut into full windows, and what is left over is at most one shorter
piece a text. Only the lengths decide where pieces go, so the driver packs the histogram of lengths: a segment tree
indexed by remaining capacity finds the tightest open window, and all pieces of a length that go to windows of one
remaining capacity go there in one step. That is best-fit decreasing over all pieces in at most some size**2 / 2 steps,
however many pieces there are. Each step is a row (length, first rank, count, first window, offset); a piece finds its row
by its rank among the pieces of its length, which is the rank in its task plus the counts of the tasks before it.

A null text is the empty text: its one id is the end id. Repeated rows are packed as documents of
their own; an empty table gives no pieces. Other columns are not kept.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, ready, staged, trim
from .tokens import MEMORY, encoder

SIZE, END = 2048, 1


class CapacityTree:
    """Counts of open windows by remaining capacity; finds the smallest capacity of at least a length."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, windows: int) -> None:
        k = capacity + self.leaves
        while k:
            self.count[k] += windows
            k >>= 1

    def tightest(self, length: int) -> int | None:
        k = length + self.leaves
        if self.count[k]:
            return length
        while k > 1:
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return None


def best_fit(lengths: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Steps (length, first rank, pieces, first window, offset, pieces a window) and the number of windows."""
    tree, open_ = CapacityTree(size), defaultdict(list)
    steps, windows = [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_[capacity].append((first, n))
            tree.add(capacity, n)

    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, n = size, windows, -(-left // (size // length))
                windows += n
            else:
                first, n = open_[capacity].pop()
                tree.add(capacity, -n)
            # pieces of a length follow one another into a window until no more fits
            each = capacity // length
            whole = min(n, left // each)
            if whole:
                steps.append((length, rank, whole * each, first, size - capacity, each))
                put(capacity - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if left and whole < n:
                steps.append((length, rank, left, first + whole, size - capacity, each))
                put(capacity - left * length, first + whole, 1)
                whole, left = whole + 1, 0
            put(capacity, first + whole, n - whole)
    return steps, windows


class Placement:
    """Where each piece of a length goes, by its rank among them."""

    def __init__(self, steps: list[tuple[int, int, int, int, int, int]]) -> None:
        self.by_length: dict[int, np.ndarray] = {}
        rows = defaultdict(list)
        for length, *rest in steps:
            rows[length].append(rest)
        for length, r in rows.items():
            self.by_length[length] = np.array(sorted(r), dtype="int64")

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        window, offset = np.zeros(len(length), "int64"), np.zeros(len(length), "int64")
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for rows in np.split(order, cuts) if len(order) else ():
            n = int(length[rows[0]])
            table = self.by_length[n]
            step = table[np.searchsorted(table[:, 0], rank[rows], side="right") - 1]
            j = rank[rows] - step[:, 0]
            window[rows] = step[:, 2] + j // step[:, 4]
            offset[rows] = step[:, 3] + j % step[:, 4] * n
        return window, offset


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, ids: bool = True, memory: int = MEMORY) -> DataFrame:
    """The pieces of all texts: full windows and a rest, with their task and rank among its pieces of their length."""
    ready(docs.sparkSession)
    given = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), [0] * (size + 1)
        last, encode = np.array([end], dtype="<u4").tobytes(), encoder(path, memory).encode
        for batch in batches:
            rows: list[tuple] = []
            for k, raw in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()])):
                raw += last
                total = len(raw) // 4
                for start in range(0, total, size):
                    part = raw[4 * start : 4 * (start + size)]
                    n = len(part) // 4
                    rows.append((k, start, n, zlib.crc32(part), total, task, seen[n], part if ids else None))
                    seen[n] += 1
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth", "ids"])
        trim()

    made = given.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, nth long, ids binary")
    return made if ids else made.drop("ids")


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, ids: bool = True, memory: int = MEMORY) -> DataFrame:
    """Pieces of all texts with sequence_id and offset: doc_id, start, length, ids_crc32, doc_tokens and, if asked, ids.

    A worker remembers the ids of as many runs of text as memory says, some 200 bytes each.
    """
    cut, _ = staged(pieces(docs, path, key, text, size, end, ids, memory), "pieces")
    counted = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "task", "base")
    # at most size rows, one for each length
    lengths = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placement = Placement(best_fit(lengths, size)[0])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        claim("packing")
        window, offset = placement.find(length.to_numpy("int64"), rank.to_numpy("int64"))
        return pd.DataFrame({"sequence_id": window, "offset": offset})

    found = cut.join(bases, ["length", "task"]).withColumn("at", place("length", F.col("base") + F.col("nth")))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset", *(["ids"] if ids else []))
