"""Token ids stored as Re-Pair grammars.

Documents are dealt to shards of consecutive keys and sorted there. A shard is written as blocks of about BLOCK ids,
always at document ends. In a block, the frequent pairs of neighbouring ids are replaced by nonterminals, round after
round, pairs of nonterminals too; a round counts pairs exactly and takes all that stand often enough, from left to
right without overlaps. Rounds end when no pair stands FREQUENT times. A block holds its rules (pairs of symbols), the expansion length of every rule, and the remaining symbols, so
that any range of ids is found by the symbols' lengths and only those symbols are expanded.

The files are a Parquet folder of blocks: shard, block, start (ids of the shard before it), n_ids, doc_ids, doc_lengths
and grammar (bytes, see ``Grammar``); Spark's commit protocol keeps them whole if executors are lost.

A null text is the empty text: its one id is the end id. Null keys come first and ties are ordered by text, so repeated
rows follow one another. An empty table writes no blocks. Other columns are not kept.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LEFT, bucket_bounds, bucket_of, partitions, ready, shared_dir, write
from .tokens import encoder

END = 1
#: Ids of a block, occurrences that make a pair frequent, and bits of the filter by which frequent pairs are found.
BLOCK, FREQUENT, BITS = 1 << 19, 16, 18
#: Runs of text that a worker remembers, some 200 bytes each.
RUNS = 1_500_000
_MAGIC = b"RPG1"


def _copy(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of flat, one after another."""
    ends = np.cumsum(size)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)]


@dataclass
class Grammar:
    """Symbols below base are ids; base + k is rule k, whose two symbols stand for lengths[k] ids."""

    base: int
    rules: np.ndarray  # k x 2
    lengths: np.ndarray
    symbols: np.ndarray
    table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def to_bytes(self) -> bytes:
        wide = 2 if self.symbols.dtype == np.uint16 else 4
        head = np.array([self.base, len(self.rules), len(self.symbols), wide], dtype="<u4")
        return _MAGIC + b"".join(x.astype("<u4").tobytes() for x in (head, self.rules, self.lengths)) + self.symbols.astype(f"<u{wide}").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Grammar:
        if data[:4] != _MAGIC:
            raise ValueError("not a grammar block")
        base, k, n, wide = (int(v) for v in np.frombuffer(data, dtype="<u4", offset=4, count=4))
        rules = np.frombuffer(data, dtype="<u4", offset=20, count=2 * k).reshape(k, 2)
        lengths = np.frombuffer(data, dtype="<u4", offset=20 + 8 * k, count=k)
        return cls(base, rules, lengths, np.frombuffer(data, dtype=f"<u{wide}", offset=20 + 12 * k, count=n))

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        table = np.concatenate([[1], self.lengths]).astype("int64")
        return table[np.where(symbols >= self.base, symbols.astype("int64") - self.base + 1, 0)]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for, copied from one table of all expansions."""
        if not len(self.rules):
            return symbols.astype("<u4")
        if self.table is None:
            flat = np.arange(self.base, dtype="<u4")
            begin, size = np.arange(self.base, dtype="int64"), np.ones(self.base, "int64")
            done = 0
            while done < len(self.rules):
                # rules whose symbols are expanded already: those of one round
                more = self.rules[done:]
                ready = int(np.argmax(more.max(axis=1) >= self.base + done)) if (more.max(axis=1) >= self.base + done).any() else len(more)
                part = more[:ready].ravel().astype("int64")
                new = _copy(flat, begin[part], size[part])
                sizes = size[part].reshape(-1, 2).sum(axis=1)
                begin = np.concatenate([begin, len(flat) + np.cumsum(sizes) - sizes])
                size = np.concatenate([size, sizes])
                flat = np.concatenate([flat, new])
                done += ready
            self.table = (flat, begin, size)
        flat, begin, size = self.table
        return _copy(flat, begin[symbols], size[symbols])

    def ids(self, start: int = 0, count: int | None = None) -> np.ndarray:
        """A range of the block's ids; only the symbols that hold it are expanded."""
        ends = np.cumsum(self.sizes(self.symbols))
        total = int(ends[-1]) if len(ends) else 0
        stop = total if count is None else min(total, start + count)
        if start >= stop:
            return np.zeros(0, dtype="<u4")
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left")
        before = int(ends[a - 1]) if a else 0
        return self.expand(self.symbols[a : b + 1])[start - before : stop - before]


def compress(ids: np.ndarray, base: int, frequent: int = FREQUENT) -> Grammar:
    """The grammar of a block of ids, all of them below base; no pair of its symbols stands frequent times."""
    # symbols take 16 bits as long as there is room for rules beside the vocabulary
    room = (1 << 16) - base
    half = 16 if room >= 4096 else 32
    kind = np.uint32 if half == 16 else np.uint64
    symbols = ids.astype("uint16" if half == 16 else "uint32")
    rules, lengths = [np.zeros((0, 2), "uint32")], [np.zeros(0, "uint32")]
    size_of, made = np.ones(1, "uint32"), 0
    held, fresh = np.full(1 << BITS, -1, "int32"), 0
    while len(symbols) > 1:
        pairs = symbols[:-1].astype(kind) << kind(half) | symbols[1:].astype(kind)
        slot = ((pairs * kind(0x9E3779B97F4A7C15 >> (64 - 2 * half))) >> kind(2 * half - BITS)).astype("int32")
        # only pairs with a symbol of the last round, or that were frequent in it, can be frequent now
        new = symbols >= fresh
        look = np.flatnonzero(new[:-1] | new[1:] | (held[slot] >= 0))
        seen = np.sort(pairs[look])
        edge = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]])[: len(seen)])
        often = seen[edge[np.diff(np.append(edge, len(seen))) >= frequent]]
        if not len(often):
            break
        # frequent pairs are found by slot; one that shares its slot with another one is searched for
        held[:] = -1
        held[((often * kind(0x9E3779B97F4A7C15 >> (64 - 2 * half))) >> kind(2 * half - BITS)).astype("int32")] = np.arange(len(often), dtype="int32")
        at = look[held[slot[look]] >= 0]
        rule, own = held[slot[at]], pairs[at]
        other = np.flatnonzero(often[rule] != own)
        rule[other] = np.minimum(np.searchsorted(often, own[other]), len(often) - 1)
        same = often[rule] == own
        at, rule = at[same], rule[same]
        # in a run of pairs that overlap, every second one from the left is replaced
        place = np.arange(len(at), dtype="int32")
        run = place.copy()
        run[1:][np.diff(at) == 1] = 0
        take = (place - np.maximum.accumulate(run)) & 1 == 0
        at, rule = at[take], rule[take]
        # pairs that are left with a few places wait for a later round; at least half of all places are taken, so some pair is not
        used = np.bincount(rule, minlength=len(often)) >= frequent // 2
        at, rule = at[used[rule]], rule[used[rule]]
        found = often[used]
        if half == 16 and made + len(found) > room:
            # no room: the block goes on with symbols of 32 bits, and all pairs are counted again
            half, kind, symbols, fresh = 32, np.uint64, symbols.astype("uint32"), 0
            continue
        new_of = np.cumsum(used) - 1
        two = np.stack([found >> kind(half), found & kind((1 << half) - 1)], axis=1).astype("uint32")
        known = np.where(two >= base, two.astype("int64") - base + 1, 0)
        rules.append(two)
        lengths.append(size_of[known].sum(axis=1).astype("uint32"))
        size_of = np.concatenate([size_of, lengths[-1]])
        fresh = base + made
        symbols[at] = fresh + new_of[rule]
        made += len(two)
        gone = np.ones(len(symbols), bool)
        gone[at + 1] = False
        symbols = symbols[gone]
    return Grammar(base, np.concatenate(rules), np.concatenate(lengths), symbols)


def write_ids(docs: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text", end: int = END) -> None:
    """Tokenize all texts, end each with the end id, and write them in ascending order of the key to a folder."""
    spark = docs.sparkSession
    ready(spark)
    n = partitions(spark)
    bounds = bucket_bounds(docs, key, n)
    given = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).withColumn("b", bucket_of("k", bounds))
    dealt = given.repartitionById(max(n, len(bounds) + 1), F.col("b")).sortWithinPartitions("b", F.col("k").asc_nulls_first(), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, RUNS)
        base = max(tool.library.get_vocab_size(with_added_tokens=True), end + 1)
        last = np.array([end], dtype="<u4").tobytes()
        keys: list[int | None] = []
        parts: list[bytes] = []
        shard, block, start, held = None, 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held
            sizes = np.array([len(p) // 4 for p in parts], dtype="<i8")
            grammar = compress(np.frombuffer(b"".join(parts), dtype="<u4"), base)
            row = [[shard], [block], [start], [held], [keys.copy()], [sizes.tobytes()], [grammar.to_bytes()]]
            block, start, held = block + 1, start + held, 0
            keys.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()))], names=["shard", "block", "start", "n_ids", "doc_ids", "doc_lengths", "grammar"])

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for k, raw, b in zip(batch.column(0).to_pylist(), tool.encode(texts), batch.column(2).to_pylist()):
                if shard != b:
                    if parts:
                        yield flush()
                    shard, block, start = b, 0, 0
                keys.append(k)
                parts.append(raw + last)
                held += len(raw) // 4 + 1
                if held >= BLOCK:
                    yield flush()
        if parts:
            yield flush()

    write(dealt.mapInArrow(run, "shard int, block int, start long, n_ids long, doc_ids array<long>, doc_lengths binary, grammar binary"), folder)


def shard_starts(blocks: DataFrame) -> dict[int, int]:
    """Ids of all shards before each (a row per shard on the driver)."""
    out, total = {}, 0
    for row in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():
        out[row["shard"]] = total
        total += row["n"]
    return out


def read_ids(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """The documents of a folder: doc_id, start, n_tokens, ids_crc32 and, if asked, ids (little-endian, 32 bits)."""
    ready(spark)
    blocks = spark.read.parquet(folder)
    starts = shard_starts(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grammar = Grammar.from_bytes(row["grammar"])
                whole = grammar.expand(grammar.symbols).astype("<u4").tobytes()
                sizes = np.frombuffer(row["doc_lengths"], dtype="<i8")
                ends = np.cumsum(sizes)
                first = starts[row["shard"]] + row["start"]
                parts = [whole[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist())]
                made = [pa.array(row["doc_ids"], pa.int64()), pa.array(first + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*made, pa.array(parts, pa.binary())] if ids else made, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    return blocks.select("shard", "start", "doc_ids", "doc_lengths", "grammar").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def new_folder(spark: SparkSession, name: str = "ids") -> str:
    """A folder of its own in the shared one, removed at the session's end."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _LEFT.append((spark, folder))
    return folder
