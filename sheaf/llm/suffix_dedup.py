"""Removal of byte strings that repeat earlier documents, on a sparse suffix array.

Each byte covered by a string of LENGTH bytes that also starts in a document of a smaller id is removed. Sorting a suffix
for every byte would move many times the input, so suffixes are grouped where their content says so: of the GRAM-byte
words in a string of LENGTH bytes, the one with the smallest hash is the string's leading token, the same wherever
the string stands. Neighbouring strings share it, so a text is a sequence of runs (leading token, bytes), about one for
sixteen bytes, and equal strings lie in runs of equal leading tokens.

1. Texts go to shards by the hash of their ids. Each shard sends its distinct runs, as hashes of token and bytes with the
   smallest id that has the run, to buckets: ranges of leading tokens between sampled splitters. A bucket sorts its runs
   and compares neighbours: equal runs are covered in all shards but the one of the smallest id; tokens with different
   runs in different shards are undecided.
2. Shards send the bytes of undecided runs, each from the shard of its smallest id alone. A bucket sorts all their
   suffixes of LENGTH bytes by multikey quicksort (eight bytes at a time, splitting ties further) and compares
   neighbours: a suffix that a run of a smaller id holds is covered. A token with more than HOT undecided runs is split:
   its suffixes go, one by one, to buckets by their own hash, so no bucket takes all that stands around a common word.
3. In its shard a run is covered if an earlier document has it, and undecided runs are sorted as in 2.

Equal suffixes never lie in two buckets, so no comparison crosses a bucket's boundary, and as only distinct runs leave a
shard, a passage that stands in a third of all documents is a few rows a shard. Three passes shuffle the texts; only
hashes and undecided runs move besides. A task takes its shards, and a bucket its parts, one after another, so memory is
bounded by one of them, and the number of splitters by a constant, however large the table is.

Equal runs are taken as equal by 48 bits of the token's hash and 48 of the bytes': among M different runs some two are
mistaken for one another with a probability of M**2 / 2**97, 3 in 10**11 for 30 GB of texts and 3 in 10,000 for 100 TB.

Null texts are empty, texts under LENGTH bytes keep all. Null ids count as larger than all others. Rows of equal ids are no
sources for one another. Empty tables give no rows. Other columns stay; result columns replace columns of the same names.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import _powers, claim, mix, partitions, ready, staged, steps, trim, utf8

LENGTH, GRAM = 50, 20
#: Bytes of text of a shard.
SHARD_BYTES = 4 << 20
#: Bytes of text whose runs make a bucket or, beyond BUCKETS of these, one of its parts.
BUCKET_BYTES = 32 << 20
#: Bytes of text whose shards follow one another in a task, and buckets at most.
TASK_BYTES, BUCKETS = 32 << 20, 4096
#: Undecided runs of a token beyond which its suffixes are dealt out one by one.
HOT = 4096
#: One text in so many gives leading tokens for the splitters.
SAMPLE = 64
_LAST = (1 << 63) - 1


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of strings with one leading token: row, first byte in data, strings, token, hash of the bytes."""
    n = len(data)
    none = np.zeros(0, "int64")
    if n < length:
        return none, none, none, none.view("uint64"), none.view("uint64")
    b = data.astype("uint64")
    x2 = b[:-1] | b[1:] << np.uint64(8)
    x4 = x2[:-2] | x2[2:] << np.uint64(16)
    x8 = x4[:-4] | x4[4:] << np.uint64(32)
    m = n - GRAM + 1
    h = x8[:m] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += x8[8 : 8 + m] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h += x4[16 : 16 + m] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    width = length - GRAM + 1
    low, have = h, 1
    while 2 * have <= width:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    # strings that lie in one row
    inside = np.zeros(len(low) + 1, "int32")
    first, stop = ends[:-1], ends[1:] - length + 1
    ok = stop > first
    np.add.at(inside, first[ok], 1)
    np.add.at(inside, stop[ok], -1)
    inside = np.cumsum(inside)[:-1] > 0
    # rows that touch stay apart
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    new[first[ok]] = True
    head = inside & (new | np.r_[True, ~inside[:-1]])
    tail = inside & np.r_[new[1:] | ~inside[1:], True]
    begin, last = np.flatnonzero(head), np.flatnonzero(tail)
    powers, inverse = _powers(n)
    total = np.cumsum((b + np.uint64(1)) * powers, dtype="uint64")
    c = total[last + length - 1]
    c[begin > 0] -= total[begin[begin > 0] - 1]
    c = mix(c * inverse[begin] + (last - begin).astype("uint64"))
    return np.searchsorted(ends, begin, side="right") - 1, begin, last - begin + 1, low[begin], c


def multikey_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes and the class of each place in it (equal rows share a class).

    Rows are compared eight bytes at a time; only rows that are equal so far are compared further.
    """
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), "uint8")
    padded[:, :width] = rows
    words = padded.view(">u8").astype("uint64")
    order = np.argsort(words[:, 0], kind="stable")
    key = words[order, 0]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    for k in range(1, words.shape[1]):
        tied = ~new | np.r_[~new[1:], False]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(new)[at]
        key = words[order[at], k]
        again = np.lexsort((key, group))
        order[at] = order[at][again]
        key = key[again]
        cut = np.ones(len(at), bool)
        cut[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        new[at] |= cut
    return order, np.cumsum(new) - 1


def suffixes(blob: np.ndarray, begin: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of runs in blob: their bytes, the run of each and its place in the run."""
    of = np.repeat(np.arange(len(begin)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return blob[(begin[of] + at)[:, None] + np.arange(length)], of, at


def covered_suffixes(blob: np.ndarray, begin: np.ndarray, count: np.ndarray, rank: np.ndarray, token: np.ndarray, length: int) -> np.ndarray:
    """For all strings of runs, in order, whether a run of the same token and a smaller rank holds an equal one."""
    out = np.zeros(int(count.sum()), bool)
    order = np.argsort(token, kind="stable")
    sizes = count[order]
    place = np.concatenate([[0], np.cumsum(count)])
    # whole tokens at a time, some hundred thousand strings each
    ends = np.cumsum(sizes)
    last_of_token = np.flatnonzero(np.r_[token[order][1:] != token[order][:-1], True]) if len(order) else order
    first = 0
    while first < len(order):
        done = ends[first - 1] if first else 0
        k = last_of_token[np.searchsorted(last_of_token, min(np.searchsorted(ends, done + 200_000), len(order) - 1))] + 1
        mine = order[first:k]
        rows, of, at = suffixes(blob, begin[mine], count[mine], length)
        by, group = multikey_order(rows)
        least = np.full(int(group[-1]) + 1, np.iinfo("int64").max)
        np.minimum.at(least, group, rank[mine][of[by]])
        hit = rank[mine][of[by]] > least[group]
        out[(place[mine][of] + at)[by]] = hit
        first = k
    return out


# ---------------------------------------------------------------- packed rows


def _six(x: np.ndarray) -> bytes:
    """The low 48 bits of each number."""
    return np.ascontiguousarray(x.astype("<u8").view("uint8").reshape(-1, 8)[:, :6]).tobytes()


def _unsix(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), "uint8")
    out[:, :6] = np.frombuffer(data, "uint8").reshape(-1, 6)
    return out.view("<u8").ravel()


_PAIR = np.dtype([("t", "<u8"), ("c", "<u8")])
_MASK = np.uint64((1 << 48) - 1)


def _pairs(token: np.ndarray, content: np.ndarray) -> np.ndarray:
    out = np.empty(len(token), _PAIR)
    out["t"], out["c"] = token, content
    return out


class _Shard:
    """The texts of one shard and their runs."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.batches: list[pa.RecordBatch] = []
        self.blobs: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.notes: list[dict] = []
        self.rank = -1
        self.ids: list[int] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch, key: int, text: int) -> None:
        data, ends = utf8(batch.column(text))
        ranks = np.empty(batch.num_rows, "int64")
        for i, k in enumerate(batch.column(key).to_pylist()):
            if self.rank < 0 or k != self.ids[-1]:
                self.rank += 1
                self.ids.append(k)
            ranks[i] = self.rank
        for a, b in steps(ends):
            row, begin, count, token, content = runs(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], self.length)
            self.parts.append((ranks[a + row], begin + ends[a] - ends[0] + self.size, count, token & _MASK, content & _MASK))
        self.blobs.append(data[ends[0] : ends[-1]])
        self.size += int(ends[-1] - ends[0])
        self.batches.append(batch)

    def settle(self) -> None:
        none = [np.zeros(0, d) for d in ("int64", "int64", "int64", "uint64", "uint64")]
        self.rank_of, self.begin, self.count, self.token, self.content = (np.concatenate(x) for x in zip(none, *self.parts))
        self.parts.clear()
        self.blob = np.concatenate(self.blobs) if self.blobs else np.zeros(0, "uint8")
        self.blobs.clear()
        # distinct runs, each at its first document
        order = np.lexsort((self.begin, self.rank_of, self.content, self.token))
        same = np.zeros(len(order), bool)
        same[1:] = (self.token[order][1:] == self.token[order][:-1]) & (self.content[order][1:] == self.content[order][:-1])
        self.first = order[~same]
        self.kind = np.empty(len(order), "int64")
        self.kind[order] = np.cumsum(~same) - 1
        self.keys = _pairs(self.token[self.first], self.content[self.first])
        #: The smallest id that has each distinct run.
        self.least = np.array(self.ids, "int64")[self.rank_of[self.first]] if len(order) else np.zeros(0, "int64")

    def find(self, token: np.ndarray, content: np.ndarray) -> np.ndarray:
        """Places among the distinct runs."""
        return np.searchsorted(self.keys, _pairs(token, content))


def _numbers(notes: list[dict], field: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, "uint64"), *(_unsix(x[field]) for x in notes if x[field])])


def _planes(x: np.ndarray) -> bytes:
    """Numbers as byte planes, most of which are zero and take no space when compressed."""
    return np.ascontiguousarray(x.astype("<i8").view("uint8").reshape(-1, 8).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, "uint8").reshape(8, -1).T).view("<i8").ravel()


def _bucketed(token: np.ndarray, splitters: np.ndarray, parts: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Places of tokens by bucket and part of it."""
    where = np.searchsorted(splitters, token, side="right") * parts + (mix(token) % np.uint64(parts)).astype("int64")
    yield from ((k // parts, k % parts, rows) for k, rows in _grouped(where))


def _grouped(where: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(where, kind="stable")
    cuts = np.flatnonzero(np.diff(where[order])) + 1
    for rows in np.split(order, cuts) if len(order) else ():
        yield int(where[rows[0]]), rows


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one part of a bucket at a time; they come sorted by bucket and part."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if now != (row["bucket"], row["part"]):
                if rows:
                    yield rows
                now, rows = (row["bucket"], row["part"]), []
            rows.append(row)
    if rows:
        yield rows


def _splitters(given: DataFrame, n: int, length: int) -> np.ndarray:
    """n - 1 splitters of the leading tokens, from every SAMPLE-th text by hash: at most 1000 a task, 100 n in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(0, "uint64")]
        for batch in batches:
            data, ends = utf8(batch.column(0))
            for a, b in steps(ends):
                found.append(runs(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], length)[3] & _MASK)
        all_ = np.concatenate(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(all_[:: max(1, len(all_) // 1000)]).astype("int64"))], names=["v"])

    rows = given.where(F.pmod(F.xxhash64("k"), F.lit(SAMPLE)) == 0).select("t").mapInArrow(run, "v long").orderBy(F.xxhash64("v")).limit(100 * n).collect()
    values = np.sort(np.array([r["v"] for r in rows], "int64")).astype("uint64")
    return np.unique(values[np.linspace(0, len(values) - 1, n + 1).astype(int)[1:-1]]) if len(values) > n else values


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, in_place: bool = False) -> DataFrame:
    """Add n_bytes, spans (removed bytes, begin and end) and kept (the other bytes) to every document.

    With in_place the text column itself is replaced by what is left (a character that a cut goes through goes) instead
    of kept; null texts stay null.
    """
    if length < GRAM:
        raise ValueError(f"strings have {GRAM} bytes at least")
    spark = docs.sparkSession
    ready(spark)
    # a shard's texts and runs are held in memory, some thirty bytes for one of text
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string"))).alias("n")).first()["n"] or 0
    n = max(partitions(spark), -(-size // SHARD_BYTES))
    tasks = max(partitions(spark), -(-size // TASK_BYTES))
    wanted = max(partitions(spark), -(-size // BUCKET_BYTES))
    made = ["n_bytes", "spans"] + ["kept"] * (not in_place)
    kept_columns = [c for c in docs.columns if c not in made]
    rest = [c for c in kept_columns if c != text]
    ident = F.coalesce(F.col(key).cast("long"), F.lit(_LAST))
    given = docs.select(ident.alias("k"), F.col(text).cast("string").alias("t"), F.struct(*rest, F.lit(None).cast("boolean").alias("_")).alias("r")).withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(n)).cast("int"))
    splitters = _splitters(given, min(wanted, max(BUCKETS, partitions(spark))), length)
    buckets = len(splitters) + 1
    parts_of = -(-wanted // max(BUCKETS, buckets))

    def shards(notes: DataFrame | None, columns: list[str]) -> DataFrame:
        """Rows of a shard follow one another in one partition: first what buckets say, then texts by id."""
        rows = given.select("shard", F.lit(1).alias("kind"), "k", *columns)
        if notes is not None:
            rows = rows.unionByName(notes.withColumn("kind", F.lit(0)), allowMissingColumns=True)
        return rows.repartitionById(tasks, F.pmod("shard", F.lit(tasks))).sortWithinPartitions("shard", "kind", "k", "t")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Shard, int]]:
        """A task's shards, one after another."""
        claim("suffix_dedup")
        shard, now = _Shard(length), -1
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for first, last in itertools.pairwise([0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)] if len(numbers) else []):
                if now != numbers[first]:
                    if now >= 0:
                        shard.settle()
                        yield shard, now
                        shard = _Shard(length)
                        trim()
                    now = int(numbers[first])
                split = first + int((batch.column(1).to_numpy()[first:last] == 0).sum())
                if first < split:
                    shard.notes += batch.slice(first, split - first).to_pylist()
                if split < last:
                    shard.add(batch.slice(split, last - split), 2, 3)
        if now >= 0:
            shard.settle()
            yield shard, now
        del shard
        trim()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, number in load(batches):
            for b, p, rows in _bucketed(shard.keys["t"], splitters, parts_of):
                yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (b, p, number)), *(pa.array([v], pa.binary()) for v in (_six(shard.keys["t"][rows]), _six(shard.keys["c"][rows]), _planes(shard.least[rows])))], names=["bucket", "part", "shard", "tokens", "contents", "least"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _parts(batches):
            t = np.concatenate([_unsix(r["tokens"]) for r in got])
            c = np.concatenate([_unsix(r["contents"]) for r in got])
            k = np.concatenate([_unplanes(r["least"]) for r in got])
            s = np.repeat(np.array([r["shard"] for r in got]), [len(r["tokens"]) // 6 for r in got])
            order = np.lexsort((k, c, t))
            t, c, s = t[order], c[order], s[order]
            new_t = np.r_[True, t[1:] != t[:-1]]
            new_c = new_t | np.r_[True, c[1:] != c[:-1]]
            group = np.cumsum(new_t) - 1
            different = np.bincount(group, new_c)
            apart = np.minimum.reduceat(s, np.flatnonzero(new_t)) != np.maximum.reduceat(s, np.flatnonzero(new_t))
            undecided = new_c & ((different > 1) & apart)[group]
            hot = (different > HOT)[group]
            for number, mine in _grouped(s):
                yield _note(number, t[mine], c[mine], ~new_c[mine], undecided[mine] & ~hot[mine], undecided[mine] & hot[mine])

    told = ("covered", "ask", "hot")

    def _note(number: int, t: np.ndarray, c: np.ndarray, *which: np.ndarray) -> pa.RecordBatch:
        row = [_six(x[w]) for w in which for x in (t, c)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([v], pa.binary()) for v in row)], names=["shard", *(f"{n}_{x}" for n in told for x in "tc")])

    def to_buckets(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "part")

    sent = shards(None, ["t"]).mapInArrow(send, "bucket int, part int, shard int, tokens binary, contents binary, least binary")
    notes, _ = staged(to_buckets(sent).mapInArrow(compare, "shard int, " + ", ".join(f"{n}_{x} binary" for n in told for x in "tc")), "covered")

    def send_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, number in load(batches):
            asked = shard.find(_numbers(shard.notes, "ask_t"), _numbers(shard.notes, "ask_c"))
            for b, p, rows in _bucketed(shard.keys["t"][asked], splitters, parts_of):
                one = shard.first[asked[rows]]
                blob = b"".join(shard.blob[x : x + m + length - 1].tobytes() for x, m in zip(shard.begin[one].tolist(), shard.count[one].tolist()))
                yield _bytes(b, p, number, shard, asked[rows], shard.count[one], np.zeros(len(one)), blob)
            hot = shard.find(_numbers(shard.notes, "hot_t"), _numbers(shard.notes, "hot_c"))
            if len(hot):
                one = shard.first[hot]
                strings, of, at = suffixes(shard.blob, shard.begin[one], shard.count[one], length)
                own = np.array([zlib.crc32(x.tobytes()) for x in strings], "int64") % (buckets * parts_of)
                for k, rows in _grouped(own):
                    yield _bytes(k // parts_of, k % parts_of, number, shard, hot[of[rows]], np.ones(len(rows)), at[rows], strings[rows].tobytes())

    def _bytes(b: int, p: int, number: int, shard: _Shard, kinds: np.ndarray, count: np.ndarray, at: np.ndarray, blob: bytes) -> pa.RecordBatch:
        row = [_six(shard.keys["t"][kinds]), _six(shard.keys["c"][kinds]), _planes(shard.least[kinds]), count.astype("<u4").tobytes(), at.astype("<u4").tobytes(), blob]
        return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (b, p, number)), *(pa.array([v], pa.binary()) for v in row)], names=["bucket", "part", "shard", "tokens", "contents", "least", "counts", "at", "blob"])

    def compare_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _parts(batches):
            t = np.concatenate([_unsix(r["tokens"]) for r in got])
            c = np.concatenate([_unsix(r["contents"]) for r in got])
            k = np.concatenate([_unplanes(r["least"]) for r in got])
            count = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in got]).astype("int64")
            at = np.concatenate([np.frombuffer(r["at"], "<u4") for r in got])
            blob = np.frombuffer(b"".join(r["blob"] for r in got), "uint8")
            s = np.repeat(np.array([r["shard"] for r in got]), [len(r["tokens"]) // 6 for r in got])
            size = count + length - 1
            hit = covered_suffixes(blob, np.cumsum(size) - size, count, k, t, length)
            # the strings that are covered: their run, place in it, and shard
            run = np.repeat(np.arange(len(count)), count)[hit]
            place = (np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count))[hit] + at[run]
            for number, mine in _grouped(s[run]):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([v], pa.binary()) for v in (_six(t[run[mine]]), _six(c[run[mine]]), place[mine].astype("<u4").tobytes()))], names=["shard", "part_t", "part_c", "part_at"])

    asking = shards(notes.select("shard", "ask_t", "ask_c", "hot_t", "hot_c"), ["t"]).select("shard", "kind", "k", "t", "ask_t", "ask_c", "hot_t", "hot_c")
    sent = asking.mapInArrow(send_bytes, "bucket int, part int, shard int, tokens binary, contents binary, least binary, counts binary, at binary, blob binary")
    parts, _ = staged(to_buckets(sent).mapInArrow(compare_bytes, "shard int, part_t binary, part_c binary, part_at binary"), "parts")
    schema = StructType([*docs.select(*kept_columns).withColumn(text, F.col(text).cast("string")).schema.fields, StructField("n_bytes", LongType()), StructField("spans", ArrayType(StructType([StructField("begin", LongType()), StructField("end", LongType())])))] + [StructField("kept", BinaryType())] * (not in_place))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, _ in load(batches):
            yield from cut_shard(shard)

    def cut_shard(shard: _Shard) -> Iterator[pa.RecordBatch]:
        strings = np.zeros(shard.size + 1, "int32")  # changes of the number of covered strings that start so far
        first_rank = shard.rank_of[shard.first]
        known = np.zeros(len(shard.first), bool)
        known[shard.find(_numbers(shard.notes, "covered_t"), _numbers(shard.notes, "covered_c"))] = True
        whole = known[shard.kind] | (shard.rank_of > first_rank[shard.kind])
        np.add.at(strings, shard.begin[whole], 1)
        np.add.at(strings, shard.begin[whole] + shard.count[whole], -1)
        # runs decided string by string, in every document that has them: here, where a token has several runs ...
        token = shard.keys["t"]
        same = token[1:] == token[:-1]
        several = np.flatnonzero(np.r_[False, same] | np.r_[same, False]) if len(token) else np.zeros(0, "int64")
        one = shard.first[several]
        hit = covered_suffixes(shard.blob, shard.begin[one], shard.count[one], first_rank[several], token[several], length)
        run = np.repeat(several, shard.count[one])
        at = np.arange(len(run)) - np.repeat(np.cumsum(shard.count[one]) - shard.count[one], shard.count[one])
        # ... and by other shards
        told_at = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(x["part_at"], "<u4") for x in shard.notes if x["part_at"])])
        run = np.concatenate([run[hit], shard.find(_numbers(shard.notes, "part_t"), _numbers(shard.notes, "part_c"))])
        at = np.concatenate([at[hit], told_at.astype("int64")])
        by_kind = np.argsort(shard.kind, kind="stable")
        starts = np.searchsorted(shard.kind[by_kind], np.arange(len(shard.first) + 1))
        many = starts[run + 1] - starts[run]
        place = np.repeat(starts[run] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        single = np.zeros(shard.size, bool)
        single[shard.begin[by_kind[place]] + np.repeat(at, many)] = True
        single |= np.cumsum(strings, dtype="int32")[:-1] > 0
        del strings
        before = np.zeros(length + len(single), "int32")
        np.cumsum(single, out=before[length:])
        gone = before[length:] > before[:-length]
        base = 0
        for batch in shard.batches:
            _, ends = utf8(batch.column(3))
            ends = (ends - ends[0] + base).tolist()
            base = ends[-1]
            spans, kept = [], []
            for a, b in zip(ends, ends[1:]):
                g = gone[a:b]
                edge = np.flatnonzero(np.diff(np.r_[False, g, False])).reshape(-1, 2)
                spans.append([{"begin": x, "end": y} for x, y in edge.tolist()])
                kept.append(shard.blob[a:b][~g].tobytes() if len(edge) else shard.blob[a:b].tobytes())
            own = batch.column(4)
            texts = batch.column(3)
            if in_place and any(spans):
                texts = pa.array([b.decode("utf-8", "ignore") if s else t for b, s, t in zip(kept, spans, texts.to_pylist())], pa.string())
            columns = [texts if c == text else own.field(rest.index(c)) for c in kept_columns]
            made_ = [pa.array(np.diff(np.array(ends))), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())][: len(made)]
            yield pa.RecordBatch.from_arrays([*columns, *made_], names=schema.names)

    told_all = notes.select("shard", "covered_t", "covered_c").unionByName(parts, allowMissingColumns=True)
    rows = shards(told_all, ["t", "r"]).select("shard", "kind", "k", "t", "r", "covered_t", "covered_c", "part_t", "part_c", "part_at")
    return rows.mapInArrow(cut, schema)


def removed(spans: Column) -> Column:
    """The number of bytes in spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
