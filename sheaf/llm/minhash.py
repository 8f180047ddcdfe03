"""Near-duplicate documents: b-bit MinHash candidates, confirmed on full shingle sets.

1. One pass over the texts gives each document's set of word shingles (as hashes), its size, a hash of the whole set,
   BANDS band keys of ROWS minima each, and the two low bits of every minimum, packed in five integers.
2. Documents of equal sets are one class, represented by the smallest id; only representatives go on.
3. Two members of a band bucket are candidates if no more of their bit pairs differ than those of two documents at the
   threshold may: the expected number, collisions by chance included, and SIGMAS standard deviations. Boilerplate that
   fills a bucket with texts that are otherwise unlike makes no candidates.
   Each member is tried with the bucket's smallest one first; components of these ties are groups. What else could tie
   two groups stands in buckets of several groups: there the members outside the bucket's largest group are tried with
   all others, block by block of at most 2 * PART members, by bit counts alone.
4. Components of all candidates are compared on full sets, block by block of at most 2 * CHUNK members: intersections
   by a matrix product over the shingles that at least two members have. A block returns a forest of its links, not the
   links, so rows do not grow with the square of a group. Larger components, which only families of hundreds of texts
   that are all like one another make, are dealt to all pairs of chunks, so every two members meet in a block.
5. Components of the forests give the classes.

Two documents at the threshold share no band once in some ten million, and differ in more bit pairs than allowed once
in a billion. Null texts and texts without words have empty sets and are linked with nothing. Rows without an id are
returned, linked with nothing, with a null component. Repeated rows are equal sets. Other columns are not kept by
``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, mix, partitions, ready, release, shingles, staged, steps, trim, utf8, word_hashes
from .graph import components

BANDS, ROWS = 32, 5
#: Standard deviations by which candidates may differ in more bit pairs than expected at the threshold.
SIGMAS = 6
#: Members of a bucket's part in a block of bit counts.
PART = 2048
#: Members of a part of a large component.
CHUNK = 384
_LOW = 0x5555555555555555
_A = mix(np.arange(1, BANDS * ROWS + 1, dtype="uint64")).astype("uint32") | np.uint32(1)
_B = mix(np.arange(1001, 1001 + BANDS * ROWS, dtype="uint64")).astype("uint32")


def signatures(data: np.ndarray, ends: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The rows' sorted sets of shingle hashes and the minima (rows with shingles x BANDS * ROWS)."""
    words, at = word_hashes(data, ends)
    found, of = shingles(words, at, k)
    sets = [np.unique(found[a:b]) for a, b in zip(of.tolist(), of[1:].tolist())]
    full = np.flatnonzero(np.diff(of))
    minima = np.empty((len(full), BANDS * ROWS), "uint32")
    if len(full):
        short = (found >> np.uint64(32)).astype("uint32")
        for j in range(BANDS * ROWS):
            minima[:, j] = np.minimum.reduceat(short * _A[j] + _B[j], of[:-1][full])
    return sets, minima


def profiles(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """(id, n, whole, bands, bits) of every document; whole is null for an empty set."""
    import xxhash

    ready(docs.sparkSession)
    given = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        for batch in batches:
            data, ends = utf8(batch.column(1))
            sizes, whole, bands, bits = [], [], [], []
            for a, b in steps(ends):
                sets, minima = signatures(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], k)
                wide = minima.astype("uint64").reshape(len(minima), BANDS, ROWS)
                keys = np.zeros((len(minima), BANDS), "uint64") + np.arange(BANDS, dtype="uint64")
                for r in range(ROWS):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, r])
                packed = np.zeros((len(minima), 5), "uint64")
                for j in range(BANDS * ROWS):
                    packed[:, j // 32] |= (minima[:, j].astype("uint64") & np.uint64(3)) << np.uint64(2 * (j % 32))
                row = 0
                for s in sets:
                    sizes.append(len(s))
                    whole.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    bands.append(keys[row].view("int64") if len(s) else None)
                    bits.append(packed[row].view("int64") if len(s) else None)
                    row += bool(len(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(whole, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["id", "n", "whole", "bands", "bits"])
        trim()

    return given.mapInArrow(run, "id long, n long, whole binary, bands array<long>, bits array<long>")


def allowed(percent: int) -> int:
    """Bit pairs of BANDS * ROWS that may differ between candidates: two bits are equal by chance once in four times."""
    differ = 0.75 * (1 - percent / 100)
    n = BANDS * ROWS
    return int(n * differ + SIGMAS * (n * differ * (1 - differ)) ** 0.5)


def unequal(a: Column, b: Column) -> Column:
    """How many bit pairs of two packed signatures differ."""
    found = F.lit(0)
    for j in range(5):
        x = a[j].bitwiseXOR(b[j])
        found = found + F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(_LOW)))
    return found


def _unequal(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    x = others ^ one
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(_LOW)).sum(axis=1, dtype="int64")


def ties_of(ids: np.ndarray, bits: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ties that connect all members with at most so many unequal bit pairs: each is met once, from where it is reached."""
    out: list[tuple[int, int]] = []
    left = np.arange(len(ids))
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            i = reached.pop()
            near = _unequal(bits[i], bits[left]) <= most
            out += [(int(ids[i]), j) for j in ids[left[near]].tolist()]
            reached += left[near].tolist()
            left = left[~near]
    return out


def _later_ties(met: DataFrame, groups: DataFrame, bits: DataFrame, most: int) -> DataFrame:
    """Ties (a, b) between groups (node, label), beside those with the smallest member, from buckets of several groups.

    met (id, band) are the members besides the smallest. A bucket's largest group needs no tie
    within: its members go to one block each, the others to a block with each part of it and of one another.
    """
    n = partitions(bits.sparkSession)
    named = met.join(groups.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("label", "id").alias("label"))
    sizes = named.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("m")).where("m > n_main")
    part = lambda size: F.ceil(size / PART).cast("int")
    dealt = named.join(mixed.select("band", "main", part(F.col("n_main")).alias("mains"), part(F.col("m") - F.col("n_main")).alias("others")), "band")
    dealt = dealt.withColumn("large", F.col("label") == F.col("main")).withColumn("p", F.pmod(F.xxhash64("id"), F.when(F.col("large"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    # block (i, j): part i of the others with their part j >= i, or with part -1 - j of the main group
    i, j = F.col("p"), F.lit(-1) - F.col("p")
    with_main = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda x: F.struct(x.alias("i"), j.alias("j")))
    with_others = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda x: F.struct(F.least(i, x).alias("i"), F.greatest(i, x).alias("j")))
    against_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda x: F.struct(i.alias("i"), (F.lit(-1) - x).alias("j")))
    blocks = dealt.select("band", "id", "large", F.explode(F.when(F.col("large"), with_main).otherwise(F.concat(with_others, against_main))).alias("b")).select("band", "id", "large", "b.i", "b.j")
    given = blocks.join(bits, "id").select("band", "i", "j", "large", "id", "bits").repartition(n, "band", "i", "j").sortWithinPartitions("band", "i", "j", "large", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        now, large, ids, own = None, [], [], []

        def ties() -> pa.RecordBatch:
            every, print_ = np.array(ids, "int64"), np.array(own, "int64").view("uint64")
            small = len(large) - sum(large)
            if small < len(large):  # one tie to the main group is enough
                found = []
                for k in range(small):
                    near = np.flatnonzero(_unequal(print_[k], print_[small:]) <= most)[:1]
                    found += [(int(every[k]), int(every[small + x])) for x in near]
            else:
                found = ties_of(every, print_, most)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for *block, is_large, id_, b in zip(*(c.to_pylist() for c in batch.columns)):
                if now != block:
                    if len(ids) > 1:
                        yield ties()
                    now, large, ids, own = block, [], [], []
                large.append(is_large)
                ids.append(id_)
                own.append(b)
        if len(ids) > 1:
            yield ties()
        trim()

    return given.mapInArrow(run, "a long, b long")


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all sets with 100 * intersection >= percent * union, as pairs of positions."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    top = list(range(m))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    out: list[tuple[int, int]] = []
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (sizes.sum() - both) else []
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(m), sizes)
    shared = count[place] > 1
    column = (np.cumsum(count > 1) - 1)[place[shared]]
    member, width = member[shared], int((count > 1).sum())
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    both = np.zeros((m, m), "float32")
    for first in range(0, width, 4096):
        a, b = np.searchsorted(column, (first, first + 4096))
        part = np.zeros((m, min(4096, width - first)), "float32")
        part[member[a:b], column[a:b] - first] = 1
        both += part @ part.T
    both = both.astype("int64")
    linked = np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1)
    for i, j in zip(*np.nonzero(linked)):
        a, b = root(int(i)), root(int(j))
        if a != b:
            top[max(a, b)] = min(a, b)
            out.append((int(i), int(j)))
    return out


def _blocks(members: DataFrame, docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """Links (a, b) that connect the classes, from members (id, comp) of candidate components."""
    spark = docs.sparkSession
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("m"))
    parts = F.ceil(F.col("m") / CHUNK)
    # a member of part p goes to the blocks of all pairs that hold p
    dealt = members.join(sizes, "comp").withColumn("p", F.when(F.col("m") <= 2 * CHUNK, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), parts))).withColumn("c", F.when(F.col("m") <= 2 * CHUNK, F.lit(1)).otherwise(parts))
    pairs = dealt.select("id", "comp", "p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c").cast("long") - 1)).alias("q"))
    # two equal parts need no block of their own beside the pairs with others
    pairs = pairs.select("id", "comp", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j")).join(sizes, "comp").where("i <> j or m <= %d" % (2 * CHUNK)).drop("m")
    given = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t")).join(members.select("id"), "id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        for batch in batches:
            data, ends = utf8(batch.column(1))
            sets = []
            for a, b in steps(ends):
                words, at = word_hashes(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                found, of = shingles(words, at, k)
                sets += [np.unique(found[x:y]).tobytes() for x, y in zip(of.tolist(), of[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "s"])
        trim()

    sets = given.mapInArrow(hashed, "id long, s binary")
    n = partitions(spark)
    rows = pairs.join(sets, "id").select("comp", "i", "j", "id", "s").repartition(n, "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        now, ids, own = None, [], []

        def links() -> pa.RecordBatch:
            found = forest(own, percent) if len(own) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for comp, i, j, id_, s in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (comp, i, j):
                    if len(own) > 1:
                        yield links()
                    now, ids, own = (comp, i, j), [], []
                if ids and ids[-1] == id_ and own[-1].tobytes() == s:
                    continue  # a repeated row
                ids.append(id_)
                own.append(np.frombuffer(s, "uint64"))
        if len(own) > 1:
            yield links()
        ids, own = [], []
        trim()

    return rows.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component): each document's set size and the smallest id that links reach."""
    spark = docs.sparkSession
    prof, prof_path = staged(profiles(docs, key, text, k), "profiles")
    known = prof.where("id is not null and whole is not null")
    # narrow tables are kept in few files
    few = max(4, partitions(spark) // 8)
    classes, classes_path = staged(known.groupBy("whole").agg(F.min("id").alias("rep")).coalesce(few), "classes")
    reps = known.join(classes, "whole").where("id = rep").dropDuplicates(["whole"]).select("id", "bands", "bits")
    banded, banded_path = staged(reps.coalesce(few), "representatives")
    most = allowed(percent)
    rows = banded.select("id", F.explode("bands").alias("band"))
    firsts = rows.groupBy("band").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").select("band", "first", "m")
    met, met_path = staged(rows.join(firsts, "band").where("id <> first").coalesce(few), "met")
    bits = banded.select("id", "bits")
    pairs = met.select("id", "first").distinct().join(bits, "id").join(bits.select(F.col("id").alias("first"), F.col("bits").alias("other")), "first")
    near, near_path = staged(pairs.where(unequal(F.col("bits"), F.col("other")) <= most).select(F.col("id").alias("a"), F.col("first").alias("b")).coalesce(few), "near")
    groups = components(near)
    more, more_path = staged(_later_ties(met.where("m > 2").select("band", "id"), groups, bits, most).coalesce(few), "ties")
    candidates = components(groups.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
    for path in (met_path, near_path, more_path):
        release(spark, path)
    members = candidates.select(F.col("node").alias("id"), F.col("label").alias("comp"))
    links, links_path = staged(_blocks(members, docs, key, text, k, percent).coalesce(few), "links")
    labels = components(links)
    release(spark, banded_path)
    release(spark, links_path)
    found = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("whole", F.coalesce("label", "rep").alias("label"))
    return prof.select("id", "n", "whole").join(found, "whole", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("label", "id")).alias("component"))
