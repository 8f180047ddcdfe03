"""Benchmark items in documents: SimHash of item-sized windows, multi-index Hamming search, exact confirmation.

An item of n words is looked for in all windows of n words of every text (a text of fewer words is one window). Windows
and items are bags of k-word shingles (items of fewer words: of all their words). A window with less than the wanted
share of an item's shingles among those of any item cannot match and gets no fingerprint. The others' 64-bit SimHash is
cut into BLOCKS blocks; fingerprints within RADIUS = 2 * BLOCKS - 1 bits have a block within one bit, so a table of the
items by block value, one-bit neighbours included, yields all items within the radius. What it yields is confirmed by
the exact similarity of the two bags, each shingle weighted by how often it stands there: sum of the smaller counts
by sum of the larger ones.

The items are read in parts of at most PART_BYTES of text, each of which goes to all workers, which index it once; the
driver holds the text of one part. A larger benchmark takes a pass for each part, whose findings are written before the
next part is read. Null or wordless items and texts match nothing; repeated rows are matched each; equal items are all
reported. An empty benchmark or table gives no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import claim, ready, shingles, staged, steps, trim, utf8, word_hashes

WORDS, SIMILARITY = 5, 0.8
BLOCKS = 10
RADIUS = 2 * BLOCKS - 1
PART_BYTES = 8 << 20
#: Windows fingerprinted at a time.
STEP = 4096
_BIT = np.arange(64, dtype="uint64")
_CUTS = [(64 * j // BLOCKS, 64 * (j + 1) // BLOCKS) for j in range(BLOCKS)]


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 64 bits of each hash."""
    return ((hashes[:, None] >> _BIT) & np.uint64(1)).astype("int32") * 2 - 1


def simhashes(hashes: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """Fingerprints of the windows of size hashes at starts (ascending)."""
    out = np.empty(len(starts), "uint64")
    for a in range(0, len(starts), STEP):
        part = starts[a : a + STEP]
        # starts far apart are summed apart
        for run in np.split(part, np.flatnonzero(np.diff(part) > 4 * size) + 1):
            low, high = int(run[0]), int(run[-1]) + size
            total = np.zeros((high - low + 1, 64), "int32")
            np.cumsum(signs(hashes[low:high]), axis=0, out=total[1:])
            over = total[run - low + size] > total[run - low]
            at = a + np.searchsorted(part, run[0])
            out[at : at + len(run)] = (over.astype("uint64") << _BIT).sum(axis=1, dtype="uint64")
    return out


class Items:
    """Items of one length: their fingerprints, the table of block values, and their bags."""

    def __init__(self, k: int, size: int) -> None:
        self.k, self.size = k, size
        self.ids: list[int | None] = []
        self.bags: list[Counter[int]] = []
        self.prints: list[int] = []

    def add(self, item: int | None, hashes: np.ndarray) -> None:
        self.ids.append(item)
        self.bags.append(Counter(hashes.tolist()))
        self.prints.append(int(simhashes(hashes, len(hashes), np.zeros(1, "int64"))[0]))

    def settle(self) -> None:
        self.print = np.array(self.prints, "uint64")
        self.least = min(sum(b.values()) for b in self.bags)
        self.near = []
        for low, high in _CUTS:
            own = self.block(self.print, low, high)
            table = np.zeros((1 << (high - low), len(own)), bool)
            for value in (own, *(own ^ (1 << b) for b in range(high - low))):
                table[value, np.arange(len(own))] = True
            self.near.append(table)

    @staticmethod
    def block(prints: np.ndarray, low: int, high: int) -> np.ndarray:
        return ((prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype("int64")

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (fingerprint, item) within the radius."""
        found = np.zeros((len(prints), len(self.ids)), bool)
        for (low, high), table in zip(_CUTS, self.near):
            found |= table[self.block(prints, low, high)]
        w, i = np.nonzero(found)
        close = np.bitwise_count(prints[w] ^ self.print[i]) <= RADIUS
        return w[close], i[close]


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


class Index:
    """All items of a part of the benchmark."""

    def __init__(self, rows: list[tuple[int | None, str | None]], k: int = WORDS, least: float = SIMILARITY) -> None:
        self.least = least
        by: dict[tuple[int, int], Items] = {}
        words: dict[int, set[int]] = defaultdict(set)
        for item, text in rows:
            data = (text or "").encode()
            found, at = word_hashes(np.frombuffer(data, "uint8"), np.array([0, len(data)]))
            n = len(found)
            if not n:
                continue
            own = min(k, n)
            hashes = shingles(found, at, own)[0]
            by.setdefault((own, n), Items(own, n)).add(item, hashes)
            words[own].update(hashes.tolist())
        self.items: dict[int, list[Items]] = defaultdict(list)
        for group in by.values():
            group.settle()
            self.items[group.k].append(group)
        self.known = {j: np.sort(np.array(list(x), "uint64")) for j, x in words.items()}
        self.maybe = {}
        for j, x in self.known.items():
            self.maybe[j] = np.zeros(1 << 20, bool)
            self.maybe[j][(x >> np.uint64(44)).astype("int64")] = True

    def hits(self, k: int, hashes: np.ndarray) -> np.ndarray:
        out = self.maybe[k][(hashes >> np.uint64(44)).astype("int64")]
        at = np.flatnonzero(out)
        known = self.known[k]
        out[at] = known[np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)] == hashes[at]
        return out

    def matches(self, k: int, n_words: int, hashes: np.ndarray, hit: np.ndarray) -> dict[int | None, tuple[float, int, int]]:
        """By item: the best window's similarity, first word and end."""
        best: dict[int | None, tuple[float, int, int]] = {}
        counts = np.concatenate([[0], np.cumsum(hit)])
        for group in self.items[k]:
            size = min(group.size - k + 1, len(hashes))
            if size < 1:
                continue
            inside = counts[size:] - counts[:-size]
            starts = np.flatnonzero(inside >= self.least * group.least)
            if not len(starts):
                continue
            prints = simhashes(hashes, size, starts)
            bag: tuple[int, Counter] = (-1, Counter())
            for w, i in zip(*group.candidates(prints)):
                begin = int(starts[w])
                if bag[0] != begin:
                    bag = (begin, Counter(hashes[begin : begin + size].tolist()))
                s = similarity(bag[1], group.bags[i])
                if s >= self.least and s > best.get(group.ids[i], (0.0, 0, 0))[0]:
                    best[group.ids[i]] = (s, begin, min(begin + group.size, n_words))
        return best


def _parts(benchmark: DataFrame, item: str, text: str) -> Iterator[list[Row]]:
    """The benchmark in parts of at most about PART_BYTES of text."""
    given = benchmark.select(F.col(item).cast("long").alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    size = given.agg(F.sum(F.octet_length("t") + 16).alias("n")).first()["n"] or 0
    parts = -(-size // PART_BYTES)
    for p in range(parts):
        yield given.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p).collect()


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """One row for each text and item in it: doc_id, item_id, similarity, begin_word and end_word of the best window."""
    ready(docs.sparkSession)
    given = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    schema = "doc_id long, item_id long, similarity double, begin_word long, end_word long"
    found = None
    for number, rows in enumerate(_parts(benchmark, item, item_text)):
        if found is not None and number == 1:
            found = staged(found, "contamination")[0]
        part = _search(given, [(r["i"], r["t"]) for r in rows], k, least, schema)
        found = part if found is None else found.union(staged(part, "contamination")[0])
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


_INDEX: dict[str, Index] = {}


def _index(name: str, rows: list[tuple[int | None, str | None]], k: int, least: float) -> Index:
    """This worker's index of a part of the benchmark."""
    claim("decontamination", _INDEX.clear)
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = Index(rows, k, least)
    return _INDEX[name]


def _search(given: DataFrame, rows: list[tuple[int | None, str | None]], k: int, least: float, schema: str) -> DataFrame:
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, rows, k, least)
        for batch in batches:
            data, ends = utf8(batch.column(1))
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for a, b in steps(ends):
                words, at = word_hashes(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                for j in index.known:
                    hashes, of = shingles(words, at, j)
                    hit = index.hits(j, hashes)
                    total = np.concatenate([[0], np.cumsum(hit)])
                    for row in np.flatnonzero(total[of[1:]] > total[of[:-1]]):
                        x, y = of[row], of[row + 1]
                        best = index.matches(j, int(at[row + 1] - at[row]), hashes[x:y], hit[x:y])
                        out += [(ids[a + row], i, *v) for i, v in best.items()]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["doc_id", "item_id", "similarity", "begin_word", "end_word"])
        trim()

    return given.mapInArrow(run, schema)
