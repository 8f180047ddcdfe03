"""Toxic texts by a convolutional classifier over hashed words, trained in numpy.

A word is the sum of the embeddings of its hash and of the hashes of its first bytes, so inflected words share what
their stems say. Filters of one, two and three words slide over the text; each is pooled by maximum over the whole text
and over eighths of it (whose mean tells one chance word from many). A logistic layer gives the score. Embeddings
begin at a cautious log-odds of their bucket between the classes, so a few thousand rows suffice, and are trained
further with the filters.

The classifier is fitted on at most TRAIN_ROWS labelled rows outside the held-out fold, the ones with the smallest hash
of their id, as far as their texts together stay within TRAIN_BYTES; the score uses the text alone. One task of an
executor fits it, so the driver holds the weights alone (8 MB). Thresholds are calibrated for each language on a quarter of these rows,
with the threshold of all languages where a language has few. Scoring is one pass over the texts.

A null or wordless text has the score of no words. Labels that are null are not used; a doc_id labelled twice counts as
toxic if any label says so, and of different texts of one doc_id the smallest is the one to train on. Without labelled rows of both classes all scores are 0 and nothing is rejected. Each of
repeated rows is scored alike. Other columns stay; result columns replace columns of the same names.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import _LOWER, _powers, claim, mix, ready, settle, steps, trim, utf8

#: Labelled rows that the classifier is fitted on, at most.
TRAIN_ROWS = 5000
#: Bytes of text that the classifier is fitted on, at most: a text that would go beyond is left out.
TRAIN_BYTES = 24 << 20
BUCKETS, WIDTH, FILTERS, PARTS = 1 << 18, 8, 4, 8
SPANS = (1, 2, 3)
#: First bytes of a word that are hashed besides the whole word.
STEMS = (3, 4, 5, 6, 8)
EPOCHS, BATCH, RATE = 6, 64, 0.05
#: Rows of a language below which the common threshold holds.
LEAST_ROWS = 60

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word (words x features, letters and digits only) and the rows' n + 1 word offsets."""
    n = len(data)
    if not n:
        return np.zeros((0, 1 + len(STEMS)), "int32"), np.zeros(len(ends), "int64")
    low = _LOWER[data]
    inside = _LETTERS[low]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = ends[(ends > 0) & (ends < n)]
    before[edges] = False
    after[edges - 1] = False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
    powers, inverse = _powers(n)
    total = np.cumsum((low.astype("uint64") + np.uint64(1)) * powers, dtype="uint64")
    base = np.where(first > 0, total[np.maximum(first - 1, 0)], np.uint64(0))
    scale = inverse[first]
    out = np.empty((len(first), 1 + len(STEMS)), "int32")
    for k, size in enumerate((0, *STEMS)):
        h = mix((total[last if not size else np.minimum(first + size - 1, last)] - base) * scale + np.uint64(k))
        out[:, k] = (h >> np.uint64(46)).astype("int64") % BUCKETS
    return out, np.searchsorted(first, ends)


@dataclass
class Net:
    """The classifier's weights."""

    words: np.ndarray  # BUCKETS x WIDTH
    filters: list[np.ndarray]  # by span: span x WIDTH x FILTERS
    bias: np.ndarray
    out: np.ndarray  # pooled channels, twice
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)
    common: float = 0.5
    empty: bool = False

    def activations(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """words x channels, from summed embeddings; words past a row's end count as nothing."""
        n = len(x)
        end = np.repeat(at[1:], np.diff(at))
        columns = []
        for w in self.filters:
            y = x @ w[0]
            for j in range(1, len(w)):
                ok = np.flatnonzero(np.arange(n) + j < end)
                y[ok] += x[ok + j] @ w[j]
            columns.append(y)
        return np.maximum(np.concatenate(columns, axis=1) + self.bias, 0)

    def score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        sizes = np.diff(at)
        pooled = np.zeros((len(sizes), 2 * FILTERS * len(SPANS)), "float32")
        full = np.flatnonzero(sizes)
        if len(full):
            act = self.activations(embedded(self.words, ids), at)
            pooled[full] = pool(act, at)[0]
        return 1 / (1 + np.exp(-(pooled @ self.out + self.offset).astype("float64")))


def embedded(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    x = table[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        x += table[ids[:, k]]
    return x


def pool(act: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows with words: largest activation and mean of the parts' largest; the parts' maxima, first words and rows."""
    sizes = np.diff(at)
    row = np.repeat(np.flatnonzero(sizes), sizes[sizes > 0])
    part = (np.arange(len(act)) - at[row]) * PARTS // sizes[row]
    key = row * PARTS + part
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    most = np.maximum.reduceat(act, heads, axis=0)
    rows = row[heads]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    count = np.diff(np.r_[starts, len(rows)])[:, None]
    return np.concatenate([np.maximum.reduceat(most, starts, axis=0), np.add.reduceat(most, starts, axis=0) / count], axis=1), most, heads, starts


def _log_odds(parts: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Cautious evidence for the toxic class by bucket: the log-odds less its error, 0 at least."""
    seen = np.zeros((2, BUCKETS), "float32")
    for ids, y in zip(parts, toxic):
        seen[int(y), np.unique(ids)] += 1
    n, t = seen
    share = np.log((t + 0.5) / (toxic.sum() + 1)) - np.log((n + 0.5) / ((~toxic).sum() + 1))
    return np.clip(share - 2 / np.sqrt(t + 0.5), 0, 3).astype("float32")


def fit(texts: list[str], toxic: np.ndarray, langs: list[str], check: np.ndarray, seed: int = 7) -> Net:
    """Train on the rows outside check, calibrate thresholds on those in check."""
    return _fit([words_of(t) for t in texts], toxic, langs, check, seed)


def words_of(text: str) -> np.ndarray:
    data = text.encode()
    return features(np.frombuffer(data, "uint8"), np.array([0, len(data)]))[0]


def _fit(parts: list[np.ndarray], toxic: np.ndarray, langs: list[str], check: np.ndarray, seed: int = 7) -> Net:
    """``fit`` on the words of the texts."""
    rng = np.random.default_rng(seed)
    own = np.flatnonzero(~check)
    toxic = toxic.astype(bool)
    if not toxic[own].any() or toxic[own].all():
        return Net(np.zeros((1, WIDTH), "float32"), [], np.zeros(0), np.zeros(0), 0.0, empty=True, common=2.0)
    words = rng.normal(0, 0.01, (BUCKETS, WIDTH)).astype("float32")
    words[:, 0] = _log_odds([parts[i] for i in own], toxic[own])
    filters = [rng.normal(0, 0.05, (s, WIDTH, FILTERS)).astype("float32") for s in SPANS]
    for w in filters:
        w[:, 0, :2] += 0.3 / len(w)
    channels = FILTERS * len(SPANS)
    net = Net(words, filters, np.full(channels, -0.3, "float32"), np.full(2 * channels, 0.2, "float32"), -3.0)
    memory = [np.full_like(x, 1e-4) for x in (words, *filters, net.bias, net.out)]
    offset_memory = 1e-4

    def step(value: np.ndarray, kept: np.ndarray, slope: np.ndarray, rows: np.ndarray | None = None) -> None:
        where = slice(None) if rows is None else rows
        kept[where] += slope * slope
        value[where] -= RATE * slope / np.sqrt(kept[where] + 1e-8)

    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(own), max(1, len(own) // BATCH)):
            batch = np.array([i for i in batch if len(parts[i])])
            if not len(batch):
                continue
            ids = np.concatenate([parts[i] for i in batch])
            at = np.concatenate([[0], np.cumsum([len(parts[i]) for i in batch])])
            x = embedded(net.words, ids)
            act = net.activations(x, at)
            pooled, most, heads, starts = pool(act, at)
            p = 1 / (1 + np.exp(-(pooled @ net.out + net.offset)))
            slope = ((p - toxic[batch]) / len(batch)).astype("float32")
            offset_memory += float(slope.sum()) ** 2
            d_out = pooled.T @ slope + 1e-4 * net.out
            # back through the pools: a part's maximum gets its share of the mean and, if it is the row's, all of that
            per_row = np.diff(np.r_[starts, len(heads)])
            row_of = np.repeat(np.arange(len(starts)), per_row)
            top = most == pooled[row_of, :channels]
            d_most = slope[row_of, None] * (net.out[channels:] / per_row[row_of, None] + top * net.out[:channels] / np.maximum(np.add.reduceat(top, starts, axis=0)[row_of], 1))
            length = np.diff(np.r_[heads, len(act)])
            is_max = (act == np.repeat(most, length, axis=0)) & (act > 0)
            d_most = d_most / np.maximum(np.add.reduceat(is_max, heads, axis=0), 1)
            where = np.flatnonzero(is_max.any(axis=1))
            d_act = np.repeat(d_most, length, axis=0)[where] * is_max[where]
            end = np.repeat(at[1:], np.diff(at))
            d_x: list[tuple[np.ndarray, np.ndarray]] = []
            for k, w in enumerate(net.filters):
                mine = d_act[:, k * FILTERS : (k + 1) * FILTERS]
                d_w = np.zeros_like(w)
                for j in range(len(w)):
                    ok = where + j < end[where]
                    d_w[j] = x[where[ok] + j].T @ mine[ok]
                    d_x.append((where[ok] + j, mine[ok] @ w[j].T))
                step(w, memory[1 + k], d_w)
            step(net.bias, memory[-2], d_act.sum(axis=0))
            step(net.out, memory[-1], d_out)
            net.offset -= RATE * float(slope.sum()) / np.sqrt(offset_memory)
            rows = np.concatenate([i for i, _ in d_x])
            slopes = np.concatenate([g for _, g in d_x])
            used, inverse = np.unique(ids[rows].ravel(), return_inverse=True)
            total = np.zeros((len(used), WIDTH), "float32")
            np.add.at(total, inverse, np.repeat(slopes, ids.shape[1], axis=0))
            step(net.words, memory[0], 0.2 * total, used)
    tested = np.flatnonzero(check)
    scores = np.concatenate([net.score(parts[i], np.array([0, len(parts[i])])) for i in tested]) if len(tested) else np.zeros(0)
    net.common = best_threshold(scores, toxic[tested])
    for lang in {langs[i] for i in tested}:
        mine = np.array([langs[i] == lang for i in tested])
        if mine.sum() >= LEAST_ROWS and 0 < toxic[tested][mine].sum() < mine.sum():
            net.thresholds[lang] = best_threshold(scores[mine], toxic[tested][mine])
    return net


def best_threshold(scores: np.ndarray, toxic: np.ndarray) -> float:
    """Of the cuts with the fewest errors, the middle of the widest; 0.5 without both classes."""
    if not toxic.any() or toxic.all():
        return 0.5
    order = np.argsort(scores, kind="stable")
    s, y = np.r_[0.0, scores[order], 1.0], toxic[order]
    errors = np.r_[0, np.cumsum(y)] + np.r_[(~y).sum(), (~y).sum() - np.cumsum(~y)]
    gap = s[1:] - s[:-1]
    errors = np.where(gap > 0, errors, len(y) + 1)
    best = np.flatnonzero(errors == errors.min())
    k = best[np.argmax(gap[best])]
    return float(s[k] + s[k + 1]) / 2


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", lang: str = "lang") -> Net:
    """Fit the classifier on labelled rows outside the held-out fold."""
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    # narrow rows: an id and a label, TRAIN_ROWS of them at most
    chosen = marked.orderBy(F.xxhash64("k"), "k").limit(TRAIN_ROWS)
    language = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    given = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), language.alias("l")).join(F.broadcast(chosen), "k")
    rows = given.groupBy("k").agg(F.min(F.struct("t", "l")).alias("d"), F.max("y").alias("y")).select(F.col("k").cast("string"), "d.t", F.coalesce("d.l", F.lit("")).alias("l"), "y", F.xxhash64("k").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        parts, toxic, langs, check, size = [], [], [], [], 0
        for batch in batches:
            for k, t, l, y in zip(*(c.to_pylist() for c in batch.columns[:4])):
                if size + len(t.encode()) > TRAIN_BYTES:
                    continue
                size += len(t.encode())
                parts.append(words_of(t))
                toxic.append(y)
                langs.append(l)
                check.append(zlib.crc32(f"c{k}".encode()) % 4 == 0)
        net = _fit(parts, np.array(toxic, "int64"), langs, np.array(check, bool))
        parts.clear()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])
        trim()

    ready(docs.sparkSession)
    found = rows.coalesce(1).sortWithinPartitions("h", "k").mapInArrow(run, "net binary").collect()
    settle(docs.sparkSession)
    return pickle.loads(found[0]["net"]) if found else _fit([], np.zeros(0, "int64"), [], np.zeros(0, bool))


def toxicity(docs: DataFrame, net: Net, text: str = "text") -> DataFrame:
    """Add the score of every text."""
    ready(docs.sparkSession)
    rest = [c for c in docs.columns if c != "score"]
    given = docs.select(*rest)
    schema = StructType([*given.schema.fields, StructField("score", DoubleType())])
    place = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for batch in batches:
            data, ends = utf8(batch.column(place))
            scores = np.zeros(batch.num_rows)
            for a, b in steps(ends) if not net.empty else ():
                ids, at = features(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                scores[a:b] = net.score(ids, at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=schema.names)
        trim()

    return given.mapInArrow(run, schema)


def rejected(net: Net, score: Column, lang: Column) -> Column:
    """Whether a score reaches its language's threshold."""
    known = F.create_map(*(F.lit(x) for pair in net.thresholds.items() for x in pair)) if net.thresholds else None
    cut = F.coalesce(known[lang], F.lit(net.common)) if known is not None else F.lit(net.common)
    return score >= cut
