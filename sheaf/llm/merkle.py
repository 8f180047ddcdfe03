"""Merkle trees over the pieces, paragraphs and sections of texts.

Paragraphs are lines. A paragraph is cut after words whose hash says so (every sixth or so), so pieces depend on their
own words alone (in texts of under 160 characters each word is a piece); sections are runs of paragraphs that end at a paragraph whose hash says so. A node's hash covers its
children's hashes, the root's the whole text: roots are equal for equal texts and only for those. The fingerprint is a
string: root, then for each section its hash and its paragraphs', each with its pieces' hashes and sizes. Likeness is
the share of characters in pieces that both trees hold (2 common / sum, multiplicities counted), 1 for equal roots.

A null text is the empty text, whose tree has no sections. Ties of ids are ordered by text; null ids come first. Other
columns stay in ``fingerprints``; result columns replace columns of the same names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import bucket_bounds, bucket_of, claim, partitions, ready

#: A piece ends after a word whose hash is 0 modulo this; a section after such a paragraph.
PIECE, SECTION = 6, 4
#: Words of a piece, at least and at most; the characters below which a text is small.
LEAST, MOST, SMALL = 3, 12, 160
_WORD = re.compile(rb"\S+\s*|\s+")
_ENDS: dict[bytes, bool] = {}


def _hash(data: bytes, size: int = 8) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def _ends(word: bytes) -> bool:
    known = _ENDS.get(word)
    if known is None:
        if len(_ENDS) > 500_000:
            _ENDS.clear()
        known = _ENDS[word] = zlib.crc32(word.rstrip()) * 2654435761 % (1 << 32) % PIECE == 0
    return known


def _cut(word: bytes, size: int) -> list[bytes]:
    """A run without white space, cut anew where it is very long."""
    return [word[i : i + size] for i in range(0, len(word), size)] if len(word) > 2 * size else [word]


def pieces(paragraph: bytes, small: bool = False) -> list[bytes]:
    """Content-defined pieces of a paragraph of LEAST to MOST words; of a small text each word is a piece."""
    if small:
        return [x for w in _WORD.findall(paragraph) for x in _cut(w, 6)]
    out, now = [], []
    for w in _WORD.findall(paragraph):
        if len(w) > 64:
            if now:
                out.append(b"".join(now))
                now = []
            out += _cut(w, 32)
            continue
        now.append(w)
        if len(now) >= LEAST and (len(now) == MOST or _ends(w)):
            out.append(b"".join(now))
            now = []
    if now:
        out.append(b"".join(now))
    return out


def tree(text: str) -> tuple[str, Counter[tuple[str, int]]]:
    """The fingerprint root|section:paragraph(piece.size piece.size);paragraph(...)|section:... in hex, and its pieces."""
    data = text.encode()
    bag: Counter[tuple[str, int]] = Counter()
    small = len(text) < SMALL
    sections, now = [], []
    for line in data.split(b"\n"):
        own = [(hashlib.blake2b(p, digest_size=5).hexdigest(), len(p)) for p in pieces(line, small)]
        bag.update(own)
        node = _hash(b"P" + "".join(h for h, _ in own).encode())
        now.append((node, own))
        if node[0] % SECTION == 0:
            sections.append(now)
            now = []
    if now:
        sections.append(now)
    if not data:
        sections = []
    heads = [_hash(b"S" + b"".join(node for node, _ in s)) for s in sections]
    # the root also takes the bytes themselves, so that no two texts share it by their pieces' short hashes
    root = _hash(b"R" + b"".join(heads) + hashlib.sha256(data).digest(), 16)
    return root.hex() + "".join(f"|{h.hex()}:" + ";".join(node.hex() + "(" + " ".join([f"{x}.{n:x}" for x, n in own]) + ")" for node, own in s) for h, s in zip(heads, sections)), bag


def fingerprint(text: str) -> str:
    return tree(text)[0]


def leaves(print_: str) -> Counter[tuple[str, int]]:
    """The pieces of a fingerprint: hash and size."""
    return Counter((m[0], int(m[1], 16)) for m in re.findall(r"([0-9a-f]{10})\.([0-9a-f]+)", print_))


def _share(a: Counter, b: Counter) -> float:
    total = sum(n * c for (_, n), c in a.items()) + sum(n * c for (_, n), c in b.items())
    if len(b) < len(a):
        a, b = b, a
    common = sum(k[1] * min(c, b[k]) for k, c in a.items() if k in b)
    return 2 * common / total if total else 0.0


def likeness(a: str, b: str) -> float:
    """The share of characters in common pieces; 1 if and only if the roots are equal."""
    return _likeness((a, leaves(a)), (b, leaves(b)))


def _likeness(a: tuple[str, Counter], b: tuple[str, Counter]) -> float:
    return 1.0 if a[0][:32] == b[0][:32] else min(_share(a[1], b[1]), 0.999999)


def changed_paragraphs(a: str, b: str) -> list[int]:
    """Paragraphs of b, from 0, that a lacks; equal sections are skipped whole."""
    known = {x.split(":")[0] for x in a.split("|")[1:]}
    there = Counter(p.split("(")[0] for s in a.split("|")[1:] for p in s.split(":")[1].split(";"))
    out, at = [], 0
    for s in b.split("|")[1:]:
        head, _, rest = s.partition(":")
        nodes = [p.split("(")[0] for p in rest.split(";")]
        if head not in known:
            out += [at + k for k, node in enumerate(nodes) if node not in there]
        at += len(nodes)
    return out


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the fingerprint of every text."""
    ready(docs.sparkSession)
    rest = [c for c in docs.columns if c != "fingerprint"]
    given = docs.select(*rest)
    schema = StructType([*given.schema.fields, StructField("fingerprint", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t or "") for t in batch.column(rest.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=schema.names)

    return given.mapInArrow(run, schema)


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each text its fingerprint, that of its edited text, and the likeness to that and to the next text's.

    The edited text has its last quarter of code points replaced by the first as many of the next text by key (the
    last one's next is the first). Texts are shuffled once, into buckets of consecutive keys; the first text of a bucket
    also goes to the bucket before, where only the last text looks at it.
    """
    spark = docs.sparkSession
    ready(spark)
    n = partitions(spark)
    bounds = bucket_bounds(docs, key, n)
    given = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    keys = given.select("k").withColumn("b", bucket_of("k", bounds)).groupBy("b").agg(F.min(F.struct(F.coalesce("k", F.lit(-(1 << 63))).alias("k"))).alias("f")).orderBy("b").collect()
    lead = {}  # the first key of each bucket and the bucket before it (a row per bucket)
    for i, row in enumerate(keys):
        lead[row["f"]["k"]] = keys[i - 1]["b"]
    firsts = F.create_map(*(F.lit(x) for pair in lead.items() for x in pair)) if lead else F.create_map().cast("map<bigint,int>")
    placed = given.withColumn("b", bucket_of("k", bounds)).withColumn("before", firsts[F.coalesce("k", F.lit(-(1 << 63)))])
    both = placed.select("k", "t", F.explode(F.when(F.col("before").isNull(), F.array(F.struct(F.col("b").alias("b"), F.lit(False).alias("ahead")))).otherwise(F.array(F.struct("b", F.lit(False).alias("ahead")), F.struct(F.col("before").alias("b"), F.lit(True).alias("ahead"))))).alias("to"))
    dealt = both.select("k", "t", "to.b", "to.ahead").repartitionById(max(n, len(bounds) + 1), F.col("b")).sortWithinPartitions("b", "ahead", F.col("k").asc_nulls_first(), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("merkle", _ENDS.clear)
        last = None  # bucket, key, text and tree of the row that waits for its next
        for batch in batches:
            out = []
            for k, t, b, ahead in zip(*(c.to_pylist() for c in batch.columns)):
                mine = None if ahead and (last is None or last[0] != b) else tree(t)
                if mine is not None and last is not None and last[0] == b:
                    out.append(_row(last, t, mine))
                    last = None
                if not ahead:
                    last = (b, k, t, mine)
            yield _batch(out)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _row(last: tuple, following: str, beside: tuple[str, Counter]) -> tuple:
    _, k, t, mine = last
    q = len(t) // 4
    edited = t[: len(t) - q] + following[:q]
    other = tree(edited)
    return k, len(t), hashlib.sha256(edited.encode()).hexdigest(), mine[0], other[0], _likeness(mine, other), _likeness(mine, beside)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)
