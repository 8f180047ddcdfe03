"""Exact token counts of every prefix of a text under a byte-level BPE, by dynamic programming over prefixes.

For each prefix of a pre-token there is one last token t such that t may follow the last token of the prefix without
t; two tokens may stand side by side if merging their bytes gives the two again. So the count of a prefix is the
count of the prefix without t, plus one, and no prefix is encoded anew. Counts add up over pre-tokens.

A text is cut into units: white space with the pre-token that follows it. Only inside a unit can a prefix be split
into pre-tokens otherwise than the whole text, and a unit's table holds the counts of its prefixes as they are when the
text ends there. Tables hold one signed byte per code point (the change of the count), or four bytes where a change is
larger, so the table of a text is the units' tables one after another.

Nulls and empty texts have the table of no code points and no tokens. Repeated rows are each counted. Other columns
stay; result columns replace columns of the same names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import claim, ready

#: The special string that the vocabulary file declares; by default it is one token wherever it stands.
SPECIAL = "<|endoftext|>"
#: Units remembered by a worker; beyond this it starts over.
MEMORY = 700_000
_UNIT = r"(?:\s*[^\S ])?'(?:s|t|re|ve|m|ll|d)|\s*\p{L}+|\s*\p{N}+|\s*[^\s\p{L}\p{N}]+|\s+"
#: Contractions whose proper prefixes are two pre-tokens.
_LONG = ("'re", "'ve", "'ll")


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class PrefixCounter:
    """Token counts of prefixes for one vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = {c: b for b, c in enumerate(_byte_letters())}
        raw = lambda s: bytes(back[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items() if all(c in back for c in s)}
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.ids))
        self.side: dict[tuple[bytes, bytes], bool] = {}
        self.units: dict[str, bytes | None] = {}
        self.before: tuple[bytes, list[bytes], list[int]] = (b"", [b""], [0])
        self.find = regex.compile(_UNIT).findall

    def merged(self, data: bytes) -> list[bytes]:
        """The tokens of a short run of bytes, by merging pairs in order of rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            pair, out, i = (parts[at], parts[at + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether token b can directly follow token a, or begin a pre-token where a is empty."""
        if len(self.side) > 2_000_000:
            self.side.clear()
        known = self.side[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def run(self, data: bytes) -> list[int]:
        """Token counts of all prefixes of one pre-token, by bytes; counts[0] is 0."""
        ids, side, longest = self.ids, self.side, self.longest
        # prefixes that the run before has too are not looked at again
        before, last, counts = self.before
        same, most = 0, min(len(data), len(before))
        while same < most and data[same] == before[same]:
            same += 1
        last, counts = last[: same + 1], counts[: same + 1]
        for end in range(same + 1, len(data) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = data[start:end]
                if token in ids:
                    ok = side.get((last[start], token))
                    if ok is None:
                        ok = self.fits(last[start], token)
                    if ok:
                        last.append(token)
                        counts.append(counts[start] + 1)
                        break
            else:
                raise ValueError("the vocabulary does not hold every byte")
        self.before = (data, last, counts)
        return counts

    def pretoken(self, text: str) -> list[int]:
        """Counts of all prefixes of one pre-token, by code points from 1."""
        counts = self.run(text.encode())
        if len(counts) == len(text) + 1:
            return counts[1:]
        at, out = 0, []
        for c in text:
            at += len(c.encode())
            out.append(counts[at])
        return out

    def unit(self, text: str) -> list[int]:
        """Counts of all prefixes of a unit, each as if the text ended there."""
        body = text.lstrip(_SPACES)
        lead = text[: len(text) - len(body)]
        if not body:
            return self.pretoken(text)
        if not lead:
            return self._body(text)
        if lead == " ":
            return self.pretoken(text)
        out = self.pretoken(lead)
        if lead[-1] == " ":
            head, joined = lead[:-1], self.pretoken(" " + body)
            base = self.pretoken(head)[-1] if head else 0
            return out + [base + c for c in joined[1:]]
        # the last white space is no blank: the run before it and it are pre-tokens of their own
        base = (self.pretoken(lead[:-1])[-1] if len(lead) > 1 else 0) + self.pretoken(lead[-1])[-1]
        return out + [base + c for c in self._body(body)]

    def _body(self, text: str) -> list[int]:
        """A contraction's apostrophe and letters are apart until it is whole."""
        if text not in _LONG:
            return self.pretoken(text)
        apart = self.pretoken(text[0])[-1]
        return [apart, *(apart + c for c in self.pretoken(text[1:])[:-1]), self.pretoken(text)[-1]]

    def learn(self, texts: list[list[str]]) -> None:
        """Remember the tables of all units of texts; neighbours in order share prefixes."""
        new = set().union(*texts).difference(self.units)
        if len(self.units) + len(new) > MEMORY:
            self.units.clear()
            new = set().union(*texts)
        for u in sorted(new):
            counts = self.unit(u)
            change = [y - x for x, y in zip([0, *counts], counts)]
            # a unit with a wide change has no table of its own: its text takes the other way
            wide = max(change) > 127 or min(change) < -127
            self.units[u] = None if wide else bytes([c & 255 for c in change])

    def _changes(self, units: list[str]) -> bytes | None:
        try:
            return b"".join(map(self.units.__getitem__, units))
        except TypeError:
            return None

    def _plain(self, text: str) -> np.ndarray:
        """Counts of all prefixes of a text without the special string."""
        units = self.find(text)
        self.learn([units])
        found = self._changes(units)
        return self._slow(text) if found is None else np.cumsum(np.frombuffer(found, dtype="int8"), dtype="int64")

    def _slow(self, text: str) -> np.ndarray:
        out, base = [], 0
        for u in self.find(text):
            counts = self.unit(u)
            out += [base + c for c in counts]
            base += counts[-1]
        return np.array(out, dtype="int64")

    def counts(self, text: str) -> np.ndarray:
        """Token counts of the prefixes of 1, 2, ... code points."""
        if SPECIAL not in text:
            return self._plain(text)
        pieces, out, base = text.split(SPECIAL), [], 0
        for k, piece in enumerate(pieces):
            own = self._plain(piece)
            out.append(base + own)
            if k + 1 < len(pieces):
                # until the special string is whole it is ordinary text that may join the last unit before it
                units = self.find(piece)
                tail = units[-1] if units else ""
                start = len(piece) - len(tail)
                before = base + (int(own[start - 1]) if start else 0)
                open_end = [before + sum(self.unit(u)[-1] for u in self.find(tail + SPECIAL[:j])) for j in range(1, len(SPECIAL))]
                base += (int(own[-1]) if len(own) else 0) + 1
                out.append(np.array([*open_end, base], dtype="int64"))
        return np.concatenate(out)

    def table(self, text: str) -> tuple[int, bytes]:
        """The token count of the whole text and its table: a byte for the width, then the changes by code point."""
        return self.tables([text])[0]

    def tables(self, texts: list[str]) -> list[tuple[int, bytes]]:
        """As table, of many texts."""
        split = [None if SPECIAL in t else self.find(t) for t in texts]
        self.learn([x for x in split if x])
        out = []
        for t, units in zip(texts, split):
            found = None if units is None else self._changes(units)
            if found is not None:
                out.append((int(np.frombuffer(found, dtype="int8").sum(dtype="int64")), b"\x01" + found))
                continue
            counts = self.counts(t) if units is None else self._slow(t)
            change = np.diff(counts, prepend=0)
            narrow = change.min() >= -127 and change.max() <= 127
            out.append((int(counts[-1]), b"\x01" + change.astype("int8").tobytes() if narrow else b"\x04" + change.astype("<i4").tobytes()))
        return out


_SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_OPEN: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """This process's counter for a vocabulary file."""
    claim("token_counts", _OPEN.clear)
    if path not in _OPEN:
        _OPEN[path] = PrefixCounter(path)
    return _OPEN[path]


def prefix_counts(table: bytes) -> np.ndarray:
    """The counts that a table holds: of 0, 1, 2, ... code points."""
    change = np.frombuffer(table, dtype="int8" if table[:1] == b"\x01" else "<i4", offset=1)
    return np.concatenate([[0], np.cumsum(change, dtype="int64")])


def tokens_in_prefix(table: bytes, chars: int) -> int:
    """Tokens of the first chars code points."""
    counts = prefix_counts(table)
    return int(counts[min(chars, len(counts) - 1)])


def longest_prefix(table: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most budget tokens."""
    return int(np.flatnonzero(prefix_counts(table) <= budget)[-1])


def token_tables(docs: DataFrame, path: str, text: str = "text", tables: bool = True) -> DataFrame:
    """Add n_bytes and n_tokens of every text and, with tables, prefix_table (see prefix_counts)."""
    ready(docs.sparkSession)
    names = ["n_bytes", "n_tokens"] + ["prefix_table"] * tables
    rest = [c for c in docs.columns if c not in names and c != text]
    given = docs.select(*rest, F.col(text).cast("string").alias(text))
    schema = StructType([*(f for f in given.schema.fields if f.name != text or tables), StructField("n_bytes", LongType()), StructField("n_tokens", LongType())] + [StructField("prefix_table", BinaryType())] * tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).tables
        for batch in batches:
            texts = [t or "" for t in batch.column(len(rest)).to_pylist()]
            found = count(texts)
            sizes, totals, blobs = [len(t.encode()) for t in texts], [n for n, _ in found], [b for _, b in found]
            kept = [batch.column(i) for i in range(len(rest) + tables)]
            made = [pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())] + [pa.array(blobs, pa.binary())] * tables
            yield pa.RecordBatch.from_arrays(kept + made, names=[f.name for f in schema.fields])

    return given.mapInArrow(run, schema)
