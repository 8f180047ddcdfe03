"""Licence notices in texts, by a positional index of rare words.

Words are runs of ASCII letters, digits and bytes of other scripts, A-Z lower-cased. A first pass counts in how many
texts each word of the licence templates stands. The second pass looks up, for each template whose mandatory words a
text holds, the RARE mandatory words of the highest inverse document frequency in the text's positional index. Each
posting names the place where the template would begin; the postings of these words are intersected by that place, and
no other place can be one, as all these words must stand there. A template whose mandatory phrases all stand at such a
beginning, with at least SHARE of the weight of its words at their places, gives its label. Base phrases give their own
labels wherever their words stand consecutively.

A null or empty text has no words, no labels and score 0. Each of repeated rows is scanned. Other columns stay; result
columns replace columns of the same names. Without texts nothing is counted and nothing returned.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import ready

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    #: Phrases that must stand at their places of the notice.
    must: tuple[str, ...]


#: Notices of public licences as they are put into works.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software", "gnu general public license")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    Template("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
    Template("cc0-1.0", "released under the cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "conditions are met")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind", ("this permission notice shall be included", "without warranty of any kind")),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2 0", "except in compliance with the license")),
    Template("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "either version 3 of the license")),
    Template("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "either version 2 of the license")),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name of", "used to endorse or promote products derived from this software")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)
#: Share of a template's weight that must lie at one beginning.
SHARE = 0.6
#: A template's rarest mandatory words whose postings are intersected.
RARE = 3


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


class Index:
    """The templates' rarest mandatory words with their places in the notices, and weights of all their words."""

    def __init__(self, texts: int, found_in: dict[bytes, int], templates: tuple[Template, ...] = TEMPLATES) -> None:
        self.templates = [(t, words(t.notice.encode()), []) for t in templates]
        self.vocabulary = {w for _, notice, _ in self.templates for w in notice}
        for t, notice, must in self.templates:
            for phrase in t.must:
                p = words(phrase.encode())
                must.append((next(i for i in range(len(notice)) if notice[i : i + len(p)] == p), p))
        self.weight = {w: math.log((1 + texts) / (1 + found_in.get(w, 0))) + 1e-6 for w in self.vocabulary}
        #: By template: its mandatory words, and the rarest of them with their places in the notice.
        self.rarest = []
        for _, _, must in self.templates:
            needed = sorted({(i + j, w) for i, p in must for j, w in enumerate(p)}, key=lambda x: (-self.weight[x[1]], x))
            self.rarest.append((frozenset(w for _, w in needed), needed[:RARE]))
        self.total = [sum(self.weight[w] for w in notice) for _, notice, _ in self.templates]
        self.base = [(words(p.encode()), label) for p, label in BASE.items()]

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float, list[tuple[str, int, int, float]]]:
        """n_words, n_base, first_word, last_word, base labels, labels, score and the spans (label, begin, end, share)."""
        found = words(text)
        vocabulary = self.vocabulary & set(found)
        if not vocabulary:
            return len(found), 0, None, None, "", "", 0.0, []
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(found):
            if w in vocabulary:
                places[w].append(i)
        at, labels = [], set()
        for phrase, label in self.base:
            if all(w in places for w in phrase):
                rare = min(range(len(phrase)), key=lambda j: len(places[phrase[j]]))
                hits = [i - rare for i in places[phrase[rare]] if i >= rare and found[i - rare : i - rare + len(phrase)] == phrase]
                at += hits
                if hits:
                    labels.add(label)
        spans, best = [], 0.0
        for (template, notice, must), (needed, rare), total in zip(self.templates, self.rarest, self.total):
            if not needed <= vocabulary:
                continue
            begins = set.intersection(*({i - q for i in places[w]} for q, w in rare))
            for begin in begins:
                if any(begin + i < 0 or found[begin + i : begin + i + len(p)] != p for i, p in must):
                    continue
                share = sum(self.weight[w] for i, w in enumerate(notice) if 0 <= begin + i < len(found) and found[begin + i] == w) / total
                if share >= SHARE:
                    spans.append((template.label, max(begin, 0), min(begin + len(notice), len(found)), share))
                    best = max(best, share)
        method = {x[0] for x in spans}
        score = min(1.0, max(best, 0.5 if labels else 0.0))
        return len(found), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | method)), score, sorted(spans)


def word_documents(docs: DataFrame, text: str = "text") -> tuple[int, dict[bytes, int]]:
    """The number of texts and, for each word of the templates, of the texts that hold it (a row per word)."""
    vocabulary = frozenset(w for t in TEMPLATES for w in words(t.notice.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        n = 0
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                n += 1
                seen.update(vocabulary.intersection(words(t or b"")))
        yield pa.RecordBatch.from_arrays([pa.array([b"", *seen], pa.binary()), pa.array([n, *seen.values()], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r["word"]): r["n"] for r in rows}
    return found.pop(b"", 0), found


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and spans to every text."""
    ready(docs.sparkSession)
    index = Index(*word_documents(docs, text))
    span = StructType([StructField("label", StringType()), StructField("begin", IntegerType()), StructField("end", IntegerType()), StructField("share", DoubleType())])
    made = StructType([StructField(n, LongType()) for n in ("n_words", "n_base", "first_word", "last_word")] + [StructField("base_labels", StringType()), StructField("labels", StringType()), StructField("score", DoubleType()), StructField("spans", ArrayType(span))])
    rest = [c for c in docs.columns if c not in made.names and c != text]
    given = docs.select(*rest, F.col(text).cast("string").alias(text))
    schema = StructType([*given.schema.fields, *made.fields])
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("share", pa.float64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [index.scan(t or b"") for t in batch.column(len(rest)).cast(pa.binary()).to_pylist()]
            columns = [[x[k] for x in found] for k in range(7)] + [[[dict(zip(("label", "begin", "end", "share"), s)) for s in x[7]] for x in found]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, kinds))], names=schema.names)

    return given.mapInArrow(run, schema)
