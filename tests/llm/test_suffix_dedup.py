from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import suffix_dedup
from sheaf.llm.suffix_dedup import LENGTH, multikey_order, remove_repeats


def brute(texts, ids, length=LENGTH):
    """For each text, which bytes a string of a smaller id covers."""
    at: dict[bytes, int] = {}
    for t, k in zip(texts, ids):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            at[w] = min(at.get(w, 1 << 62), k)
    out = []
    for t, k in zip(texts, ids):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if at[b[p : p + length]] < k:
                gone[p : p + length] = True
        out.append(bytes(np.frombuffer(b, "uint8")[~gone]))
    return out


@pytest.mark.parametrize("seed,limits", [(0, {}), (1, {"HOT": 2}), (2, {"HOT": 0, "SHARD_BYTES": 64, "TASK_BYTES": 4000}), (3, {"BUCKET_BYTES": 64, "BUCKETS": 2, "HOT": 3, "SHARD_BYTES": 200})])
def test_against_brute_force(spark, docs, monkeypatch, seed, limits):
    """Also with shards and parts of buckets that share tasks, and with hot tokens."""
    for name, value in limits.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    r = random.Random(seed)
    base = ["".join(r.choice("ab é\n") for _ in range(r.randint(1, 300))) for _ in range(6)]
    passage = "".join(r.choice("abcdefgh ") for _ in range(120))
    texts = []
    for _ in range(60):
        t = "".join(r.choice("abcdefgh ü") for _ in range(r.randint(0, 200)))
        if r.random() < 0.5:
            t += r.choice(base)
        if r.random() < 0.4:
            i, j = sorted((r.randint(0, 120), r.randint(0, 120)))
            t = t[:50] + passage[i:j] + t[50:]
        texts.append(r.choice([t, t, t, "a" * r.randint(40, 200), r.choice(texts) if texts else t]))
    got = {row["doc_id"]: bytes(row["kept"]) for row in remove_repeats(docs(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, range(len(texts)))


def test_spans_tell_what_was_removed(spark, docs):
    passage = "This passage of the text is longer than fifty bytes, and stands in two documents."
    rows = remove_repeats(docs(["x " + passage, "yy " + passage + " zz"])).orderBy("doc_id").collect()
    assert rows[0]["spans"] == [] and rows[0]["n_bytes"] == len(passage) + 2
    (span,) = rows[1]["spans"]
    # the blank before the passage is common too
    assert (span["begin"], span["end"]) == (2, 3 + len(passage)) and bytes(rows[1]["kept"]) == b"yy zz"


def test_odd_rows(odd_docs, none_docs):
    got = remove_repeats(odd_docs)
    assert got.count() == odd_docs.count() and none_docs.columns == none_docs.columns
    assert {r["n_bytes"] for r in got.where("doc_id is null or doc_id in (2, 3)").collect()} == {0, 32}
    # rows of one id are no sources for one another
    assert all(r["spans"] == [] for r in got.where("doc_id = 1").collect())
    assert remove_repeats(none_docs).count() == 0
    assert got.select(F.sum("score")).first()[0] == 0


def test_multikey_order():
    r = np.random.default_rng(0)
    rows = r.integers(0, 3, (500, 19)).astype("uint8")
    rows[100:200] = rows[:100]
    order, group = multikey_order(rows)
    ordered = [bytes(x) for x in rows[order]]
    assert ordered == sorted(ordered)
    assert len(set(ordered)) == group[-1] + 1 and all((a == b) == (x == y) for a, b, x, y in zip(ordered, ordered[1:], group, group[1:]))
