"""The registered queries themselves, on small tables, against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sheaf.llm.queries import QUERIES, tokenizer
from test_near import brute, contaminated
from test_suffix_dedup import brute as repeats


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(21)
    word = lambda: "".join(r.choice(("re", "ti", "on", "he", "la", "so", "na", "é")) for _ in range(r.randint(1, 4)))
    texts = []
    for i in range(120):
        words = [word() for _ in range(r.choice((0, 2, 30, 80)))]
        if i % 9 == 4 and texts:
            words = texts[-1].split(" ")
            words[len(words) // 2] = "changed"
        if i % 11 == 5:
            words[:0] = r.choice(("Released under the MIT License.", "Licensed under CC BY-NC 4.0, and the Apache License", "GNU General Public License")).split(" ")
        if i % 13 == 6:
            words += [f"bench{k}" for k in range(30)]
        if i % 6 == 1:
            words += ["zorkly"] * 3
        texts.append(" ".join(words))
    texts += [texts[3], texts[3], ""]
    at = tmp_path_factory.mktemp("registered")
    rows = [(i, t if t or i % 2 else None, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int("zorkly" in t)) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(9, " ".join(f"bench{k}" for k in range(30)))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), texts


def run(spark, tables, name, key="doc_id"):
    return {x[key]: x for x in QUERIES[name](spark, tables[0]).collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, tables):
    texts = tables[1]
    got, want = run(spark, tables, "op1_suffix_dedup"), repeats(texts, range(len(texts)))
    for i, (t, kept) in enumerate(zip(texts, want)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(t.encode()), len(t.encode()) - len(kept), hashlib.sha256(kept).hexdigest())


def test_op2(spark, tables):
    got = run(spark, tables, "op2_toxicity")
    assert set(got) == set(range(len(tables[1])))
    for i, x in got.items():
        assert x["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3)


def test_op3_and_op7(spark, tables):
    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    ids = [[*t.encode(x, add_special_tokens=False).ids, 1] for x in tables[1]]
    pieces = QUERIES["op3_packing"](spark, tables[0]).collect()
    for i, own in enumerate(ids):
        mine = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert [p["start"] for p in mine] == np.cumsum([0, *(p["length"] for p in mine)])[:-1].tolist() and sum(p["length"] for p in mine) == len(own)
        assert all(p["doc_tokens"] == len(own) and p["ids_crc32"] == crc(own[p["start"] : p["start"] + p["length"]]) for p in mine)
    for s in {p["sequence_id"] for p in pieces}:
        at = 0
        for p in sorted((p for p in pieces if p["sequence_id"] == s), key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    got, at = run(spark, tables, "op7_repair_ids"), 0
    for i, own in enumerate(ids):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(own), crc(own))
        at += len(own)


def test_op5(spark, tables):
    got = {(x["doc_id"], 0) for x in QUERIES["op5_decontamination"](spark, tables[0]).collect()}
    assert got == contaminated(tables[1], [" ".join(f"bench{k}" for k in range(30))])


def test_op6(spark, tables):
    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = run(spark, tables, "op6_token_counts")
    for i, x in enumerate(tables[1]):
        n = len(t.encode(x, add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(x.encode()), n, n > 1024)


def test_op8(spark, tables):
    top, sizes = brute(tables[1], 3, 85)
    got = run(spark, tables, "op8_minhash")
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(top))] == [(n, c, c == i) for i, (c, n) in enumerate(zip(top, sizes))]


def test_op9(spark, tables):
    base = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    got = run(spark, tables, "op9_licenses")
    for i, x in enumerate(tables[1]):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.encode().lower())
        at = [(k, label) for p, label in base.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.encode().split()]
        places = [k for k, _ in at]
        row = got[i]
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert row["base_labels"] == ",".join(sorted({x for _, x in at})) and set(row["base_labels"].split(",")) <= set(row["labels"].split(",")) | {""}
