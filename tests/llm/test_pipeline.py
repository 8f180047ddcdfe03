from __future__ import annotations

import random
import zlib

import pytest

import corpus_pipeline
from test_near import brute, contaminated
from test_suffix_dedup import brute as repeats


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    word = lambda: "".join(r.choice(("re", "ti", "on", "he", "la", "so", "na")) for _ in range(r.randint(1, 4)))
    item = " ".join(f"bench{i}" for i in range(40))
    shared = " ".join(f"shared{i}" for i in range(60))
    rows, toxic = [], []
    for i in range(300):
        words = [word() for _ in range(r.randint(30, 90))]
        bad = i % 5 == 3
        if bad:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(("zorkly", "blagged"))
        text = " ".join(words)
        if i % 17 == 1:
            text += " " + shared
        if i % 50 == 7:
            text = " ".join(words[:20]) + " " + item + " " + " ".join(words[20:])
        if i % 29 == 4:
            text = rows[i - 2][1]
        rows.append((i, text, "en", "s", len(text)))
        toxic.append((i, 1, int(bad)))
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "suffix_dedup", "decontamination", "packing"]
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name == "packing":
            break
        assert out.columns == docs.columns
        kept = {r["doc_id"]: r for r in out.collect()}
        ids = sorted(before)
        texts = [before[i]["text"] for i in ids]
        if name == "toxicity":
            held = [i for i in ids if zlib.crc32(str(i).encode()) % 4 == 2]
            assert sum((i in kept) == (not labels[i]) for i in held) >= 0.95 * len(held)
            assert sum((i in kept) == (not labels[i]) for i in ids) >= 0.97 * len(ids)
        elif name == "near_duplicates":
            top, _ = brute(texts, 5, 80)
            assert set(kept) == {ids[i] for i in range(len(ids)) if top[i] == i}
        elif name == "suffix_dedup":
            want = {i: b.decode("utf-8", "ignore") for i, b in zip(ids, repeats(texts, ids))}
            assert {i: r["text"] for i, r in kept.items()} == {i: t for i, t in want.items() if t or not before[i]["text"]}
            assert all(r["n_chars"] == len(r["text"]) for r in kept.values())
        else:
            found = {ids[d] for d, _ in contaminated(texts, [" ".join(f"bench{i}" for i in range(40))])}
            assert set(kept) == set(ids) - found
        docs = spark.createDataFrame([tuple(r) for r in kept.values()], docs.schema)
        before = kept
    pieces = out.collect()
    assert {r["doc_id"] for r in pieces} == set(before) and all(len(r["ids"]) == 4 * r["length"] for r in pieces)
    ran = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in ran) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in pieces)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, folder, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == odd_docs.columns
    assert docs.count() > 0
