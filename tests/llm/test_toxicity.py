from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from sheaf.llm.toxicity import best_threshold, held_out, rejected, toxicity, train


def corpus(spark, n=600):
    r = random.Random(5)
    word = lambda: "".join(r.choice(("re", "ti", "on", "he", "la", "so")) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randint(20, 80))]
        bad = r.random() < 0.25
        if bad:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(("zork", "zorkly", "zorkened", "blag"))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus(spark)
    net = train(docs, labels)
    scored = toxicity(docs, net).join(labels, "doc_id").where(held_out(F.col("doc_id"))).withColumn("out", rejected(net, F.col("score"), F.col("lang"))).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in scored) and len(scored) > 80
    right = np.mean([r["out"] == bool(r["toxic"]) for r in scored])
    assert right > 0.95
    # held-out labels are never used: other labels there give the same scores
    other = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity(docs, train(docs, other)).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in scored)


def test_odd_rows(spark, odd_docs, none_docs):
    docs, labels = corpus(spark, 200)
    net = train(docs, labels)
    got = toxicity(odd_docs, net).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity(none_docs, net).count() == 0
    nothing = train(docs, labels.limit(0))
    assert nothing.empty and {r["score"] for r in toxicity(odd_docs, nothing).collect()} == {0.0}
    assert toxicity(odd_docs, nothing).where(rejected(nothing, F.col("score"), F.col("lang"))).count() == 0
    odd_labels = labels.unionByName(spark.createDataFrame([(None, None, None), (3, None, None), (3, 0, 1)], labels.schema))
    train(docs, odd_labels)


def test_thresholds():
    assert 0.2 < best_threshold(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1], bool)) < 0.8
    assert best_threshold(np.zeros(0), np.zeros(0, bool)) == 0.5
