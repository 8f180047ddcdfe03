from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sheaf.operators import library as L
from sheaf.operators import similarity as S


def test_records_are_closed_and_bounded():
    got = L.library_record("https://a.example", "ship", {"platform_tokens": ["b", "a", "a", ""]})
    assert got["platform_fingerprint"]["platform_tokens"] == ["a", "b"]
    for bad in (("nope", {}), ("ship", {"other": []}), ("ship", {"pagination": ["<b>"]}), ("ship", {"pagination": ["api_key=1"]})):
        with pytest.raises(ValueError):
            L.library_record("https://a.example", *bad)


def test_matches_are_found_and_rendered(spark):
    records = [L.library_record(f"https://{n}.example", "ship", {"platform_tokens": tokens, "pagination": ["p"]}) for n, tokens in (("a", ["x", "y", "z"]), ("b", ["x"]), ("me", ["x", "y", "z"]))]
    lib = L.library_features(spark.createDataFrame([(r["origin"], r["verdict"], r["platform_fingerprint"]) for r in records], "origin string, verdict string, platform_fingerprint map<string, array<string>>"))
    q = spark.createDataFrame([("q", "me.example", "platform_tokens", v) for v in ("x", "y", "z")], "query string, host string, feature string, value string")
    found = S.similar(q, lib)
    assert [(r["origin"], r["score"]) for r in found.collect()] == [("https://a.example", 12.0)]
    shared = q.join(lib.select("origin", "feature", "value"), ["feature", "value"])
    (row,) = L.rendered(found, shared).collect()
    assert row["text"] == "1. https://a.example (score 12.00) shares platform_tokens: x, y, z"


def test_photo_path_grammars_of_pages(spark):
    urls = {
        1: "https://a.example/service/picture/1.jpg", 2: "https://a.example/Resize/640X480/1.jpg", 3: "https://a.example/1.jpg?impolicy=x&w=1", 4: "https://imagescf.dealercenter.net/640/480/1.jpg",
        5: "https://content.homenetiol.com/1.jpg", 6: "https://getauto.photos/1/640x480/1.jpg", 7: "https://a.example/640x480.jpg?Impolicy=x", 8: None,
    }
    pages = spark.createDataFrame([(k, u and f'<img src="{u}">') for k, u in urls.items()], "page_id long, html string")
    found = S.features(pages, "page_id")
    got = sorted((r["page_id"], r["value"]) for r in found.where("feature = 'photo_path_grammars'").collect())
    names = {1: ["/service/picture/"], 2: ["resize-WxH-segment"], 3: ["impolicy-query"], 4: ["dealercenter-numeric-pair"], 5: ["homenet-media"], 6: ["homenet-media", "resize-WxH-segment"]}
    assert got == [(k, f"grammar:{n}") for k, v in names.items() for n in v]
    (weight,) = found.where("page_id = 3 and feature = 'photo_path_grammars'").select(S.weight(F.col("feature"), F.col("value"))).first()
    assert weight == 2.0


def test_evidence_is_bounded(spark):
    raw = json.dumps({"a": "<b>" * 300, "deep": {"x": {"y": {"z": 1}}}, "list": list(range(50)), "big": 1e20})
    df = spark.createDataFrame([(raw,), ("[1]",), (None,), (json.dumps({str(i): "x" * 400 for i in range(16)}),)], "e string")
    a, b, c, d = (r["e"] for r in df.select(L.bounded_evidence(F.col("e")).alias("e")).collect())
    x = json.loads(a)
    assert "<" not in x["a"] and len(x["a"]) == 400 and x["deep"]["x"]["y"] is None and len(x["list"]) == 10 and x["big"] is None
    assert b is None and c is None and json.loads(d)["truncated"]


def test_images_of_one_content_are_one_file(spark):
    rows = spark.createDataFrame([("u1.jpg",), ("u2.jpg?x",), ("none",)], "image string")
    contents = spark.createDataFrame([("u1.jpg", b"x"), ("u2.jpg?x", b"x")], "url string, content binary")
    got = {r["image"]: r["image_local"] for r in L.local_images(rows, contents, "image").collect()}
    assert got["u1.jpg"] == got["u2.jpg?x"] and got["u1.jpg"].endswith(".jpg") and got["none"] is None


def test_runtime_contract(spark):
    df = spark.createDataFrame([("a", None), ("b", "x"), (None, None)], "t string, u string")
    error = lambda *a, **k: L.runtime_contract(df, *a, **k).first()["error"]
    assert error([], []) is None and error(["t"], []) == "required field t was empty in 1/3 rows"
    assert error([], ["nope"]) == "no prioritized field has data" and error([], [], least=4) == "expected 4 rows but received 3"
    assert L.runtime_contract(df.limit(0), ["t"], []).first()["error"] == "zero rows"


def _brute(q, lib, k=2):
    found = []
    for query in {r[0] for r in q}:
        scored = []
        for origin in {r[0] for r in lib}:
            shared = {(o[1], o[2], f, v) for _, h, f, v in (r for r in q if r[0] == query) for o in lib if o[0] == origin and o[3:] == (f, v) and (h is None or o[1] is not None and h != o[1])}
            if shared:
                score = round(sum(S.WEIGHTS[c[2]] for c in shared) * S.VERDICTS[min(c[1] for c in shared)], 2)
                scored += [(-score, origin)] if score >= 10 else []
        found += [(query, o, -s) for s, o in sorted(scored)[:k]]
    return sorted(found)


def test_equal_records_are_compared_once(spark, monkeypatch):
    tokens = lambda names: [("platform_tokens", n) for n in names]
    lib = [(f"o{i:02}", None if i == 3 else f"h{i % 5}", ("ship", "review")[i % 2], *c) for i in range(24) for c in tokens("abcd"[: 3 + i % 2])]
    lib += [("x0", h, "ship", *c) for h in ("h0", "h9") for c in tokens("abc")]  # a record of two hosts
    q = [(f"q{i:02}", None if i % 4 == 3 else f"h{i % 6}", *c) for i in range(16) for c in tokens("abc" if i % 2 else "abcd")]
    sizes = []
    pairs = S._pairs
    monkeypatch.setattr(S, "_pairs", lambda a, b: sizes.append((a.select("query").distinct().count(), b.select("origin").distinct().count())) or pairs(a, b))
    got = S.similar(spark.createDataFrame(q, "query string, host string, feature string, value string"), spark.createDataFrame(lib, "origin string, host string, verdict string, feature string, value string"))
    assert sorted((r["query"], r["origin"], r["score"]) for r in got.collect()) == _brute(q, lib)
    assert sizes == [(2, 2), (0, 25), (16, 1)]
