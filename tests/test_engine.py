from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sheaf.engine import Engine
from sheaf.operators import crawl, identity, runs, similarity, structured
from sheaf.plans import cards
from sheaf.plans.spec import Rule, VehicleSpec
from sheaf.sinks import writers
from sheaf.streaming import events

SITE = "https://cars.example.com"


def listing(n, price=".p"):
    item = lambda k: f'<li class="vehicle-card"><div><a href="/vdp/{k}-car"><img src="/{k}.jpg"><b class="year">2020</b></a></div><i class="p">$ {k},000</i></li>'
    return f"<html><main><ul>{''.join(item(k) for k in range(1, n + 1))}</ul></main></html>"


def test_a_run_store_is_scanned(spark, tmp_path):
    good, lame, odd = "ab" * 8, "cd" * 8, "nothex"
    for name, files in ((good, ("run.json", "record.json")), (lame, ("run.json",)), (odd, ("run.json", "record.json"))):
        (tmp_path / name).mkdir()
        for f in files:
            body = {"status": "passed", "items": 3} if f == "run.json" else {"request": {"urls": ["u"]}, "callback_token": "secret", "rebuild_ids": ["x"], "generation": 0}
            (tmp_path / name / f).write_text(json.dumps(body))
    (row,) = Engine(spark).history(str(tmp_path)).collect()
    assert (row["run_id"], row["status"], row["items"], row["generation"], row["rebuild_ids"], row["failures"]) == (good, "passed", 3, 1, ["x"], 0)
    assert len(row["token_hash"]) == 64


def test_foreign_parts_leave_a_vehicle(spark):
    vin, other = "1FTFW1ET0EKF12345", "2FTFW1ET0EKF12345"
    m = {"vin": vin, "make": "Ford", "offers": {"price": 3}, "similarVehicles": [{"vin": other}], "images": [{"url": "a"}, {"vin": other, "make": "X", "year": 1}], "notes": None}
    assert structured.owned(m, vin) == {"vin": vin, "make": "Ford", "offers": {"price": 3}, "images": [{"url": "a"}], "notes": None}


def test_scopes_and_related_regions():
    from sheaf.dom import parse

    root = parse("<body><main id=a><p>x</p></main><section><h3>Similar cars</h3><b data-vin=1FTFW1ET0EKF12345></b></section><div class=d data-vin=1FTFW1ET0EKF12345></div><div class=d></div></body>")
    body = root.first("body")
    assert identity.related(root.first("b"), body) and not identity.related(root.first("p"), body)
    assert identity.scope_of(root, "div.d", "1FTFW1ET0EKF12345").get("class") == "d" and identity.scope_of(root, "div.none").name == "main"


def test_a_better_proposal_wins(spark):
    pages = spark.createDataFrame([(f"{SITE}/used", listing(6))], "url string, html string")
    base = VehicleSpec(origin=SITE, start_urls=(f"{SITE}/used",), card="li.vehicle-card", link="a", fields={"year": Rule("b.year", transform="year")})
    more = VehicleSpec(origin=SITE, start_urls=(f"{SITE}/used",), card="li.vehicle-card", link="a", fields={"year": Rule("b.year", transform="year"), "price": Rule(".p", transform="money")})
    less = VehicleSpec(origin=SITE, start_urls=(f"{SITE}/used",), card="li.none", link="a", fields=more.fields)
    engine = Engine(spark)
    assert engine.improve(pages, base, [less, more]) == more
    job = engine.vehicle_job(pages, more)
    assert job.rows.count() == 6 and job.agreement == 1.0 and job.verdict in ("ship", "needs_repair") and job.config["card"] == "li.vehicle-card"


def test_generic_runs(spark, tmp_path):
    page = "<main>" + "".join(f"<article class=item><h2>Title {k}</h2><a href=/p/{k}>see</a><span class=price>${k}.00</span></article>" for k in range(1, 6)) + "</main>"
    pages = spark.createDataFrame([("https://x.example/l", page)], "url string, html string")
    engine = Engine(spark)
    spec = engine.plan(page, "https://x.example/l", [("title", True)])
    rows = engine.rows(pages, spec)
    assert rows.count() == 5 and engine.verify(rows, spec)["row_count"] == 5
    engine.export(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 5
    assert engine.preview(rows).count() == 5
    assert engine.discover(pages, "see 3", 2).count() == 2


def test_a_stream_resumes_where_it_stopped(spark, tmp_path):
    schema = "seq long, run string, event_type string, ts string, props string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    follow = lambda: events.follow(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    put([(1, "a", "row", "2024-01-01", "x"), (2, "a", "passed", "2024-01-01", "y" * 50_000)])
    follow()
    put([(3, "b", "row", "2024-01-02", "z")])
    follow()
    follow()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [r["seq"] for r in got] == [1, 2, 3] and len(got[1]["props"]) < 2000
    assert [tuple(r) for r in events.ended(spark.read.parquet(str(tmp_path / "out"))).collect()] == [("a", 2)]


def test_weak_values_alone_are_no_match(spark):
    q = spark.createDataFrame([("q", "h", "gallery_mechanisms", "gallery:srcset"), ("q", "h", "platform_tokens", "platform:sm360"), ("q", "h", "photo_cdn_hosts", "cdn:a"), ("q", "h", "photo_cdn_hosts", "cdn:b"), ("q", "h", "photo_cdn_hosts", "cdn:c")], "query string, host string, feature string, value string")
    library = spark.createDataFrame([("o", "x", "ship", f, v) for f, v in (("gallery_mechanisms", "gallery:srcset"), ("platform_tokens", "platform:sm360"), ("photo_cdn_hosts", "cdn:a"), ("photo_cdn_hosts", "cdn:b"), ("photo_cdn_hosts", "cdn:c"))] + [("w", "y", "ship", "gallery_mechanisms", "gallery:srcset")], "origin string, host string, verdict string, feature string, value string")
    (r,) = similarity.similar(q, library).collect()
    assert (r["origin"], r["overlap"]) == ("o", 4.0 + 7.5 + 1.0)
    with pytest.raises(ValueError):
        similarity.similar(q, library, floor=5.0)


def test_a_fold_is_bounded(spark, monkeypatch):
    rows = spark.createDataFrame([("o", 0, i, "same", None) for i in range(4)] + [("o", 0, 9, "alone", None)], "origin string, page_no int, item_no int, detail_key string, vin string")
    assert crawl.dedupe_records(rows).count() == 2
    monkeypatch.setattr(crawl, "FOLD", 3)
    with pytest.raises(Exception, match="share keys"):
        crawl.dedupe_records(rows).count()


def test_numbers_of_a_preview(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", None, 2.5)], "x string, y int, z double")
    assert writers.numeric_columns(writers.preview(df)) == [1, 2]


def test_detail_contracts_are_ranked(spark):
    vin = "1FTFW1ET0EKF12345"
    html = f"<body><main><div class=g><img alt='{vin}' src=https://c.example/a.jpg><img alt='{vin}' src=https://c.example/b.jpg></div><div class=h><img src=https://c.example/z.jpg></div></main></body>"
    pages = spark.createDataFrame([(f"{SITE}/vdp/1", html)], "url string, html string")
    cars = spark.createDataFrame([(f"{SITE}/vdp/1", vin, True, [], 2020, "Ford", "F150")], "url string, expected_vin string, identity_proven boolean, declared array<string>, year int, make string, model string")
    got = cards.detail_contract(pages, cars, ["main"], [".g", ".h"], ["img"]).orderBy("rank").collect()
    assert [(r["gallery"], r["proven"], r["photos"]) for r in got] == [(".g", 1, 2), (".h", 0, 0)]


def test_ready_without_known_pages(spark):
    rows = spark.createDataFrame([("p", "https://x.example/1")], "url string, detail_url string")
    assert runs.ready_listings(rows, rows.limit(0)).first()["ready"]
    assert not runs.ready_listings(rows, rows).first()["ready"]
    assert rows.select(F.lit(1)).count() == 1
