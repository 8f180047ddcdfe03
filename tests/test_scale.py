"""Keys, pages and groups beyond what the small tables have."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from sheaf.functions import text, url, vin
from sheaf.operators import crawl, evidence, identity, vehicles
from sheaf.operators import html as H
from sheaf.operators import pagers as P
from sheaf.plans.spec import Rule, VehicleSpec
from sheaf.queries import QUERIES
from sheaf.queries.registry import table


def test_pages_of_long_series(spark):
    links = spark.createDataFrame([("https://x.example/used?page=200000", i, f"https://x.example/used?page={n}") for i, n in enumerate((1, 199_999, 200_001))], "url string, link_no int, target string")
    assert [r["page_number"] for r in crawl.next_in_series(links).collect()] == [200_001]


def test_offsets_of_long_series(spark):
    links = spark.createDataFrame([("https://x.example/used?start=12000000", i, f"https://x.example/used?start={n}") for i, n in enumerate((11_999_976, 12_000_000, 12_000_024))], "url string, link_no int, target string")
    assert [r["offset"] for r in crawl.next_by_offset(links).collect()] == [12_000_024]


def test_labelled_mileage_has_no_ceiling(spark):
    df = spark.createDataFrame([("Spec | Mileage: 1,201,000 | end",), ("a demonstrator with just 400,001 miles",), ("Mileage: 0",)], "t string")
    assert [r["m"] for r in df.select(evidence.labelled_mileage(F.col("t")).alias("m")).collect()] == [1_201_000, 400_001, None]


def test_a_worker_hands_rows_on_before_a_batch_ends(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "")], "page_id long, html string")
    caught = {}
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, f, schema: caught.setdefault("f", f))
    H.per_page(pages, "html", ["page_id"], H.StructType([H.StructField("n", H.IntegerType())]), lambda root, row: [{"n": i} for i in range(300)])
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(20)), "__html": [None, "<p>"] * 10})
    out = list(caught["f"](iter([batch])))
    assert max(b.num_rows for b in out) < 2000 and sum(b.num_rows for b in out) == 6000
    assert [b["page_id"][0].as_py() for b in out if b.num_rows] == [0, 4, 8, 12, 16]


def test_rows_of_a_small_file_are_dealt_out(spark, tmp_path):
    spark.range(20_001).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    many = table(spark, str(tmp_path), "part")
    assert many.rdd.getNumPartitions() == 5 and many.distinct().count() == 20_001
    assert table(spark, str(tmp_path), "nation").rdd.getNumPartitions() == 1


def test_an_origin_may_have_any_number_of_shared_records(spark, monkeypatch):
    monkeypatch.setattr(crawl, "FOLD", 3)
    vin = lambda i: f"1FTFW1ET0EKF{i:05}"
    pairs = [("o", p, i, f"x/{i}", vin(i) if p else None, None if p else 1.5) for i in range(40) for p in (0, 1)]
    chain = [("o", 2, 0, "y/1", vin(900), None), ("o", 2, 1, "y/2", vin(901), 2.5), ("o", 2, 2, "y/1", vin(901), 3.5)]
    rows = spark.createDataFrame([*pairs, *chain, ("p", 0, 0, "x/1", None, 9.0)], "origin string, page_no int, item_no int, detail_key string, vin string, price double")
    got = {(r["origin"], r["detail_key"]): (r["vin"], r["price"]) for r in crawl.dedupe_records(rows).collect()}
    assert got == {("o", f"x/{i}"): (vin(i), 1.5) for i in range(40)} | {("o", "y/1"): (vin(900), 3.5), ("o", "y/2"): (vin(901), 2.5), ("p", "x/1"): (None, 9.0)}


def test_a_url_is_normalised_once_for_its_key(spark):
    df = spark.createDataFrame([("https://www.x.example/vdp/1?utm_source=x",), (None,)], "u string").select(vin.surrogate_vin(F.col("u")).alias("k"), url.card_scope_key(F.col("u")).alias("s"))
    assert str(df._jdf.queryExecution().analyzed()).count("UTF-16LE") == 1
    assert [(r["k"] is None, r["s"]) for r in df.collect()] == [(False, "x.example/vdp/1"), (True, None)]


def test_a_pager_reads_its_pages_once(spark, tmp_path):
    spark.range(1, 13).selectExpr("id as c_custkey", "id % 12 as c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = QUERIES["vehicle_pagers"](spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(r["next_url"][-1], r["reason"]) for r in found.collect() if r["c_custkey"] < 4} == {("3", "label"), ("4", "number"), ("5", "rel_next")}


def test_an_offset_pager_steps_by_its_smallest_gap(spark):
    starts = {"/used?start=24": (0, 48, 72, 48), "/new?start=7": (7, 9), "/inventory?start=12": (12, 24, 18)}
    rows = [(f"https://x.example{u}", i, f"https://x.example{u.split('=')[0]}={n}", "", "x", "x", "a", 0) for u, ns in starts.items() for i, n in enumerate(ns)]
    links = spark.createDataFrame(rows, "url string, link_no int, target string, rel string, text string, label string, selector string, disabled int")
    got = {r["url"]: (r["next_url"], r["reason"]) for r in P.next_vehicle_pages(links, ["url"]).collect()}
    assert got == {"https://x.example/used?start=24": ("https://x.example/used?start=48", "offset"), "https://x.example/inventory?start=12": ("https://x.example/inventory?start=18", "offset")}


def test_a_text_is_cleaned_once_for_its_number(spark):
    t = F.col("t")
    df = spark.createDataFrame([(" $ 1,200.50 / 3 km ",), ("built in 2019, -5",), ("",), (None,)], "t string").select(text.number(t).alias("n"), text.year(t).alias("y"), text.unit(t).alias("u"), text.condition(t).alias("c"))
    assert str(df._jdf.queryExecution().analyzed()).count("(?U)") == 4
    assert [tuple(r) for r in df.collect()] == [(1200.5, None, "km", None), (2019.0, 2019, None, None), (None,) * 4, (None,) * 4]


def test_spread_tasks_do_not_grow_with_few_rows_each(spark, tmp_path):
    spark.range(400_000).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    many = table(spark, str(tmp_path), "part")
    assert many.rdd.getNumPartitions() == 32 and many.distinct().count() == 400_000


def test_a_detail_page_is_read_once(spark):
    pages = spark.createDataFrame([("https://x.example/vdp/1", "<main><p>car</p></main><script type='application/ld+json'>[{\"@type\":\"Car\",\"name\":\"a\"},{\"@type\":\"Car\",\"name\":\"b\",\"url\":\"https://www.x.example/vdp/1/\"}]</script>")] * 2, "url string, html string")
    found = vehicles.detail_records(pages, VehicleSpec(origin="https://x.example", start_urls=("https://x.example/used",), card="li", link="a", fields={"make": Rule(".m")}, detail_root="main", gallery=".g", detail_fields={"color_ext": Rule(".c")}), pages.select("url", F.lit(None).cast("string").alias("expected_vin")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [(r["name"], r["identity_proven"]) for r in found.collect()] == [("b", False)]


def test_an_identity_reads_its_urls_once(spark):
    rows = [("https://x.example/v?vin=1FTFW1ET0EKF00012", ["1FTFW1ET0EKF00012"], [], [], None, None), ("https://x.example/v/1", [], [], ["a.example/b"], "1FTFW1ET0EKF00012", "1FTFW1ET0EKF00012"), ("https://x.example/v/1", [], [], ["a.example/b"], "1FTFW1ET0EKF00012", None)]
    evidence = spark.createDataFrame(rows, "url string, scope_vins array<string>, document_vins array<string>, advertised array<string>, structured_vin string, expected_vin string")
    found = identity.page_identity(evidence)
    assert str(found._jdf.queryExecution().optimizedPlan()).count("(?:^|[^a-z])vin(?:[^a-z]|$)") == 2
    assert [(r["proven_by"], r["identity_proven"]) for r in found.collect()] == [("scope", True), ("structured", True), ("structured", False)]
