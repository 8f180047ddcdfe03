from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import photo as P
from sheaf.operators import html as H
from sheaf.operators import pagers as G
from sheaf.operators import structured as S

VIN = "1FTFW1ET0EKF12345"
PAGE = f"""<html><head><meta name="description" content="Fine car"><meta name="Description" content="Fine  car"></head><body data-vehicle='{{"vin":"{VIN}","make":"Ford","price":100}}'>
<script type="application/json">{{"props":{{"list":[{{"stockNumber":"A1","modelYear":2019,"offers":[{{"price":"9"}},{{"price":"9"}}],"features":["ABS|AC",{{"name":"GPS"}}],"detailUrl":"https://x.example/v/1"}},{{"a":1}}]}}}}</script>
<script>window.__STATE__ = {{"car":{{"brand":{{"name":"Kia"}},"mileage":{{"value":"5"}}}}}}; self.__next_f.push([1,"3:{{\\"make\\":\\"Audi\\",\\"model\\":\\"A4\\"}}\\n4:x"])</script><script type="application/json">{{broken</script>
<p itemprop="color">Red</p><p itemprop="color">red</p><p itemprop="model">A</p><p itemprop="model">B</p></body></html>"""


def pages(spark):
    return spark.createDataFrame([("https://x.example/v/1?ref=a", PAGE), ("https://x.example/none", "<p>x")], "url string, html string")


def test_mappings_from_everywhere(spark):
    got = S.vehicle_mappings(pages(spark)).orderBy("node_no").collect()
    assert [(r["source"], r["make"], r["price"]) for r in got] == [("attribute", "Ford", "100"), ("json", None, "9"), ("state", "Kia", None), ("flight", "Audi", None)]
    assert got[1]["year"] == "2019" and got[1]["features"] == ["ABS|AC", "GPS"] and got[2]["mileage"] == "5"


def test_own_mapping_by_vin_then_url(spark):
    m = S.vehicle_mappings(pages(spark))
    expect = lambda v: spark.createDataFrame([("https://x.example/v/1?ref=a", v)], "url string, expected_vin string")
    (a,) = S.own_mapping(m, expect(VIN)).collect()
    assert (a["make"], a["matched_by"]) == ("Ford", "vin")
    (b,) = S.own_mapping(m, expect("2FTFW1ET0EKF12345")).collect()
    assert (b["stock_number"], b["matched_by"]) == ("A1", "url")


def test_microdata_and_descriptions_are_unanimous(spark):
    got = {r["url"]: r for r in S.microdata(pages(spark), ["color", "model"]).collect()}
    assert (got["https://x.example/v/1?ref=a"]["color"], got["https://x.example/v/1?ref=a"]["model"]) == ("Red", None)
    assert {r["description"] for r in S.meta_description(pages(spark)).collect()} == {"Fine car", None}


def test_robots_paths(spark):
    df = spark.createDataFrame([("https://x.example//a/%2e%2e/%2572obots.txt",), ("https://x.example/a/robots.txt",)], "u string")
    assert [r["r"] for r in df.select(S.asks_for_robots(F.col("u")).alias("r")).collect()] == [True, False]


def test_the_walk_is_bounded():
    deep: dict = {}
    at = deep
    for _ in range(30):
        at["x"] = {}
        at = at["x"]
    assert len(list(S.walk(deep))) == S.DEPTH + 1
    assert len(list(S.walk([{"a": 1}] * 2000))) == S.CHILDREN


def test_full_size_photos(spark):
    urls = [
        ("https://img.sm360.ca/ir/w640h480/images/inventory/d/ford/f150/2020/12/a.jpg", "https://img.sm360.ca/images/inventory/d/ford/f150/2020/12/a.jpg", True),
        ("https://vehicle-images.carscommerce.inc/ab12-34/1FTFW1ET0EKF12345/thumbnails/large/x.jpg", "https://vehicle-images.carscommerce.inc/ab12-34/1FTFW1ET0EKF12345/x.jpg", True),
        ("https://x.example/wp-content/uploads/2020/05/car.jpg", "https://x.example/wp-content/uploads/2020/05/car.jpg", True),
        ("https://x.example/wp-content/uploads/2020/05/car-300x200.jpg", "https://x.example/wp-content/uploads/2020/05/car-300x200.jpg", False),
        ("https://pictures.dealer.com/a/thumb_x.jpg", "https://pictures.dealer.com/a/thumb_x.jpg", False),
    ]
    df = spark.createDataFrame([(u,) for u, _, _ in urls], "u string")
    assert [(r["f"]["url"], r["f"]["full"]) for r in df.select(P.full_size(F.col("u")).alias("f")).collect()] == [(w, f) for _, w, f in urls]


def test_next_page_cascade(spark):
    rows = [
        ("https://x.example/used", '<a href="/used?page=2">2</a><a href="/used?make=x&page=2">Next</a><a href="/specials">Next</a>'),
        ("https://x.example/used/?make=a", '<a href="/used/?make=a&page=2" rel="next">go</a><a href="/used/?make=b&page=2" rel="next">go</a>'),
        ("https://x.example/inventory/?start=24", '<a href="/inventory/?start=0">1</a><a href="/inventory/?start=24">2</a><a href="/inventory/?start=48">3</a><a href="/inventory/?start=168">last</a>'),
        ("https://x.example/inventory/?start=48", '<a href="/inventory/?start=0">1</a><a href="/inventory/?start=24">2</a><a href="/inventory/?start=168">last</a>'),
        ("https://x.example/about", '<a href="/contact">Next</a>'),
    ]
    df = spark.createDataFrame(rows, "url string, html string")
    got = {r["url"]: (r["next_url"], r["reason"]) for r in G.next_vehicle_pages(H.links(df), ["url"]).collect()}
    assert got == {
        "https://x.example/used": ("https://x.example/used?page=2", "number"),
        "https://x.example/used/?make=a": ("https://x.example/used/?make=a&page=2", "rel_next"),
        "https://x.example/inventory/?start=24": ("https://x.example/inventory/?start=48", "offset"),
    }
