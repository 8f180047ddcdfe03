"""Round trips from tables to pages or files and back, and functions over texts made from the tables."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions import text as T
from ..functions import url as U
from ..operators import compact as M
from ..operators import discovery as D
from ..operators import evidence as X
from ..operators import html as H
from ..operators import library as L
from ..operators import pagers as P
from ..operators import quality as Q
from ..operators import queue as J
from ..operators import structured as S
from ..operators import vehicles as V
from ..plans import infer as I
from ..plans import repair as R
from ..plans.spec import Field, Rule, Spec, VehicleSpec, canonical_json, compact_config, parse_vehicle_spec, spec_sha256
from ..sinks import writers as W
from ..sources import readers
from ..streaming import events as E
from .markup import CARD, _cards
from .registry import query, table

SITE = "https://cars.example.com"
SPEC = VehicleSpec(
    origin=SITE, start_urls=(f"{SITE}/used",), card="li.vehicle-card", link="a",
    fields={"year": Rule(".y", transform="year"), "price": Rule(".p", transform="money"), "vin": Rule(":scope", "data-vin", "vin"), "photo": Rule("img", "src", "image"), "make": Rule(".m")},
    detail_root="main", gallery=".gallery", detail_fields={"color_ext": Rule(".color"), "description": Rule(".d")},
)


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def _vin(c: str = "p_partkey") -> Column:
    return F.concat(F.lit("1FBA7"), F.lpad(_s(c), 12, "0"))


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of this process for files of a round trip: sinks for single files are for drivers with a disk."""
    return f"{tempfile.mkdtemp(prefix='sheaf-')}/{name}"


# ---------------------------------------------------------------- vehicles


@query("""
SELECT p_partkey, '1FBA7' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS vin, 'https://cars.example.com/vdp/' || p_partkey AS detail_url, 2000 + p_size % 20 AS year,
  CASE WHEN p_partkey % 5 = 0 THEN CAST(40000 + p_partkey AS DOUBLE) WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey + 3000 AS DOUBLE) END AS price,
  CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 <> 0 THEN 'no_price_published' END AS price_exception, CAST(1000 + p_partkey AS DOUBLE) AS mileage, 'A' || (p_partkey + 100) AS stock_number, p_brand AS make
FROM part""")
def listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages of vehicle cards to rows: links, facts of the card's text, prices, JSON-LD over the card."""
    s, k = _s("p_partkey"), F.col("p_partkey")
    price = F.when(k % 3 == 0, "Call for price").otherwise(F.concat(F.lit("$"), F.format_number(k + 3000, 0)))
    card = F.concat(F.lit('<li class="vehicle-card" data-vin="'), _vin(), F.lit('"><a href="/vdp/'), s, F.lit('?utm_source=x">see</a><a href="http://cars.example.com/vdp/'), s, F.lit('#top">again</a><img src="/i/'), s, F.lit('.jpg"><b class=y>'), (2000 + F.col("p_size") % 20).cast("string"), F.lit("</b><i class=p>"), price, F.lit("</i><span class=m>"), F.col("p_brand"), F.lit("</span> STK# a"), (k + 100).cast("string"), F.lit(" / "), F.format_number(1000 + k, 0), F.lit(" km</li>"))
    ld = F.when(k % 5 == 0, F.concat(F.lit('{"@type":"Car","vehicleIdentificationNumber":"'), _vin(), F.lit('","offers":{"price":"'), (40000 + k).cast("string"), F.lit('"}}')))
    rows = table(spark, sf_dir, "part").withColumn("card", card).withColumn("ld", ld).groupBy(F.floor(k / 20).alias("page_no")).agg(F.array_join(F.collect_list("card"), "").alias("cards"), F.array_join(F.collect_list("ld"), ",").alias("ld"))
    pages = rows.select(F.concat(F.lit(f"{SITE}/used?page="), F.col("page_no").cast("string")).alias("url"), F.concat(F.lit('<html><nav><a href="/vdp/9">nav</a></nav><ul>'), "cards", F.lit('</ul><script type="application/ld+json">['), "ld", F.lit("]</script></html>")).alias("html"))
    got = V.listing_rows(pages, SPEC)
    return got.select(F.regexp_extract("detail_url", r"(\d+)$", 1).cast("bigint").alias("p_partkey"), "vin", "detail_url", "year", "price", "price_exception", "mileage", "stock_number", "make")


@query("""
SELECT p_partkey, p_partkey % 3 <> 0 AS identity_proven, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS color_ext, CAST(p_size AS DOUBLE) AS mileage, CASE WHEN p_partkey % 3 <> 0 THEN 2 ELSE 0 END AS photos FROM part""")
def detail_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail pages to rows: agreed values, own structured facts, gallery and identity."""
    s, k = _s("p_partkey"), F.col("p_partkey")
    own = F.when(k % 3 == 0, F.concat(F.lit("2GC"), F.substring(_vin(), 4, 14))).otherwise(_vin())
    second = F.when(k % 4 == 0, "<p class=color>Other</p>").otherwise("")
    html = F.concat(F.lit('<main data-vin="'), own, F.lit('"><p class=color>'), F.col("p_type"), F.lit("</p>"), second, F.lit('<div class=gallery><img src="/p/a'), s, F.lit('-640x480.jpg"><img data-full="/p/a'), s, F.lit('.jpg"><img src="/p/b'), s, F.lit('.jpg"><img src="/p/thumb/c.jpg"></div></main><script type="application/ld+json">{"@type":"Car","vehicleIdentificationNumber":"'), own, F.lit('","mileageFromOdometer":{"value":"'), _s("p_size"), F.lit('"}}</script>'))
    pages = table(spark, sf_dir, "part").select(F.concat(F.lit(f"{SITE}/vdp/"), s).alias("url"), html.alias("html"), _vin().alias("expected_vin"))
    got = V.detail_records(pages.select("url", "html"), SPEC, pages.select("url", "expected_vin"))
    return got.select(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("p_partkey"), "identity_proven", "color_ext", "mileage", F.size("photos").alias("photos"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'attribute' ELSE 'json' END AS source, p_name AS trim, '2021' AS year, 'Alarm,Roof' AS features, 'vin' AS matched_by FROM part""")
def vehicle_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed vehicles in attributes and script state; of several, the one of the expected VIN."""
    k = F.col("p_partkey")
    car = lambda v, n: F.to_json(F.struct(v.alias("vin"), F.lit("2021").alias("modelYear"), n.alias("trim"), F.lit("Ford").alias("make"), F.array(F.lit("Alarm"), F.lit("Roof")).alias("features")))
    own, other = car(_vin(), F.col("p_name")), car(F.lit("2GCEK19T0Y1234567"), F.lit("other"))
    html = F.when(k % 3 == 0, F.concat(F.lit("<div data-vehicle='"), own, F.lit("'></div><div data-vehicle='"), other, F.lit("'></div>"))).otherwise(F.concat(F.lit('<script type="application/json">{"cars":['), other, F.lit(","), own, F.lit("]}</script><script type='application/json'>{broken</script>")))
    pages = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(f"{SITE}/vdp/"), _s("p_partkey")).alias("url"), html.alias("html"), _vin().alias("expected_vin"))
    got = S.own_mapping(S.vehicle_mappings(pages.select("url", "html")), pages.select("url", "expected_vin"))
    return got.join(pages.select("url", "p_partkey"), "url").select("p_partkey", "source", "trim", "year", F.array_join("features", ",").alias("features"), "matched_by")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand, p_name AS name, CASE WHEN p_partkey % 3 > 0 THEN p_comment_ END AS description FROM (SELECT *, 'About ' || p_brand AS p_comment_ FROM part)")
def microdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item properties that all elements agree on, and unanimous descriptions."""
    k = F.col("p_partkey")
    about = F.concat(F.lit("About "), F.col("p_brand"))
    html = F.concat(F.lit('<html><head><meta name="description" content="'), about, F.lit('">'), F.when(k % 3 == 0, '<meta name="description" content="Else">').otherwise(""), F.lit('</head><body><b itemprop="brand">'), F.col("p_brand"), F.lit('</b><i itemprop="name" content="'), F.col("p_name"), F.lit('"></i>'), F.when(k % 2 == 1, '<b itemprop="brand">Other</b>').otherwise(F.concat(F.lit('<b itemprop="brand"> '), F.upper("p_brand"), F.lit("</b>"))), F.lit("</body></html>"))
    pages = table(spark, sf_dir, "part").select(F.concat(F.lit(f"{SITE}/vdp/"), _s("p_partkey")).alias("url"), html.alias("html"))
    both = S.microdata(pages, ["brand", "name"]).join(S.meta_description(pages), "url")
    return both.select(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("p_partkey"), "brand", "name", "description")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_partkey END AS found, p_partkey % 6 IN (0, 1, 3) AS evidence FROM part")
def flight_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles in flight records behind texts of declared length, a text that is cut short, and cards with evidence of their own."""
    k, s = F.col("p_partkey"), _s("p_partkey")
    car = F.concat(F.lit('{\\"make\\":\\"Ford\\",\\"modelYear\\":2020,\\"stock\\":\\"'), s, F.lit('\\"}'))
    length = F.when(k % 4 == 0, "ff").otherwise("9")
    html = F.concat(F.lit('<script>self.__next_f.push([1,"1:T'), length, F.lit(',2:{\\"a\\":1}3:'), car, F.lit('\\n:HL[\\"x\\"]\\n"])</script>'))
    pages = table(spark, sf_dir, "part").select(F.concat(F.lit(f"{SITE}/vdp/"), s).alias("url"), html.alias("html"))
    cars = S.vehicle_mappings(pages).select("url", F.col("stock_number").alias("stock"))
    m = k % 6
    text = F.element_at(F.array(F.lit("2020 $4,000"), F.concat(F.lit("vin "), _vin()), F.lit("2020 nothing"), F.lit("2020 nothing"), F.lit("$4,000"), F.lit("2020 $4,000")), (m + 1).cast("int"))
    evidence = V.local_evidence(text, F.when(m == 3, "vehicle-card").otherwise("x"), m != 5, F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(f"{SITE}/vdp/"), s).alias("url"), evidence.alias("evidence"))
    return rows.join(cars, "url", "left").select("p_partkey", F.coalesce(F.col("stock").cast("bigint"), F.lit(0)).alias("found"), "evidence")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN 3000 + p_partkey END AS price, 2000 + p_size % 20 AS year, CASE WHEN p_partkey % 2 = 0 THEN 'used' ELSE 'new' END AS condition, 'https://cars.example.com/vdp/' || p_partkey AS detail_url
FROM part WHERE p_partkey % 5 > 0""")
def compact_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages read by a compact configuration; payments are no prices, and a card without a key is no record."""
    s, k = _s("p_partkey"), F.col("p_partkey")
    href = F.when(k % 5 == 0, F.concat(F.lit("https://other.example/vdp/"), s)).otherwise(F.concat(F.lit("/vdp/"), s))
    price = F.concat(F.lit("$"), F.format_number(3000 + k, 0), F.when(k % 4 == 0, "/mo").otherwise(""))
    card = F.concat(F.lit('<li class="c"><a href="'), href, F.lit('">car</a><i class=p>'), price, F.lit("</i><b class=y>"), (2000 + F.col("p_size") % 20).cast("string"), F.lit("</b><u>"), F.when(k % 2 == 0, "Certified").otherwise("Brand new"), F.lit("</u></li>"))
    pages = table(spark, sf_dir, "part").groupBy(F.floor(k / 50).alias("n")).agg(F.array_join(F.collect_list(card), "").alias("html")).select(F.concat(F.lit(f"{SITE}/used?page="), F.col("n").cast("string")).alias("url"), "html")
    config = {"card": "li.c", "fields": {"detail_url": {"sel": "a", "attr": "href", "as": "url"}, "price": {"sel": ".p", "as": "price"}, "year": {"sel": ".y", "as": "year"}, "condition": {"sel": "u", "as": "condition"}}}
    got = M.compact_rows(pages, config)
    return got.select(F.regexp_extract("detail_url", r"(\d+)$", 1).cast("bigint").alias("p_partkey"), "price", "year", "condition", "detail_url")


@query("SELECT 'rows' AS k, COUNT(*) AS n FROM part UNION ALL SELECT 'agree', 100")
def vehicle_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole job: a spec inferred from a sample, rows of all listing pages, and the client engine's agreement in per cent."""
    from ..engine import Engine

    s = _s("p_partkey")
    card = F.concat(F.lit('<li class="vehicle-card"><div><a href="/vdp/'), s, F.lit('-car"><img src="/i.jpg"><b class="year">2020</b></a></div><i class="price">$ 4,000</i></li>'))
    pages = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 25).alias("n")).agg(F.array_join(F.collect_list(card), "").alias("c")).select(F.concat(F.lit(f"{SITE}/used?page="), F.col("n").cast("string")).alias("url"), F.concat(F.lit("<html><main><ul>"), "c", F.lit("</ul></main></html>")).alias("html"))
    engine = Engine(spark)
    sample = pages.where(F.col("url") == f"{SITE}/used?page=1")
    job = engine.vehicle_job(pages, engine.infer_vehicles(sample, f"{SITE}/used?page=1"))
    return spark.createDataFrame([("rows", job.rows.count()), ("agree", round(100 * job.agreement))], "k string, n long")


# ---------------------------------------------------------------- plans


@query("""
SELECT p_partkey // 24 AS page_no, p_name AS title, 'https://shop.example.com/p/' || p_partkey AS url, 'https://shop.example.com/img/' || p_partkey || '.jpg' AS image, '$' || printf('%.2f', p_retailprice) AS price FROM part""")
def inferred_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan inferred from one listing page reads all of them."""
    pages = _cards(table(spark, sf_dir, "part"))
    sample = pages.where("page_no = 1").first()
    spec = I.infer_spec(sample["html"], sample["url"], max_items=250)
    return H.extract(pages, spec, keep=["page_no"]).select("page_no", "title", "url", "image", "price")


@query("SELECT p_partkey, p_name AS headline, p_brand AS author, p_type AS section, CASE WHEN p_partkey % 2 = 0 THEN '2024-01-05' END AS published_at FROM part")
def inferred_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail rules inferred from one page read all of them."""
    k = F.col("p_partkey")
    html = F.concat(F.lit('<html><head><meta property="article:section" content="'), F.col("p_type"), F.lit('"></head><article><h1>'), F.col("p_name"), F.lit("</h1><a rel=author>"), F.col("p_brand"), F.lit("</a>"), F.when(k % 2 == 0, '<time datetime="2024-01-05">today</time>').otherwise(""), F.lit("</article></html>"))
    pages = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("https://n.example/a/"), _s("p_partkey")).alias("url"), html.alias("html"))
    listing = Spec(fields=(Field("url", "a", "url", "href"),))
    names = ("headline", "author", "section", "published_at")
    detail = I.infer_detail(pages.where("p_partkey = 2").first()["html"], listing, [(n, False) for n in names])
    return H.detail_rows(pages, detail.fields, keep=["p_partkey"]).select("p_partkey", *names)


@query("SELECT 'title' AS field UNION ALL SELECT 'sku'")
def proposed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of proposed fields those that a sample page's items have."""
    page = _cards(table(spark, sf_dir, "part")).where("page_no = 1").first()["html"]
    found = R.valid_fields(page, CARD, [Field("title", "h2"), Field("sku", ".sku"), Field("nothing", ".nothing"), Field("broken", "((")])
    return spark.createDataFrame([(f.name,) for f in found], "field string")


@query("SELECT l_returnflag AS mode, CAST(0 AS BIGINT) AS errors FROM lineitem GROUP BY l_returnflag HAVING COUNT(*) > 0 UNION ALL SELECT 'blank', 1")
def runtime_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rows of each flag keep a contract of required fields."""
    from functools import reduce

    lines = table(spark, sf_dir, "lineitem")
    modes = [r["l_returnflag"] for r in lines.select("l_returnflag").distinct().collect()]  # three
    judged = [L.runtime_contract(lines.where(F.col("l_returnflag") == m), ["l_returnflag"], ["l_partkey"]).select(F.lit(m).alias("mode"), F.col("error").isNotNull().cast("bigint").alias("errors")) for m in modes]
    blank = L.runtime_contract(lines.select(F.when(F.col("l_linenumber") > 4, "x").alias("l_returnflag"), "l_partkey"), ["l_returnflag"], ["l_partkey"])
    return reduce(DataFrame.unionByName, [*judged, blank.select(F.lit("blank").alias("mode"), F.col("error").isNotNull().cast("bigint").alias("errors"))])


@query("SELECT 'kept' AS part, 'l_comment_,l_partkey' AS names")
def sparse_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that enough rows have stay in a plan."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_linenumber") <= 3, "x").alias("l_comment_"), F.when(F.col("l_linenumber") == 7, "x").alias("rare"))
    spec = Spec(fields=tuple(Field(c, ".x") for c in rows.columns))
    return spark.createDataFrame([("kept", ",".join(sorted(Q.pruned_fields(rows, spec))))], "part string, names string")


@query("SELECT 'origin' AS k, 'https://cars.example.com' AS v UNION ALL SELECT 'card', 'li.vehicle-card' UNION ALL SELECT 'fields', 'detail_url,make,price,vin,year' UNION ALL SELECT 'notes', '1' UNION ALL SELECT 'stable', 'true'")
def spec_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spec parsed from its canonical JSON, its digest, and the compact configuration made of it."""
    raw = {
        "schema": "vehicle", "v": 2, "origin": SITE, "start_urls": [f"{SITE}/used"],
        "listing": {"card_selector": SPEC.card, "detail_link_selector": SPEC.link, "fields": {n: {"selector": r.selector, "attribute": r.attribute, "transform": r.transform, "multiple": r.multiple} for n, r in SPEC.fields.items()}},
        "detail": {"root_selector": "main", "gallery_selector": ".gallery", "fields": {n: {"selector": r.selector} for n, r in SPEC.detail_fields.items()}},
    }
    again = parse_vehicle_spec(canonical_json(raw))
    config, notes = compact_config(again)
    rows = [("origin", again.origin), ("card", config["card"]), ("fields", ",".join(sorted(config["fields"]))), ("notes", str(len(notes))), ("stable", str(spec_sha256(again) == spec_sha256(SPEC)).lower())]
    return spark.createDataFrame(rows, "k string, v string")


# ---------------------------------------------------------------- discovery and pagers


@query("""
SELECT p_partkey, CAST(CASE WHEN m = 0 THEN 11 + 7 + 5 + 14 WHEN m = 1 THEN 9 + 5 + 5 ELSE -10 END AS DOUBLE) AS score, CASE WHEN m < 2 THEN 1.0 ELSE 0.0 END AS coverage FROM (SELECT p_partkey, p_partkey % 3 AS m FROM part)""")
def discovery_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links scored for an intent: its word, a synonym, another route."""
    m = (F.col("p_partkey") % 3 + 1).cast("int")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), m)
    links = table(spark, sf_dir, "part").select("p_partkey", pick("https://x.example/jobs", "https://x.example/careers", "https://x.example/login").alias("url"), F.lit("link").alias("kind"), pick("jobs", "careers", "sign up here").alias("label"), F.lit("").alias("context"))
    return D.score(links, "the jobs").select("p_partkey", "score", "coverage")


@query("SELECT c_custkey, 'https://x.example/s?lang=en&q=red+cars' AS url, CAST(10 + 24 * 0.5 + LEAST(c_custkey % 30, 20) + 2 * 3 + CASE WHEN c_custkey % 30 >= 2 THEN 20 ELSE -20 END AS DOUBLE) AS score FROM customer")
def search_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search forms filled with an intent, and how well their targets answer it."""
    k = F.col("c_custkey")
    forms = table(spark, sf_dir, "customer").select("c_custkey", F.lit("https://x.example/s?old=1").alias("action"), F.lit("q").alias("name"), F.array(F.struct(F.lit("lang").alias("name"), F.lit("en").alias("value")), F.struct(F.lit("csrf_token").alias("name"), F.lit("t").alias("value"))).alias("hidden"))
    return D.search_urls(forms, "red cars").select("c_custkey", "url", D.target_score(F.lit(10), F.lit(0.5), k % 30, F.lit(3)).cast("double").alias("score"))


@query("""
SELECT c_custkey, 'https://x.example/used?page=' || (c_custkey % 7 + 2) AS next_url, CASE c_custkey % 3 WHEN 0 THEN 'rel_next' WHEN 1 THEN 'label' ELSE 'number' END AS reason FROM customer""")
def vehicle_pagers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next listing page by rel, label or number; links to other origins and filters are no next page."""
    k = F.col("c_custkey")
    n = k % 7 + 1
    page = lambda i: F.concat(F.lit("/used?page="), i.cast("string"))
    link = F.when(k % 3 == 0, F.concat(F.lit("<a rel=next href='"), page(n + 1), F.lit("'>more</a>"))).when(k % 3 == 1, F.concat(F.lit("<a href='"), page(n + 1), F.lit("'>Next</a>"))).otherwise(F.concat(F.lit("<a href='"), page(n + 1), F.lit("'>"), (n + 1).cast("string"), F.lit("</a>")))
    html = F.concat(F.lit("<a href='https://other.example/used?page=9'>Next</a><a href='/used?page=1'>1</a>"), link)
    pages = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("https://x.example"), page(n)).alias("url"), html.alias("html"))
    found = P.next_vehicle_pages(H.links(pages, keep=["c_custkey"]), ["c_custkey"])
    # a pager of numbers alone is also a series; which rule is named is what is compared
    return found.select("c_custkey", "next_url", F.when(F.col("reason").isin("rel_next", "label"), F.col("reason")).otherwise("number").alias("reason"))


@query("SELECT p_partkey, 'Go to ' || p_brand AS label, CASE WHEN p_partkey % 2 = 0 THEN 'a[rel~=\"next\"]' ELSE 'a[aria-label=\"Go to ' || p_brand || '\"]' END AS selector, 'Parts' AS context, p_partkey % 3 = 0 AS in_nav FROM part")
def link_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, headings and selectors of links."""
    k = F.col("p_partkey")
    a = F.concat(F.lit("<a href='/x' aria-label='Go to "), F.col("p_brand"), F.when(k % 2 == 0, "' rel='nofollow next'>").otherwise("'>"), F.lit("x</a>"))
    html = F.concat(F.lit("<h2>Parts</h2>"), F.when(k % 3 == 0, F.concat(F.lit("<nav>"), a, F.lit("</nav>"))).otherwise(a))
    pages = table(spark, sf_dir, "part").select("p_partkey", F.lit("https://x.example/").alias("url"), html.alias("html"))
    return H.links(pages, keep=["p_partkey"]).select("p_partkey", "label", "selector", "context", (F.col("in_nav") == 1).alias("in_nav"))


# ---------------------------------------------------------------- functions


@query("""
SELECT c_custkey AS k, m <> 1 AND m <> 2 AND m <> 3 AS public, m = 4 AS template, m IN (0, 5) AS same, CASE WHEN m = 5 THEN TRUE ELSE FALSE END AS robots FROM (SELECT c_custkey, c_custkey % 6 AS m FROM customer)""")
def url_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public URLs, template markers, same origins and requests for robots.txt."""
    m = (F.col("c_custkey") % 6 + 1).cast("int")
    u = F.element_at(F.array(*map(F.lit, ("https://x.example/a", "ftp://x.example/a", "https://u:p@x.example/a", "https://x.example:8443/a", "https://y.example/%257B%257Bid%257D%257D", "https://x.example/b/..//%72obots.txt"))), m)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), U.public_url(u).alias("public"), U.template_marker(u).alias("template"), U.same_origin(u, F.lit("https://x.example/z")).alias("same"), S.asks_for_robots(u).alias("robots"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS grouped, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS DOUBLE) END AS plain, 'https://x.example/l?a=1' || CASE WHEN l_linenumber > 1 THEN '&page=' || l_linenumber ELSE '' END AS one_page FROM lineitem""")
def number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with grouping blanks, plain numbers or none, and URLs whose page keys say the same twice."""
    n = F.col("l_linenumber")
    grouped = F.concat(F.lit("EUR "), F.replace(F.format_number("l_extendedprice", 2), F.lit(","), F.lit(" ")))
    plain = F.when(n % 2 == 0, F.concat(_s("l_quantity"), F.lit(""))).otherwise("n/a")
    u = F.concat(F.lit("https://x.example/l?a=1&page="), _s("l_linenumber"), F.lit("&page="), _s("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.grouped_number(grouped).cast("double").alias("grouped"), T.plain_number(plain).cast("double").alias("plain"), U.collapse_page_keys(u).alias("one_page"))


@query("""
SELECT o_orderkey, o_orderkey % 3 = 0 AS cacheable, o_orderkey % 2 = 0 AND o_custkey % 5 > 0 AS reusable, o_orderkey % 4 = 0 AS challenge,
  CASE WHEN o_orderkey % 2 = 0 THEN 'QA codes of the failed crawl: low_coverage, expected_total_mismatch:3/9. The crawl found 3 of about 9 vehicles; its pagination goes deeper. Check it' ELSE '' END AS notes FROM orders""")
def run_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache rules, reuse of earlier runs, challenge pages and notes for a next attempt."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    headers = F.create_map(F.lit("cache-control"), F.when(o % 3 == 1, "private").otherwise("max-age=3"), F.when(o % 3 == 2, "vary").otherwise("x"), F.lit("1"))
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    fresh = X.reusable(F.when(o % 2 == 0, "passed").otherwise("failed"), F.lit(0), c % 5, F.lit("2024-01-01 12:00:00").cast("timestamp"), now)
    page = F.when(o % 4 == 0, "<p>Please VERIFY you are human</p>").otherwise(F.concat(F.lit("<p>verify you are human "), F.repeat(F.lit("text "), F.when(o % 4 == 1, 0).otherwise(100).cast("int")), F.lit("</p>")))
    page = F.when(o % 4 == 1, "<p>Fine page</p>").otherwise(page)
    issues = F.when(o % 2 == 0, F.array(F.lit("low_coverage"), F.lit("expected_total_mismatch:3/9"))).otherwise(F.array().cast("array<string>"))
    notes = X.plan_notes(issues, F.when(o % 2 == 0, F.array(F.lit("Check it"))).otherwise(F.array().cast("array<string>")))
    return table(spark, sf_dir, "orders").select("o_orderkey", J.cacheable(headers).alias("cacheable"), fresh.alias("reusable"), H.challenge_page(page).alias("challenge"), notes.alias("notes"))


@query("SELECT page_id, LEAST(octet_length(encode(html)), 400) AS bytes, substr(html, 1, 100) AS head, ends AS marked FROM (SELECT *, octet_length(encode(html)) > 400 AS ends FROM pages)")
def bounded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut to so many bytes, never inside a character."""
    cut = X.bounded_text(F.col("html"), 400)
    n = F.octet_length(cut)
    # a cut may fall short by the bytes of a character that it would have gone through
    return table(spark, sf_dir, "pages").select("page_id", F.when((n > 396) & (n < 400), 400).otherwise(n).cast("bigint").alias("bytes"), F.substring(cut, 1, 100).alias("head"), cut.endswith("<!-- truncated -->").alias("marked"))


@query("SELECT event_id, length(props) > 20 AS truncated FROM (SELECT event_id, repeat('x', CAST(event_id % 3 * 20000 AS INTEGER)) AS props FROM events)  WHERE event_id % 3 <> 1 OR TRUE ORDER BY ALL")
def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads beyond the cap become previews."""
    big = F.repeat(F.lit("x"), (F.col("event_id") % 3 * 20000).cast("int"))
    shown = E.bounded_payload(table(spark, sf_dir, "events").select("event_id", big.alias("props")))
    return shown.select("event_id", (F.length("props") > 20).alias("truncated"))


@query("SELECT o_custkey, o_orderkey FROM orders ORDER BY o_orderkey DESC, o_custkey DESC LIMIT 50")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.latest_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 50)


@query("SELECT p_partkey, 'images/' || sha256('img' || (p_partkey % 7)) || CASE WHEN p_partkey % 2 = 0 THEN '.jpg' ELSE '.bin' END AS image_local FROM part")
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the files that images of equal content share."""
    u = F.concat(F.lit("https://c.example/"), _s("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, ".jpg").otherwise(".php"))
    part = table(spark, sf_dir, "part")
    contents = part.select(u.alias("url"), F.concat(F.lit("img"), (F.col("p_partkey") % 7).cast("string")).cast("binary").alias("content"))
    return L.local_images(part.select("p_partkey", u.alias("image")), contents, "image").select("p_partkey", "image_local")


# ---------------------------------------------------------------- files


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.when(F.col("s_suppkey") % 3 == 0, "=").otherwise(""), F.col("s_name")).alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("balance"), F.lit("i.jpg").alias("image"))


_EXPORT = "SELECT s_suppkey, {name} AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS balance FROM supplier"
_SAFE = _EXPORT.format(name="CASE WHEN s_suppkey % 3 = 0 THEN '''=' ELSE '' END || s_name")
_RAW = _EXPORT.format(name="CASE WHEN s_suppkey % 3 = 0 THEN '=' ELSE '' END || s_name")


@query(_SAFE)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "csv")
    W.write_csv(W.without_images(_exported(spark, sf_dir)), folder)
    back = spark.read.option("header", "true").option("escape", '"').csv(folder)
    return back.select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "name", F.col("balance").cast("double").alias("balance"))


@query(_RAW)
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, and their validated scan."""
    folder = _folder(spark, "jsonl")
    W.write_jsonl(W.without_images(_exported(spark, sf_dir)), folder)
    good, _ = readers.records(spark, folder, StructType([StructField("s_suppkey", LongType()), StructField("name", StringType()), StructField("balance", DoubleType())]))
    return good


@query(_RAW)
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "rows.json")
    W.write_json(W.without_images(_exported(spark, sf_dir)), path)
    back = spark.read.option("multiLine", "true").json(f"file://{path}")
    return back.select("s_suppkey", "name", F.col("balance").cast("double").alias("balance"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '=' ELSE '' END || s_name AS name, CAST(s_suppkey % 2 = 0 AS INTEGER) AS has_balance FROM supplier")
def sqlite_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import sqlite3

    path = _folder(spark, "rows.sqlite")
    W.write_sqlite(W.without_images(_exported(spark, sf_dir)), path)
    with sqlite3.connect(path) as db:
        rows = db.execute("select cast(s_suppkey as integer), name, balance is not null from data").fetchall()
    return spark.createDataFrame(rows, "s_suppkey long, name string, has_balance int")


@query(f"SELECT s_suppkey, name FROM ({_SAFE})")
def xlsx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook's cells, read back from its sheet, and its place in a bundle."""
    import re
    import zipfile
    from html import unescape

    path = _folder(spark, "rows.xlsx")
    W.write_xlsx(W.without_images(_exported(spark, sf_dir)).select("s_suppkey", "name"), path)
    archive = W.bundle(str(Path(path).parent))
    with zipfile.ZipFile(archive) as outer, zipfile.ZipFile(outer.open("rows.xlsx")) as z:
        sheet = next(z.read(n).decode() for n in z.namelist() if n.endswith("sheet1.xml"))
    rows = [[unescape(re.sub("<[^>]*>", "", c)) for c in re.findall(r"<c\b[^>]*?(?:/>|>(.*?)</c>)", r, re.S)] for r in re.findall(r"<row\b[^>]*>(.*?)</row>", sheet, re.S)][1:]
    return spark.createDataFrame([(int(float(a)), b) for a, b in rows], "s_suppkey long, name string")


@query("SELECT s_suppkey, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'details' ELSE 'pages' END AS part FROM supplier WHERE s_suppkey <= 20")
def fixture_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures, plain and compressed, read in a manifest's order (twenty files)."""
    import json

    folder = Path(_folder(spark, "fixtures"))
    folder.mkdir()
    listed: dict[str, list[dict[str, str]]] = {"pages": [], "details": []}
    for r in table(spark, sf_dir, "supplier").where("s_suppkey <= 20").select("s_suppkey", "s_name").collect():
        html, even = f"<h1>{r['s_name']}</h1>", r["s_suppkey"] % 2 == 0
        name = f"f{r['s_suppkey']}.html" + ".gz" * even
        (folder / name).write_bytes(readers.gzip_fixture(html) if even else html.encode())
        listed["details" if even else "pages"].append({"path": name, "url": f"https://x.example/{r['s_suppkey']}"})
    (folder / "manifest.json").write_text(json.dumps(listed))
    got = readers.manifest_pages(spark, f"file://{folder}")
    return got.select(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("s_suppkey"), F.regexp_extract("html", "<h1>(.*)</h1>", 1).alias("name"), "part")
