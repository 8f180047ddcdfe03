"""Queries of run evidence: parsers of listing texts, reuse, parity, verdicts, loops and photo sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as X
from .registry import query, table


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN 2019 END AS year, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS make,
  CASE WHEN p_partkey % 5 <> 0 THEN split_part(p_name, ' ', 1) END AS model, CASE WHEN p_partkey % 5 <> 0 THEN split_part(p_name, ' ', 2) END AS trim FROM part""")
def title_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.when(F.col("p_partkey") % 5 == 0, "Any ").when(F.col("p_partkey") % 2 == 0, "Used ").otherwise(""), F.lit("2019 "), F.col("p_brand"), F.lit("  "), F.col("p_name"))
    t = X.title_parts(title)
    return table(spark, sf_dir, "part").select("p_partkey", *(t[n].alias(n) for n in ("year", "make", "model", "trim")))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(1000 + p_partkey AS INTEGER) WHEN 1 THEN CAST(2000 + p_partkey AS INTEGER) END AS mileage,
  CASE p_partkey % 3 WHEN 0 THEN 'gasoline' WHEN 1 THEN 'plug-in hybrid' END AS fuel, CASE WHEN p_partkey % 2 = 0 THEN 'AWD' ELSE 'Chain' END AS drivetrain, CAST(16000 + p_partkey % 900 + 100 AS DOUBLE) AS price FROM part""")
def labelled_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    n = lambda base: F.format_number(k + base, 0)
    line = F.when(k % 4 == 0, F.concat(F.lit("Mileage: "), n(1000))).when(k % 4 == 1, F.concat(F.lit("a demonstrator with just "), n(2000), F.lit(" miles"))).when(k % 4 == 2, "EPA range has 286 miles").otherwise("100,000 miles warranty")
    fuel = F.when(k % 3 == 0, "Fuel Type: Gas").when(k % 3 == 1, "Fuel Type | Plugin Hybrid").otherwise("none")
    text = F.concat(F.lit("Spec | "), line, F.lit(" | warranty 60 months | "), fuel, F.lit(" | end"))
    drive = F.when(k % 2 == 0, "https://schema.org/AllWheelDriveConfiguration").otherwise("ChainConfiguration")
    price = F.concat(F.lit("16 "), F.lpad((k % 900 + 100).cast("string"), 3, "0"), F.lit(" $"))
    return table(spark, sf_dir, "part").select("p_partkey", X.labelled_mileage(text).alias("mileage"), X.labelled_fuel(text).alias("fuel"), X.drivetrain(drive).alias("drivetrain"), X.grouped_number(price).alias("price"))


@query("SELECT p_partkey, [p_type, 'Air bags', CAST(p_size AS VARCHAR)] AS features FROM part")
def feature_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(F.concat("p_type", F.lit(" |Air  bags; "), F.col("p_size").cast("string")), F.lit("AIR BAGS\n"), F.lower("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", X.features(values).alias("features"))


@query("""
SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS priority, arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) AS price FROM orders GROUP BY o_custkey""")
def sparse_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("price"))
    return X.merge_sparse(rows, ["o_custkey"], ["o_orderkey"])


_VIN = "'1FT' || lpad(CAST(p_partkey AS VARCHAR), 10, 'AB') || 'C123'"


@query(f"""
SELECT v AS vin, 'https://x.example/v/' || p_partkey AS detail_url, 'f/' || p_partkey AS fixture, md5('f/' || p_partkey) AS sha256, '"e' || p_partkey || '"' AS etag
FROM (SELECT *, {_VIN} AS v FROM part) WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 0 AND p_partkey % 7 <> 0""")
def reuse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    s = k.cast("string")
    part = table(spark, sf_dir, "part")
    url = F.concat(F.lit("https://x.example/v/"), s)
    vin = F.when(k % 7 == 0, F.concat(F.lit("URLKEY"), F.lpad(s, 11, "0"))).otherwise(F.concat(F.lit("1FT"), F.lpad(s, 10, "AB"), F.lit("C123")))
    fixture = F.concat(F.lit("f/"), s)
    etag = F.concat(F.when(k % 3 == 0, '"e').otherwise('W/"e'), s, F.lit('"'))
    return X.reuse_index(part.select(vin.alias("vin"), url.alias("detail_url")), part.where(k % 2 == 0).select(F.concat(url, F.lit("#x")).alias("url"), fixture.alias("fixture"), F.md5(fixture).alias("sha256")), part.select(url.alias("url"), etag.alias("etag")), "https://x.example")


@query("""
SELECT FALSE AS equal, CAST(COUNT_IF(o_orderkey % 10 = 0) AS BIGINT) AS only_left, 0 AS only_right, CAST(COUNT_IF(o_orderkey % 10 = 1) AS BIGINT) AS different FROM orders""")
def run_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    left = table(spark, sf_dir, "orders").select(k.alias("ord"), F.col("o_orderpriority").alias("fp"))
    return X.parity(left, left.where("ord % 10 <> 0").withColumn("fp", F.when(F.col("ord") % 10 == 1, "other").otherwise(F.col("fp"))))


@query("SELECT COUNT(*) AS vins, CAST(COUNT_IF(c_custkey % 9 <> 0) AS BIGINT) AS known, COUNT_IF(c_custkey % 9 <> 0) * 100 >= COUNT(*) * 90 AS passed FROM customer")
def known_vins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "customer").select(F.lower("c_name").alias("vin"), "c_custkey")
    return X.known_share(found, found.where("c_custkey % 9 <> 0"))


@query("SELECT page_id, page_id % 4 <> 3 AS found FROM pages")
def fixture_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://x.example/p?b=2&a="), k.cast("string")).alias("url"), "html")
    fixtures = pages.where("page_id % 4 <> 3").select(F.when(k % 4 == 0, F.col("url")).otherwise(F.concat(F.lit("HTTPS://x.example/p?a="), k.cast("string"), F.lit("&b=2#f"))).alias("url"), "html")
    return X.fixture_lookup(pages.select("page_id", "url"), fixtures).select("page_id", F.col("html").isNotNull().alias("found"))


@query("""
SELECT p_partkey, list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'vin' END, CASE WHEN p_size > 25 THEN 'mileage' END, 'description', CASE WHEN p_partkey % 3 = 0 THEN 'make+model_or_name' END, CASE WHEN p_partkey % 5 = 0 THEN 'color' END], lambda x: x IS NOT NULL) AS gaps FROM part""")
def sample_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    s = F.lpad(k.cast("string"), 10, "AB")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 2 == 0, "URLKEY00000000000").otherwise(F.concat(F.lit("1FT"), s, F.lit("C123"))).alias("vin"), F.lit(2019).alias("year"), F.col("p_retailprice").alias("price"), F.when(F.col("p_size") <= 25, 9.0).alias("mileage"),
        F.lit("km").alias("distance_unit"), F.lit("").alias("description"), F.lit("u").alias("detail_url"), F.when(k % 3 != 0, "m").alias("make"), F.lit("o").alias("model"), F.lit("").alias("name"), F.when(k % 5 != 0, "red").alias("color_ext"), F.lit(None).cast("string").alias("color_int"),
    )
    return rows.select("p_partkey", X.sample_gaps(rows).alias("gaps"))


@query("""
SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND value > 20 AND user_id % 3 = 0 THEN 'ship' WHEN event_type NOT IN ('click', 'view') OR value <= 20 OR user_id % 3 = 1 THEN 'needs_repair' ELSE 'review' END AS verdict,
  event_type = 'click' AND event_id % 100 <= 24 AS reusable FROM events""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    done = F.timestamp_micros(F.unix_micros(now) - (i % 100) * F.lit(3_600_000_000))
    status = F.when(F.col("event_type") == "click", "passed").otherwise("failed")
    return table(spark, sf_dir, "events").select(
        "event_id", X.verdict(F.col("event_type").isin("click", "view"), F.col("value") > 20, F.when(u % 3 == 0, "ship").when(u % 3 == 1, "needs_repair").otherwise("review")).alias("verdict"),
        X.reusable(status, F.lit(0), F.lit(5), done, now).alias("reusable"),
    )


@query("""
SELECT l_orderkey AS page, COUNT(*) AS raw, COUNT(CASE WHEN l_linenumber % 3 <> 0 THEN 1 END) AS accepted, COUNT(DISTINCT CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey % 4 END) AS unique_urls,
  round_even(COUNT(DISTINCT CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey % 4 END) / COUNT(*), 6) AS density FROM lineitem GROUP BY l_orderkey""")
def listing_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_partkey") % 4).alias("detail_url"))
    return X.listing_confidence(cards, ["page"]).withColumn("density", F.bround("density", 6))


@query("""
SELECT p_partkey, 50 + CASE WHEN p_partkey % 2 = 0 THEN 50 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 80 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN 40 ELSE 0 END AS score,
  p_size >= 50 AND p_partkey % 12 < 8 AS starved FROM part""")
def card_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(F.lit("2019 car "), F.when(k % 2 == 0, "$ 4,000").otherwise("call"))
    score = X.card_score(text, F.when(k % 2 == 0, "box vehicle-box").otherwise("box"), F.lit(True), k % 3 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", score.cast("bigint").alias("score"), X.hydration_starved(F.col("p_size"), k % 12).alias("starved"))


@query("""
WITH x AS (SELECT o_custkey % 30 AS origin, (ROW_NUMBER() OVER (PARTITION BY o_custkey % 30 ORDER BY o_orderkey) - 1) AS n FROM orders),
r AS (SELECT origin, n // 10 AS page_no, CASE WHEN origin % 3 = 1 AND n >= 40 THEN n % 10 ELSE n END AS k FROM x),
p AS (SELECT origin, page_no, CASE WHEN origin % 3 = 2 AND page_no >= 1 THEN 35 END AS declared FROM r GROUP BY origin, page_no),
f AS (SELECT origin, page_no, COUNT(*) AS nw FROM (SELECT origin, k, MIN(page_no) AS page_no FROM r GROUP BY origin, k) GROUP BY origin, page_no),
s AS (SELECT p.origin, p.page_no, COALESCE(nw, 0) AS nw, SUM(COALESCE(nw, 0)) OVER w AS urls, MAX(declared) OVER w AS total, COUNT(*) OVER w AS nth FROM p LEFT JOIN f USING (origin, page_no) WINDOW w AS (PARTITION BY p.origin ORDER BY p.page_no)),
t AS (SELECT *, CASE WHEN nth > 8 THEN 'listing_page_cap' WHEN urls >= total OR nw = 0 THEN 'natural_end' END AS reason FROM s),
m AS (SELECT origin, COALESCE(MIN(page_no) FILTER (WHERE reason IS NOT NULL), MAX(page_no)) AS stop_page FROM t GROUP BY origin)
SELECT m.origin, m.stop_page, COALESCE(t.reason, 'natural_end') AS stop_reason, t.nth AS pages_read, CAST(t.urls AS BIGINT) AS unique_urls FROM m JOIN t ON t.origin = m.origin AND t.page_no = m.stop_page""")
def vehicle_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("origin").orderBy("o_orderkey")) - 1
    x = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 30).alias("origin"), "o_orderkey").withColumn("n", n)
    key = F.when((F.col("origin") % 3 == 1) & (F.col("n") >= 40), F.col("n") % 10).otherwise(F.col("n"))
    rows = x.select("origin", F.floor(F.col("n") / 10).alias("page_no"), F.col("n").alias("item_no"), key.cast("string").alias("detail_key"))
    pages = rows.select("origin", "page_no").distinct().withColumn("declared", F.when((F.col("origin") % 3 == 2) & (F.col("page_no") >= 1), 35))
    return X.vehicle_loop(pages, rows, max_pages=8)


@query("SELECT l_orderkey AS owner, COUNT(DISTINCT l_partkey % 3) AS assets, MAX(CAST(l_quantity AS INTEGER)) AS widest FROM lineitem GROUP BY l_orderkey")
def photo_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").cast("int").alias("width"), F.when(F.col("l_linenumber") % 2 == 0, "data_full").otherwise("img_src").alias("source"),
        F.concat(F.lit("https://c.example/"), (F.col("l_partkey") % 3).cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "").otherwise("-640x480"), F.lit(".jpg")).alias("url"),
    )
    return X.photo_set(photos, ["owner"]).select("owner", F.size("photos").cast("bigint").alias("assets"), F.array_max(F.transform("photos", lambda p: p["width"])).alias("widest"))


@query("SELECT c_custkey AS k, c_custkey % 3 = 0 AS had_vin, LEAST(c_custkey % 60, 40) AS photos FROM customer WHERE c_custkey % 3 = 0")
def sync_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), F.when(k % 3 == 0, "V").alias("vin"), F.when(k % 60 > 0, F.transform(F.sequence(F.lit(1), F.greatest(k % 60, F.lit(1))), lambda i: i.cast("string"))).alias("photos"))
    return X.sync_rows(rows).select("k", (F.col("vin") == "V").alias("had_vin"), F.size("photos").cast("bigint").alias("photos"))
