"""Queries that apply the Column functions to texts made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import photo as P
from ..functions import text as T
from ..functions import url as U
from ..functions import vin as V
from ..operators.queue import retry_delay, strong_etag
from .registry import query, table

_CHARS = "[" + ",".join(f"'{c}'" for c in V.LETTERS) + "]"
_VALUES = "[" + ",".join(V.VALUES) + "]"
_WEIGHTS = "[" + ",".join(map(str, V.WEIGHTS)) + "]"


@query(f"""
SELECT p_partkey, v AS vin, CASE WHEN v IS NOT NULL THEN substr(v, 9, 1) = (CASE WHEN s % 11 = 10 THEN 'X' ELSE CAST(s % 11 AS VARCHAR) END) ELSE FALSE END AS check_ok FROM (
  SELECT p_partkey, v, list_sum(list_transform(range(1, 18), lambda i: {_VALUES}[list_position({_CHARS}, substr(v, i, 1))] * {_WEIGHTS}[i])) AS s FROM (
    SELECT p_partkey, CASE WHEN len(list_distinct(string_split(m, ''))) >= 5 AND regexp_matches(m, '[A-F]') AND regexp_matches(m, '[0-9]') THEN m END AS v
    FROM (SELECT p_partkey, upper(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 17)) AS m FROM part)))""")
def vin_check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("VIN: "), F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 17), F.lit(" (used)"))
    v = V.clean_vin(raw)
    return table(spark, sf_dir, "part").select("p_partkey", v.alias("vin"), V.check_digit_ok(v).alias("check_ok"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS price, CAST(floor(l_extendedprice) AS BIGINT) AS whole, CAST(year(l_shipdate) AS INTEGER) AS model_year,
  CASE WHEN l_returnflag = 'A' THEN 'km' WHEN l_returnflag = 'N' THEN 'mi' END AS unit,
  CASE WHEN l_linestatus = 'O' THEN 'certified' WHEN l_returnflag = 'R' THEN 'new' ELSE 'used' END AS condition FROM lineitem""")
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.concat(F.lit("Our price: $ "), F.format_number("l_extendedprice", 2), F.lit(" plus tax"))
    unit = F.when(F.col("l_returnflag") == "A", "12,000 Kilometres").when(F.col("l_returnflag") == "N", "8000 miles").otherwise("low use")
    state = F.when(F.col("l_linestatus") == "O", "Certified CPO").when(F.col("l_returnflag") == "R", "Brand new").otherwise("Used, like new")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", T.number(price).alias("price"), T.integer(price).alias("whole"), T.year(F.concat(F.lit("Built in "), F.date_format("l_shipdate", "yyyy"), F.lit("!"))).alias("model_year"),
        T.unit(unit).alias("unit"), T.condition(state).alias("condition"),
    )


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(CAST(l_extendedprice AS BIGINT) AS DOUBLE) END AS mileage, CASE WHEN l_linenumber % 3 <> 0 THEN 'km' END AS unit,
  'A' || l_partkey AS stock_number, CASE WHEN l_suppkey % 2 = 0 THEN '2.0L 4cyl' END AS engine FROM lineitem""")
def card_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that a card names once; two different readings give none."""
    reading = lambda n: F.concat(F.format_number(n.cast("bigint"), 0), F.lit(" km"))
    miles = F.col("l_extendedprice").cast("bigint")
    two = F.when(F.col("l_linenumber") % 3 == 0, F.concat(reading(miles), F.lit(" / "), reading(miles + 7))).otherwise(reading(miles))
    card = F.concat(F.lit("STK# a"), F.col("l_partkey").cast("string"), F.lit(" / "), two, F.when(F.col("l_suppkey") % 2 == 0, " / 2.0L  4cyl").otherwise(""))
    m = T.card_mileage(card)
    return table(spark, sf_dir, "lineitem").withColumn("l_extendedprice", F.bround("l_extendedprice", 0)).select("l_orderkey", "l_linenumber", m["mileage"].alias("mileage"), m["unit"].alias("unit"), T.card_stock(card).alias("stock_number"), T.card_engine(card).alias("engine"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN (o_orderstatus = 'F' OR o_orderkey % 7 = 0) AND o_orderpriority = '1-URGENT' THEN 'no_price_published' END AS price_exception FROM orders""")
def price_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero is no price, a model year is none, and only a card that says so withholds one."""
    year = F.year("o_orderdate")
    read = F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderkey") % 7 == 0, year.cast("double")).otherwise(F.col("o_totalprice"))
    price = T.usable_price(read, year)
    card = F.when(F.col("o_orderpriority") == "1-URGENT", "Call for  pricing").otherwise("Great value")
    return table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"), F.when(price.isNull() & T.price_withheld(card), "no_price_published").alias("price_exception"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey WHEN 2 THEN c_custkey + 24 END AS total FROM customer")
def declared_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    line = (
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("Page 1 of 9 ("), k, F.lit(" vehicles)")))
        .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("Showing 1 - 24 of "), k))
        .when(F.col("c_custkey") % 4 == 2, F.concat((F.col("c_custkey") + 24).cast("string"), F.lit(" / 24")))
        .otherwise("Page 2 of 12")
    )
    return table(spark, sf_dir, "customer").select("c_custkey", T.declared_total(line).alias("total"))


@query("""
SELECT p_partkey, 'https://cdn.example.com/' || p_partkey || '-400.jpg' AS first_url, 'https://cdn.example.com/' || p_partkey || '-1600.jpg' AS largest_url,
  'cdn.example.com/photos/' || p_partkey || '/front.jpg' AS asset, p_size % 2 = 1 AS accepted, 'https://images.edealer.ca/0/' || p_partkey || '.jpg' AS full_url, CAST(1600 AS INTEGER) AS full_width FROM part""")
def photo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    at = lambda w: F.concat(F.lit("https://cdn.example.com/"), k, F.lit(f"-{w}.jpg"))
    srcset = F.concat(at(400), F.lit(" 400w, "), at(1600), F.lit(" 1600w, "), at(800), F.lit(" 800w"))
    asset = F.concat(F.lit("https://cdn.example.com/Photos/"), k, F.lit("/front-640x480.jpg?w=640&q=80"))
    image = F.concat(F.lit("https://cdn.example.com/"), F.when(F.col("p_size") % 2 == 1, "car").otherwise("placeholder"), F.lit("/"), k, F.lit(".jpg"))
    full = P.full_size(F.concat(F.lit("https://images.edealer.ca/21/"), k, F.lit(".jpg")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", P.srcset_first(srcset).alias("first_url"), P.srcset_largest(srcset).alias("largest_url"), P.asset_key(asset).alias("asset"), P.accepted_image(image).alias("accepted"),
        full["url"].alias("full_url"), full["width"].alias("full_width"),
    )


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'detail_route' WHEN 1 THEN 'vehicle_slug' WHEN 2 THEN 'vehicle_slug_id' WHEN 3 THEN 'vehicle_stock_path' END AS authority FROM part""")
def detail_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("p_partkey").cast("string"), F.col("p_partkey") % 6
    url = F.concat(
        F.lit("https://www.cars.example.com"),
        F.when(m == 0, F.concat(F.lit("/vdp/"), k))
        .when(m == 1, F.concat(F.lit("/auto/used-2019-red-widget-"), k, F.lit(".html")))
        .when(m == 2, F.concat(F.lit("/auto/used-2012-nissan-altima/"), F.lpad(k, 8, "1")))
        .when(m == 3, F.concat(F.lit("/inventory/make/model/a"), F.lpad(k, 4, "0")))
        .when(m == 4, F.concat(F.lit("/inventory/?make=x&id="), k))
        .otherwise(F.concat(F.lit("/contact-us/"), k)),
    )
    stock = F.array(F.concat(F.lit("a"), F.lpad(k, 4, "0")))
    return table(spark, sf_dir, "part").select("p_partkey", U.detail_authority(url, F.lit(True), stock, V.vin_from_url(url)).alias("authority"))


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'key [redacted] x' ELSE 'key ' || user_id || ' x' END AS shown, event_type = 'error' AS secret,
  lower(event_type) || '-' || user_id AS slug, 'user_' || user_id AS field_name FROM events""")
def safe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id").cast("string")
    text = F.when(F.col("event_type") == "error", "key password= x").otherwise(F.concat(F.lit("key "), u, F.lit(" x")))
    return table(spark, sf_dir, "events").select("event_id", T.redact(text).alias("shown"), T.secret_shaped(text).alias("secret"), T.slug(F.concat("event_type", F.lit(" / "), u, F.lit(" !"))).alias("slug"), T.field_name(F.concat(F.lit(" User "), u)).alias("field_name"))


@query("""
SELECT event_id, LEAST(60.0, 2.0 * pow(2, event_id % 6)) AS backoff, event_id % 2 = 0 AS strong, event_type <> 'error' AS plain FROM events""")
def transport_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    tag = F.concat(F.when(i % 2 == 0, '"').otherwise('W/"'), i.cast("string"), F.lit('"'))
    brace = F.when(F.col("event_type") == "error", "/v/%257B%257Burl%257D%257D").otherwise("/v/plain")
    return table(spark, sf_dir, "events").select("event_id", retry_delay((i % 6 + 1).cast("double"), 2.0, 60.0).alias("backoff"), strong_etag(tag).alias("strong"), (~U.template_marker(brace)).alias("plain"))


@query("""
SELECT c_custkey, list_sort([lower(c_mktsegment), 'segments', 'segment', 'of', CAST(c_custkey AS VARCHAR)]) AS words, len([lower(c_mktsegment), 'x']) AS kept FROM customer""")
def word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("c_mktsegment")
    words = T.tokens(F.concat(F.lit("Segments of "), s, F.lit(" #"), F.col("c_custkey").cast("string")))
    folded = T.unique_folded(F.array(s, F.lower(s), F.lit("x"), F.lit(" X "), F.lit("")), 160)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_sort(words).alias("words"), F.size(folded).cast("bigint").alias("kept"))
