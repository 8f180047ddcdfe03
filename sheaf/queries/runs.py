"""Queries over runs, jobs and links between pages, with orders, customers and events in their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs as R
from .registry import query, table


def _text(c: str) -> Column:
    return F.col(c).cast("string")


@query("SELECT o_orderstatus AS status, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.status_counts(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")))


@query("SELECT o_orderkey, o_custkey AS cached FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 3 <> 0")
def cached_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail pages whose cached record is of the same page and VIN."""
    orders = table(spark, sf_dir, "orders")
    vin = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("URLKEY"), F.lpad(_text("o_orderkey"), 11, "0"))).otherwise(F.concat(F.lit("1FBA"), F.lpad(_text("o_orderkey"), 13, "0")))
    targets = orders.select("o_orderkey", F.concat(F.lit("https://X.example/v//"), _text("o_orderkey")).alias("detail_url"), vin.alias("vin"))
    kept = orders.select(F.concat(F.lit("https://x.example/v/"), _text("o_orderkey"), F.lit("#top")).alias("url"), F.when(F.col("o_orderkey") % 2 == 0, vin).otherwise("other").alias("vin"), F.col("o_custkey").alias("cached"))
    return R.eligible_details(targets, kept).select("o_orderkey", "cached")


@query("""
SELECT o_custkey, COUNT(*) AS records, COUNT_IF(o_orderkey % 3 <> 0) AS fresh, COUNT_IF(o_orderkey % 3 <> 0) > 0 AS ready FROM orders GROUP BY o_custkey""")
def ready_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages with a record of a page not known yet."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("https://x.example/v/"), _text("o_orderkey")).alias("detail_url"))
    return R.ready_listings(orders, orders.where("o_orderkey % 3 = 0").select("detail_url"), "o_custkey")


@query("""
SELECT o_custkey, o_orderkey, f.note FROM orders LEFT JOIN (SELECT c_custkey, 'n' || c_nationkey AS note FROM customer WHERE c_custkey % 2 = 0) f ON f.c_custkey = o_custkey""")
def fixture_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing rows joined with the detail fixtures of their pages."""
    listing = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("https://x.example/c/"), _text("o_custkey"), F.lit("/?utm_source=a")).alias("url"))
    named = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    path = F.concat(F.lit("details/"), _text("c_custkey"), F.lit(".html"))
    manifest = named.select(path.alias("path"), F.concat(F.lit("https://x.example/c/"), _text("c_custkey")).alias("url"))
    details = named.select(path.alias("path"), F.concat(F.lit("n"), _text("c_nationkey")).alias("note"))
    return R.join_fixture_details(listing, manifest, details).drop("url").select("o_custkey", "o_orderkey", "note")


@query("""
WITH l AS (SELECT o_custkey AS page, o_orderkey // 2 AS car, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 300 ELSE 150 END + CASE WHEN o_orderkey % 2 = 1 THEN -8 ELSE 0 END AS pts FROM orders),
b AS (SELECT page, car, MAX(pts) AS pts FROM l GROUP BY page, car),
r AS (SELECT page, pts, ROW_NUMBER() OVER (PARTITION BY page ORDER BY pts DESC) AS rank FROM b)
SELECT page, rank, pts AS points FROM r WHERE rank <= 5""")
def detail_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest links to details of each page, one for each vehicle."""
    o = F.col("o_orderkey")
    target = F.concat(F.lit("https://x.example/vdp/car-"), (F.floor(o / 2) + 1_000_000).cast("string"), F.when(o % 2 == 1, "?utm_source=1").otherwise(""))
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), o.alias("link_no"), target.alias("target"), F.when(o % 4 == 0, 150).otherwise(0).alias("card"))
    points = R.detail_points(F.col("target"), F.col("card"), F.lit("detail_route"), F.lit("car"))
    return R.representative_details(links.withColumn("points", points), "page", 5).select("page", "rank", "points")


@query("""
WITH l AS (SELECT o_custkey AS page, o_orderkey % 5 AS m, MIN(o_orderkey) AS k FROM orders GROUP BY 1, 2),
p AS (SELECT page, CASE m WHEN 0 THEN 120 WHEN 1 THEN 100 WHEN 2 THEN 60 WHEN 3 THEN 40 ELSE 0 END AS points FROM l)
SELECT page, ROW_NUMBER() OVER (PARTITION BY page ORDER BY points DESC) AS rank, points FROM p WHERE points >= 70""")
def inventory_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest links to inventories of each page."""
    m = F.col("o_orderkey") % 5
    path, text = F.element_at(F.array(*map(F.lit, ("/used", "/inventory", "/cars", "/about", "/help"))), (m + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("Used cars", "Our inventory", "Here", "Search", "Help"))), (m + 1).cast("int"))
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.concat(F.lit("https://x.example"), path).alias("target"), text.alias("text")).distinct()
    return R.inventory_links(links, "page").select("page", "rank", "points")


@query("""
WITH p AS (SELECT o_custkey AS crawl, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_no, o_orderkey % 40 AS cards, CASE WHEN o_orderkey % 7 = 0 THEN 60 END AS declared FROM orders),
b AS (SELECT *, COALESCE(MAX(cards) OVER (PARTITION BY crawl ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best FROM p)
SELECT crawl, page_no, best AS best_before, (best >= 12 AND cards * 2 < best) OR (COALESCE(declared, 0) >= 50 AND cards < 12) AS starved FROM b""")
def crawl_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages that show far fewer cards than the best page of their crawl so far."""
    from pyspark.sql import Window

    o = F.col("o_orderkey")
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("crawl"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page_no"), (o % 40).alias("cards"), F.when(o % 7 == 0, 60).alias("declared"))
    return R.heat(pages).select("crawl", "page_no", "best_before", "starved")


@query("""
WITH e AS (SELECT event_id, event_type, ROW_NUMBER() OVER (ORDER BY event_id) AS seq FROM events),
k AS (SELECT * FROM e WHERE event_type <> (SELECT MIN(event_type) FROM events) ORDER BY seq DESC LIMIT 2000)
SELECT seq, 'INFO: ' || event_type || ' ' || event_id AS line FROM (SELECT * FROM k WHERE seq > 100 ORDER BY seq DESC LIMIT 500)""")
def ring_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last lines of an event log after a cursor, noise left out."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    noisy = events.agg(F.min("event_type").alias("noisy"))
    lines = events.join(noisy).select(F.row_number().over(Window.orderBy("event_id")).alias("seq"), F.col("ts").alias("at"), F.when(F.col("event_type") == F.col("noisy"), "uvicorn.access").otherwise("engine").alias("source"), F.lit("INFO").alias("level"), F.concat_ws(" ", "event_type", _text("event_id")).alias("message"))
    return R.ring(lines, after=100).select("seq", "line")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'https://fallback.example/' ELSE 'https://x.example/used/' || p_partkey END AS route, p_partkey % 2 = 0 AND p_partkey % 5 = 0 AS complete FROM part""")
def entry_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    starts = F.array(F.lit("ftp://x.example/a"), F.lit("https://x.example.org/b"), F.when(k % 3 > 0, F.concat(F.lit("https://x.example/used/"), k.cast("string"))).otherwise("/used"))
    return table(spark, sf_dir, "part").select("p_partkey", R.entry_route(starts, F.lit("https://x.example/"), F.lit("https://fallback.example/")).alias("route"), R.complete_replay(k % 2 == 0, F.when(k % 5 == 0, True)).alias("complete"))


@query("""
WITH j AS (SELECT o_custkey AS run, o_orderkey AS seq, CASE WHEN o_custkey % 4 = 0 THEN 'unknown_run' WHEN o_orderkey % 5 = 0 THEN 'bad_token' WHEN o_custkey % 4 = 1 THEN 'still_running' END AS refused, o_orderkey % 2 = 0 AS auto FROM orders),
n AS (SELECT *, ROW_NUMBER() OVER w AS nth, COUNT_IF(auto) OVER w AS asked FROM j WINDOW w AS (PARTITION BY run, refused IS NULL ORDER BY seq))
SELECT run, seq, COALESCE(refused, CASE WHEN nth > 20 THEN 'limit' WHEN NOT auto THEN 'noted' WHEN run % 4 = 2 OR asked > 1 THEN 'already_replaced' ELSE 'replaced' END) AS decision FROM n""")
def failure_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of failure reports: one replacement for each run."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    token = lambda k: F.concat(F.lit("token-"), k.cast("string"))
    runs = table(spark, sf_dir, "customer").where(c % 4 > 0).select(c.alias("run_id"), F.when(c % 4 == 1, "running").otherwise("passed").alias("status"), F.sha2(token(c), 256).alias("token_hash"), (c % 4 == 2).alias("rebuilt"))
    reports = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), o.alias("seq"), F.when(o % 5 == 0, "wrong").otherwise(token(F.col("o_custkey"))).alias("token"), (o % 2 == 0).alias("auto_rebuild"))
    return R.replacements(runs, reports).select(F.col("run_id").alias("run"), "seq", "decision")


@query("SELECT o_orderkey, CASE WHEN c_nationkey % 2 = 0 THEN 'passed' ELSE 'failed' END AS run_status FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 3 > 0")
def run_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey")
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.when(n % 3 == 0, "running").when(n % 2 == 0, "passed").otherwise("failed").alias("status"))
    return R.feedback(runs, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), "o_orderkey")).select("o_orderkey", "run_status")


@query("""
SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 5 = 0 THEN 'repeated_field' END, CASE WHEN v AND p_partkey % 3 = 0 THEN 'not_authorized' END, CASE WHEN v AND p_partkey % 7 = 0 THEN 'no_origin' END,
  CASE WHEN v AND p_partkey % 11 = 0 THEN 'no_reference' END, CASE WHEN v AND p_partkey % 7 <> 0 AND p_partkey % 13 = 0 THEN 'foreign_url' END) AS errors FROM (SELECT *, p_partkey % 2 = 0 AS v FROM part)""")
def option_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    r = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 2 == 0, "automotive.vehicle-v2").otherwise("generic").alias("preset"), F.array(F.lit("a"), F.when(k % 5 == 0, "a").otherwise("b")).alias("fields"),
        F.array(F.when(k % 13 == 0, "https://other.example/x").otherwise("https://www.x.example/x")).alias("urls"), (k % 3 > 0).alias("owner_authorized"), F.when(k % 7 > 0, "https://x.example").alias("authorized_origin"),
        F.when(k % 11 == 0, "short").otherwise("long enough").alias("reference"), F.lit("issuer").alias("attested_by"),
    )
    return r.select("p_partkey", F.array_join(R.option_errors(r), ",").alias("errors"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 2 > 0 AND c_custkey % 3 > 0 AND c_custkey % 5 > 0 AND c_custkey % 7 > 0 AND c_custkey % 11 > 0")
def verified_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promoted runs whose pointer, manifest, spec and files are all as recorded."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    run, manifest = F.concat(F.lit("run"), k.cast("string")), F.concat(F.lit("manifest of "), k.cast("string"))
    pointers = c.select(k.alias("origin"), run.alias("run"), F.sha2(F.when(k % 2 == 0, F.lit("other")).otherwise(manifest), 256).alias("manifest_sha256"))
    manifests = c.select(run.alias("run"), manifest.alias("manifest"), (k % 3 > 0).alias("passed"), (k % 5 > 0).alias("complete"), F.sha2(F.concat(F.lit("spec"), k.cast("string")), 256).alias("spec_sha256"))
    files = c.select(run.alias("run"), F.explode(F.array(*map(F.lit, ("a", "b")))).alias("name"), k).withColumn("content", F.concat("name", k.cast("string"))).withColumn("sha256", F.sha2(F.when((k % 7 == 0) & (F.col("name") == "b"), "changed").otherwise(F.col("content")), 256)).drop("c_custkey")
    specs = c.select(k.alias("origin"), F.sha2(F.concat(F.lit("spec"), F.when(k % 11 == 0, "x").otherwise(k.cast("string"))), 256).alias("spec_sha256"))
    return R.verified_cache(pointers, manifests, files, specs).select(F.col("origin").alias("c_custkey"))
