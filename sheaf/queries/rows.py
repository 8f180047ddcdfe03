"""Queries over ordered crawl rows: identity, dedupe, page loops, pagers, joins and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import crawl as C
from ..sinks import writers as K
from .registry import query, table


@query("SELECT COUNT(*) AS n_rows, COUNT(DISTINCT text) AS identities, COUNT(*) - COUNT(DISTINCT text) AS copies FROM documents")
def row_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("article_text"), F.col("doc_id").alias("_doc_id"))
    groups = docs.select(C.row_fingerprint(docs).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("identities"), F.sum(F.col("n") - 1).alias("copies"))


@query("SELECT MIN(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return C.keep_first(docs, ["text_md5"], ["doc_id"])


_LOOP = """
WITH r AS (SELECT o_custkey % 40 AS source_id, (ROW_NUMBER() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) - 1) AS n, o_orderkey, o_custkey % 7 AS m, o_orderkey % 23 AS v FROM orders),
x AS (SELECT source_id, n // 6 AS page_no, CAST(n % 6 AS BIGINT) AS item_no, CASE WHEN source_id % 5 = 0 AND n // 6 >= 4 THEN 'again' || (n % 6) WHEN source_id % 5 = 1 AND n // 6 = 3 THEN 'first' || (n % 6 + 6) WHEN source_id % 5 = 1 THEN 'first' || n ELSE 'k' || o_orderkey END AS fp FROM r),
p AS (SELECT source_id, page_no, 1000 + page_no AS bytes, source_id % 5 = 2 AND page_no >= 3 AS url_again, page_no < MAX(page_no) OVER (PARTITION BY source_id) AS has_next FROM x GROUP BY source_id, page_no),
f AS (SELECT source_id, fp, MIN(page_no) AS page_no FROM x GROUP BY source_id, fp),
nw AS (SELECT source_id, page_no, COUNT(*) AS new_rows FROM f GROUP BY source_id, page_no),
c AS (SELECT source_id, page_no, string_agg(fp, ',' ORDER BY fp) AS page_fp FROM x GROUP BY source_id, page_no),
s AS (SELECT p.source_id, p.page_no, p.has_next, p.url_again,
  ROW_NUMBER() OVER (PARTITION BY p.source_id, c.page_fp ORDER BY p.page_no) > 1 AS content_again, COALESCE(nw.new_rows, 0) AS new_rows,
  SUM(COALESCE(nw.new_rows, 0)) OVER (PARTITION BY p.source_id ORDER BY p.page_no) AS total, ROW_NUMBER() OVER (PARTITION BY p.source_id ORDER BY p.page_no) AS nth
  FROM p JOIN c USING (source_id, page_no) LEFT JOIN nw USING (source_id, page_no)),
w AS (SELECT *, CASE WHEN url_again AND page_no > 3 THEN 'repeated_page_url' WHEN content_again THEN 'duplicate_page' WHEN total >= 60 AND has_next THEN 'max_items' WHEN total >= 60 THEN 'no_next_link'
  WHEN new_rows = 0 THEN 'no_new_rows' WHEN NOT has_next THEN 'no_next_link' WHEN nth >= 9 THEN 'max_pages' END AS reason FROM s),
t AS (SELECT source_id, MIN(page_no) AS stop_page FROM w WHERE reason IS NOT NULL GROUP BY source_id)
"""


def _loop(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("o_orderkey")) - 1
    r = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("source_id"), "o_orderkey").withColumn("n", nth)
    page, item, s = F.floor(F.col("n") / 6), (F.col("n") % 6).cast("bigint"), F.col("source_id") % 5
    fp = (
        F.when((s == 0) & (page >= 4), F.concat(F.lit("again"), item.cast("string")))
        .when((s == 1) & (page == 3), F.concat(F.lit("first"), (item + 6).cast("string")))
        .when(s == 1, F.concat(F.lit("first"), F.col("n").cast("string")))
        .otherwise(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")))
    )
    rows = r.select("source_id", page.alias("page_no"), item.alias("item_no"), fp.alias("fp"))
    pages = rows.groupBy("source_id", "page_no").agg(F.lit(1000).alias("bytes")).withColumn("last", F.max("page_no").over(Window.partitionBy("source_id")))
    number = F.when((F.col("source_id") % 5 == 2) & (F.col("page_no") >= 3), 3).otherwise(F.col("page_no"))
    url = F.concat(F.lit("https://shop.example.com/list?utm_x="), F.col("page_no").cast("string"), F.lit("&page="), number.cast("string"))
    return rows, pages.select("source_id", "page_no", "bytes", url.alias("url"), (F.col("page_no") < F.col("last")).alias("has_next"))


@query(_LOOP + "SELECT w.source_id, w.page_no AS stop_page, w.reason AS stop_reason, w.nth AS pages_read, CAST(LEAST(w.total, 60) AS BIGINT) AS new_rows FROM w JOIN t ON w.source_id = t.source_id AND w.page_no = t.stop_page")
def page_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where crawls stop: some repeat a URL, some a page, some grow too long, some just end."""
    rows, pages = _loop(spark, sf_dir)
    return C.page_loop(rows, pages, max_items=60, max_pages=9).select("source_id", "stop_page", "stop_reason", F.col("pages_read").cast("bigint").alias("pages_read"), F.col("new_rows").cast("bigint").alias("new_rows"))


@query(_LOOP + """, k AS (SELECT x.source_id, x.fp, x.page_no, x.item_no, ROW_NUMBER() OVER (PARTITION BY x.source_id, x.fp ORDER BY x.page_no, x.item_no) AS nth FROM x JOIN t USING (source_id) JOIN w ON w.source_id = x.source_id AND w.page_no = t.stop_page
  WHERE x.page_no < t.stop_page OR (x.page_no = t.stop_page AND w.reason NOT IN ('repeated_page_url', 'duplicate_page')))
SELECT source_id, page_no, item_no, fp FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY page_no, item_no) AS i FROM k WHERE nth = 1) WHERE i <= 60""")
def crawl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, pages = _loop(spark, sf_dir)
    return C.crawl_rows(rows, C.page_loop(rows, pages, max_items=60, max_pages=9), 60).select("source_id", "page_no", "item_no", "fp")


def _pager(spark: SparkSession, sf_dir: str, path: str, step: int) -> DataFrame:
    """A page for each customer, which links to the first, the previous, the next and a far page."""
    k = F.col("c_custkey")
    at = lambda n: F.concat(F.lit(f"https://cars.example.com/{path}"), n.cast("string"))
    links = F.array(*(F.struct(F.lit(i).alias("link_no"), at(n * step).alias("target"), F.lit(label).alias("text")) for i, (n, label) in enumerate(((F.lit(1), "1"), (k, "Prev"), (k + 2, "Next"), (k + 9, "Last")))))
    pages = table(spark, sf_dir, "customer").select(k.alias("page_id"), at((k + 1) * step).alias("url"), F.explode(links).alias("l")).select("page_id", "url", "l.*")
    return pages.select("*", F.lit("a").alias("tag"), F.col("target").alias("href"), F.lit("").alias("rel"), F.lit("pagination").alias("semantics"), F.lit("a").alias("selector"), F.when(F.col("page_id") % 10 == 3, 1).otherwise(0).alias("disabled"))


@query("SELECT c_custkey AS page_id, 'https://cars.example.com/used/?page=' || (c_custkey + 2) AS next_url, 255 AS score FROM customer WHERE c_custkey % 10 <> 3")
def next_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.next_pages(_pager(spark, sf_dir, "used/?page=", 1), by=["page_id"]).select("page_id", "next_url", "score")


@query("SELECT c_custkey AS page_id, 'https://cars.example.com/used/pg/' || (c_custkey + 2) AS next_url, c_custkey + 2 AS page_number FROM customer")
def next_in_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.next_in_series(_pager(spark, sf_dir, "used/pg/", 1), by=["page_id"])


@query('SELECT c_custkey AS page_id, \'https://cars.example.com/used/?start=\' || ((c_custkey + 2) * 24) AS next_url, (c_custkey + 2) * 24 AS "offset" FROM customer WHERE c_custkey > 0')
def next_by_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest published gap must lead to a published link; a gap is never filled in."""
    links = _pager(spark, sf_dir, "used/?start=", 24).where("page_id > 0")
    own = links.where("link_no = 1").select("page_id", "url", F.lit(9).alias("link_no"), F.col("url").alias("target"), "text", "tag", "href", "rel", "semantics", "selector", "disabled")
    return C.next_by_offset(links.unionByName(own), by=["page_id"])


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'listing' END AS status, o_orderpriority AS priority, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS segment
FROM orders JOIN customer ON o_custkey = c_custkey""")
def detail_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing rows filled from detail pages whose URLs are spelled otherwise."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    listing = orders.select("o_orderkey", F.concat(F.lit("https://Shop.example.com/o/"), k.cast("string")).alias("url"), F.when(k % 3 == 0, "").otherwise("listing").alias("status"), F.lit(None).cast("string").alias("priority"), F.lit(None).cast("string").alias("segment"))
    details = orders.select(F.concat(F.lit("https://shop.example.com/o/"), k.cast("string"), F.lit("/?utm_source=x#top")).alias("url"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("segment"), F.lit(0).alias("page_no"), F.lit(0).alias("item_no"))
    return C.join_details(listing, details.unionByName(details.withColumn("page_no", F.lit(1)).withColumn("status", F.lit("later"))), ["status", "priority", "segment"]).drop("url")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'V' || p_partkey ELSE 'URLKEY' || p_partkey END AS vin, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE 10.0 END AS price,
  CASE WHEN p_partkey % 5 = 0 THEN 'no_price_published' END AS price_exception, CASE WHEN p_partkey % 7 = 0 THEN ['list'] ELSE ['a', 'b'] END AS photos FROM part""")
def vehicle_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail rows fill listing rows; a withheld price stays withheld and weak VINs promote nothing."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    name = lambda p: F.concat(F.lit(p), k.cast("string"))
    listing = part.select(
        "p_partkey", k.alias("detail_key"), F.when(k % 3 == 0, name("V")).otherwise(name("URLKEY")).alias("vin"),
        F.when(k % 5 == 0, None).when(k % 2 == 0, 0.0).otherwise(10.0).alias("price"), F.when(k % 5 == 0, "no_price_published").alias("price_exception"), F.array(F.lit("list")).alias("photos"),
    )
    details = part.select(k.alias("detail_key"), name("W").alias("vin"), F.col("p_retailprice").alias("price"), F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("photos"))
    return C.fill_vehicle(listing, details).drop("detail_key")


@query("SELECT c_custkey % 10 AS origin, COUNT(*)::BIGINT AS records, COUNT_IF(c_custkey % 3 = 0)::BIGINT AS promoted FROM customer GROUP BY c_custkey % 10")
def dedupe_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record comes twice, the second time with its real VIN for some; the fold merges the two."""
    k = F.col("c_custkey")
    once = table(spark, sf_dir, "customer").select((k % 10).alias("origin"), F.lit(0).alias("page_no"), k.alias("item_no"), F.concat(F.lit("x/"), k.cast("string")).alias("detail_key"), F.concat(F.lit("URLKEY"), F.lpad(k.cast("string"), 11, "0")).alias("vin"), F.lit(None).cast("string").alias("make"))
    again = once.withColumn("page_no", F.lit(1)).withColumn("vin", F.when(F.col("item_no") % 3 == 0, F.concat(F.lit("1FT"), F.lpad(F.col("item_no").cast("string"), 14, "0"))).otherwise(F.col("vin"))).withColumn("make", F.lit("m"))
    return C.dedupe_records(once.unionByName(again)).groupBy("origin").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("vin").startswith("1FT") & (F.col("make") == "m")).alias("promoted"))


@query("""
SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 3 THEN 'listing.jpg' WHEN c_custkey % 4 > 0 THEN 'p1' END AS photo, CASE WHEN c_custkey % 4 = 3 THEN 1 ELSE c_custkey % 4 END AS photos,
  CASE WHEN c_custkey % 4 = 1 THEN 'single_photo_published' WHEN c_custkey % 4 = 0 AND c_custkey % 3 = 0 THEN 'no_photos_published' END AS photo_exception FROM customer""")
def gallery_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos of proven detail pages replace or clear those of listings."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    rows = c.select(k.alias("k"), k.cast("string").alias("detail_key"), F.lit("listing.jpg").alias("photo"), F.array(F.lit("listing.jpg")).alias("photos"))
    galleries = c.where(k % 4 < 3).select(k.cast("string").alias("detail_key"), F.slice(F.array(F.lit("p1"), F.lit("p2")), 1, (k % 4).cast("int")).alias("photos"), (k % 4).alias("census"), (k % 3 == 0).alias("placeholder"))
    return C.gallery_authority(rows, galleries).select("k", "photo", F.size("photos").alias("photos"), "photo_exception")


@query("""
SELECT o_custkey % 20 AS origin, 'detail_key' AS kind, 'u' || o_custkey AS key, COUNT(DISTINCT o_orderkey % 3) AS n FROM orders GROUP BY o_custkey HAVING COUNT(DISTINCT o_orderkey % 3) > 1
UNION ALL SELECT o_custkey % 20, 'vin', 'VIN' || (o_orderkey % 3) || 'x' || (o_custkey % 20), COUNT(DISTINCT o_custkey) FROM orders GROUP BY o_custkey % 20, o_orderkey % 3 HAVING COUNT(DISTINCT o_custkey) > 1""")
def record_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail keys of several VINs and VINs of several detail keys."""
    k = F.col("o_custkey")
    vin = F.concat(F.lit("VIN"), (F.col("o_orderkey") % 3).cast("string"), F.lit("x"), (k % 20).cast("string"))
    rows = table(spark, sf_dir, "orders").select((k % 20).alias("origin"), F.concat(F.lit("u"), k.cast("string")).alias("detail_key"), vin.alias("vin"))
    return C.conflicts(rows).select("origin", "kind", "key", F.size("values").cast("bigint").alias("n"))


@query("""
SELECT event_id, CASE WHEN event_type IN ('error', 'click') THEN '''' || (CASE event_type WHEN 'error' THEN '=' ELSE '@' END) || event_type ELSE event_type END AS label,
  '{"kind":"' || event_type || '","extra":null}' AS nested FROM events""")
def safe_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    label = F.concat(F.when(t == "error", "=").when(t == "click", "@").otherwise(""), t)
    rows = table(spark, sf_dir, "events").select("event_id", label.alias("label"), F.struct(t.alias("kind"), F.lit(None).cast("string").alias("extra")).alias("nested"))
    return K.flat(rows, spreadsheet=True)


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer")
def column_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    return K.union_columns([a, b])


@query("SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn LIMIT 50 OFFSET 20")
def rows_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rows_page(table(spark, sf_dir, "conversations"), 20, 50, ["conv_id", "turn"])


@query("SELECT arg_min(role, (conv_id, turn)) AS role, ['role'] AS found, ['nothing'] AS missing FROM conversations")
def latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest(table(spark, sf_dir, "conversations"), ["role", "nothing"], ["conv_id", "turn"])
