"""Queries over page markup: links, URLs, extraction and round trips from tables to pages and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions import vin as V
from ..operators import html as H
from ..operators.similarity import features
from ..plans.infer import KEYWORDS, rank_containers
from ..plans.spec import Field, Spec
from .registry import query, table

_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(f"""
SELECT host, COUNT(DISTINCT page_id) AS pages, COUNT(*) AS links, COUNT(DISTINCT target) AS targets FROM (
  SELECT page_id, {_HOST} AS host, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS target
  FROM (SELECT page_id, url, UNNEST(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages))
GROUP BY host""")
def links_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.links(table(spark, sf_dir, "pages"), keep=["page_id"]).where("tag = 'a'")
    return found.groupBy(U.host(F.col("url")).alias("host")).agg(F.count_distinct("page_id").alias("pages"), F.count(F.lit(1)).alias("links"), F.count_distinct("target").alias("targets"))


_CLEAN = "regexp_replace(regexp_replace(split_part(url, '#', 1), '([?&])utm_source=[^&]*', '\\1'), '[?&]$', '')"


@query(f"""
SELECT page_id, c AS canonical_url, rtrim(c, '/') AS detail_key, regexp_extract(c, '^([a-z]+://[^/?#]*)', 1) AS origin,
  CASE WHEN c LIKE '%?page=%' THEN CAST(regexp_extract(c, '[?]page=([0-9]+)', 1) AS BIGINT) END AS page_number
FROM (SELECT page_id, {_CLEAN} AS c FROM pages)""")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.canonical_url(u).alias("canonical_url"), U.detail_key(u).alias("detail_key"), U.origin(u).alias("origin"), U.page_number(u).alias("page_number"))


_IDENTITY = """
SELECT page_id, regexp_replace(regexp_replace(host, '^www\\.', '') || rtrim(path, '/') , '^$', '') AS identity FROM (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
"""


@query(f"SELECT page_id, identity, identity AS card_scope FROM ({_IDENTITY})")
def detail_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.normalize_detail_url(u).alias("identity"), U.card_scope_key(u).alias("card_scope"))


def _letters(h: str, n: int) -> str:
    return " || ".join(f"substr('{V.ALPHABET}', CAST(({h} >> {5 * k}) & 31 AS INTEGER) + 1, 1)" for k in range(n))


@query(f"""
WITH i AS ({_IDENTITY}),
u AS (SELECT page_id, [CAST(ascii(c) AS UBIGINT) FOR c IN string_split(identity, '')] AS u FROM i),
h AS (SELECT page_id,
  list_reduce(list_concat([CAST(2166136261 AS UBIGINT)], u), lambda a, x: (xor(a, x) * 16777619) % 4294967296) AS a,
  list_reduce(list_concat([CAST(16777619 AS UBIGINT)], list_transform(u, lambda x, k: CAST(x + k AS UBIGINT))), lambda a, x: CAST((CAST(xor(a, x) AS HUGEINT) * 2246822507) % 4294967296 AS UBIGINT)) AS b FROM u)
SELECT page_id, '{V.SURROGATE}' || {_letters("a", 6)} || {_letters("b", 5)} AS surrogate FROM h""")
def surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", V.surrogate_vin(F.col("url")).alias("surrogate"))


@query("""
SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS h1_raw, len(regexp_extract_all(html, '<p>')) AS paragraphs,
  len(regexp_extract_all(html, '<li>')) AS nav_items FROM pages""")
def page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = Spec(fields=(Field("p", "article p", multiple=True), Field("li", "nav > ul > li", multiple=True)))
    pages = table(spark, sf_dir, "pages")
    rows = H.per_page(
        pages, "html", ["page_id"], H.StructType([H.StructField("paragraphs", H.LongType()), H.StructField("nav_items", H.LongType())]),
        lambda root, _: [{"paragraphs": len(root.select(spec.fields[0].selector)), "nav_items": len(root.select(spec.fields[1].selector))}],
    )
    return rows.join(pages.select("page_id", F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("h1_raw")), "page_id").select("page_id", "h1_raw", "paragraphs", "nav_items")


_BARE = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"


@query(f"SELECT page_id, LENGTH({_BARE}) AS text_chars, md5({_BARE}) AS text_md5, LENGTH({_BARE}) < 300 AS shell FROM pages")
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = H.visible_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("bigint").alias("text_chars"), F.md5(t).alias("text_md5"), H.shell_page(F.col("html")).alias("shell"))


_VOTES = " UNION ALL ".join(f"SELECT page_id, '{c}' AS category, {' + '.join(f'CAST(contains(lower(html), $${w}$$) AS BIGINT)' for w in words)} AS votes FROM pages" for c, words in KEYWORDS.items())


@query(f"SELECT category, SUM(votes)::BIGINT AS votes, COUNT_IF(votes > 0)::BIGINT AS pages FROM ({_VOTES}) GROUP BY category")
def category_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("html")
    counts = [F.struct(F.lit(c).alias("category"), sum((low.contains(w).cast("bigint") for w in words), F.lit(0)).cast("bigint").alias("votes")) for c, words in KEYWORDS.items()]
    long = table(spark, sf_dir, "pages").select(F.explode(F.array(*counts)).alias("v")).select("v.*")
    return long.groupBy("category").agg(F.sum("votes").alias("votes"), F.count_if(F.col("votes") > 0).alias("pages"))


# ---------------------------------------------------------------- round trips


def _cards(part: DataFrame) -> DataFrame:
    """Listing pages of 24 product cards each."""
    card = F.concat(
        F.lit('<article class="product-card"><a href="/p/'), F.col("p_partkey").cast("string"), F.lit('"><h2>'), F.col("p_name"), F.lit("</h2></a><img src='/img/"),
        F.col("p_partkey").cast("string"), F.lit(".jpg'><span class=sku>"), F.col("p_brand"), F.lit("</span>\n<span class='price'>$"), F.format_string("%.2f", F.col("p_retailprice")),
        F.lit("</span><p class=stock>"), F.col("p_type"), F.lit("</article>"),
    )
    page = F.floor(F.col("p_partkey") / 24)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", card.alias("c")))), lambda x: x["c"]), "\n")
    return part.groupBy(page.alias("page_no")).agg(F.concat(F.lit("<html><body><main class=products>"), body, F.lit("</main></body></html>")).alias("html")).withColumn("url", F.concat(F.lit("https://shop.example.com/list?page="), F.col("page_no").cast("string")))


CARD = Spec(
    container="article.product-card",
    fields=(Field("title", "h2"), Field("url", "a[href]", "url", "href"), Field("image", "img", "image", "src"), Field("sku", ".sku"), Field("price", ".price", "money"), Field("availability", "p.stock")),
    max_items=250,
)


@query("""
SELECT p_partkey // 24 AS page_no, CAST(p_partkey % 24 AS INTEGER) AS item_no, p_name AS title, 'https://shop.example.com/p/' || p_partkey AS url,
  'https://shop.example.com/img/' || p_partkey || '.jpg' AS image, p_brand AS sku, '$' || printf('%.2f', p_retailprice) AS price, p_type AS availability FROM part""")
def cards_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.extract(_cards(table(spark, sf_dir, "part")), CARD, keep=["page_no"])
    return rows.drop("page_url")


LD = Spec(strategy="jsonld", jsonld_types=("product",), container="script", fields=(Field("title", "name"), Field("brand", "brand"), Field("sku", "sku"), Field("price", "offers.price", "money"), Field("size", "size")), max_items=250)


@query("SELECT p_partkey // 24 AS page_no, p_name AS title, p_brand AS brand, CAST(p_partkey AS VARCHAR) AS sku, printf('%.2f', p_retailprice) AS price, CAST(p_size AS VARCHAR) AS size FROM part")
def jsonld_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    node = F.struct(
        F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("name")).alias("brand"), F.col("p_partkey").cast("string").alias("sku"),
        F.array(F.struct(F.format_string("%.2f", F.col("p_retailprice")).alias("price"))).alias("offers"), F.col("p_size").alias("size"),
    )
    made = part.withColumn("node", node).groupBy(F.floor(F.col("p_partkey") / 24).alias("page_no")).agg(F.to_json(F.struct(F.array_sort(F.collect_list("node"), lambda a, b: F.when(a["sku"].cast("int") < b["sku"].cast("int"), -1).when(a["sku"].cast("int") > b["sku"].cast("int"), 1).otherwise(0)).alias("@graph"))).alias("ld"))
    pages = made.select("page_no", F.lit("https://shop.example.com/").alias("url"), F.concat(F.lit('<html><head><script type="application/ld+json">'), F.col("ld"), F.lit("</script><script type='application/ld+json'>{broken</script></head></html>")).alias("html"))
    return H.extract(pages, LD, keep=["page_no"]).select("page_no", *(f.name for f in LD.fields))


@query("SELECT p_type, COUNT(*) AS nodes, SUM(p_size)::BIGINT AS sizes FROM part GROUP BY p_type")
def jsonld_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    ld = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("p_type").alias("category"), F.col("p_size").alias("size")))
    pages = part.select("p_partkey", F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>")).alias("html"))
    node = F.explode(H.jsonld_scripts(F.col("html")))
    found = pages.select(node.alias("n")).select(F.try_parse_json("n").alias("v"))
    typed = found.select(F.try_variant_get("v", "$.category", "string").alias("p_type"), F.try_variant_get("v", "$.size", "int").alias("size"))
    return typed.groupBy("p_type").agg(F.count(F.lit(1)).alias("nodes"), F.sum("size").alias("sizes"))


@query("""
SELECT CAST(l_orderkey AS BIGINT) AS page, COUNT(*) AS members, ROUND_EVEN(LEAST(COUNT(*), 30) * 1.5 + 2 * COUNT_IF(l_tax > 0) + 2 * COUNT_IF(l_discount > 0) + LEAST(AVG(l_extendedprice) / 8000, 10), 2) AS score
FROM lineitem GROUP BY l_orderkey HAVING COUNT(*) >= 2 AND AVG(l_extendedprice) / 100 BETWEEN 12 AND 8000""")
def container_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking of container candidates over many pages: orders stand for pages, their lines for members."""
    stats = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(
        F.count(F.lit(1)).alias("members"), (F.avg("l_extendedprice") / 100).alias("average"), F.count_if(F.col("l_tax") > 0).alias("rich"), F.count_if(F.col("l_discount") > 0).alias("prices"),
    ).where("members >= 2").withColumn("in_nav", F.lit(False)).withColumn("signature", F.lit("li"))
    return rank_containers(stats, ["page"]).where("rank = 1").join(stats.select("page", "members"), "page").select("page", "members", F.bround("score", 2).alias("score"))


@query("SELECT page_id, 'class_families' AS feature, 'family:article-' AS value FROM pages WHERE length(html) - length(replace(html, '<p>', '<')) >= 16")
def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint features of pages whose paragraphs are given a class."""
    marked = table(spark, sf_dir, "pages").select("page_id", F.replace(F.col("html"), F.lit("<p>"), F.lit('<p class="article-text">')).alias("html"))
    return features(marked, "page_id").where("feature = 'class_families'")
