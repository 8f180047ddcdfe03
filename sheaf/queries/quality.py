"""Queries of quality reports, similarity and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import similarity as S
from ..plans.spec import Field, Spec
from .registry import query, table

LINES = Spec(fields=(Field("title", "t", required=True), Field("flag", "f"), Field("status", "s"), Field("url", "u", "url")), min_rows=2, requested=("flag",))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("Part "), (F.col("l_partkey") % 50).cast("string"))).alias("title"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), F.col("l_linestatus").alias("status"), F.lit(None).cast("string").alias("url"),
    )


_L = "SELECT CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE 'Part ' || (l_partkey % 50) END AS title, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag, l_linestatus AS status FROM lineitem"


@query(f"""
WITH l AS ({_L}), a AS (SELECT COUNT(*) AS n, COUNT_IF(title = '') AS bt, COUNT_IF(flag IS NULL) AS bf FROM l),
c AS (SELECT SUM(k - 1) AS copies FROM (SELECT COUNT(*) AS k FROM l GROUP BY title, flag, status))
SELECT 1 AS attempt, FALSE AS passed, n AS row_count, 4 AS field_count, round_even((bt + bf + n) / (n * 4), 4) AS null_rate, round_even(copies / n, 4) AS duplicate_rate,
  'Most records are duplicates (' || CAST(round_even(copies / n * 100, 0) AS INTEGER) || '%); Required field ''title'' is missing in ' || CAST(round_even(bt / n * 100, 0) AS INTEGER) || '% of records' AS issues FROM a, c""")
def qa_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.verify(_lines(spark, sf_dir), LINES).withColumn("issues", F.array_join("issues", "; "))


@query(f"""
WITH l AS ({_L}), a AS (SELECT COUNT(*) AS n, COUNT_IF(title <> '') AS t, COUNT(flag) AS f, COUNT(status) AS s FROM l)
SELECT 'title' AS field, t AS present, round_even(t / n, 4) AS coverage FROM a UNION ALL SELECT 'flag', f, round_even(f / n, 4) FROM a UNION ALL SELECT 'status', s, round_even(s / n, 4) FROM a UNION ALL SELECT 'url', 0, 0.0 FROM a""")
def qa_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.coverage(_lines(spark, sf_dir), ["title", "flag", "status", "url"])


def _vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-schema vehicles made of parts: a third lack a color, a tenth a price, some share photos."""
    k = F.col("p_partkey")
    s = k.cast("string")
    photos = F.when(k % 20 == 1, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("p/"), s), F.concat(F.lit("q/"), F.floor(k / 2).cast("string")), F.concat(F.lit("r/"), s)))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("1FTFW1ET"), F.lpad(s, 9, "0")).alias("vin"), F.concat(F.lit("https://x/v/"), s).alias("detail_url"), F.lit(2019).alias("year"), F.col("p_brand").alias("make"), F.col("p_type").alias("model"),
        F.when(k % 10 == 0, None).otherwise(F.col("p_retailprice") * 20).alias("price"), F.lit(1000.0).alias("mileage"), F.when(k % 3 != 0, "red").alias("color_ext"), F.lit("d").alias("description"), F.when(k % 20 != 1, "p").alias("photo"),
        photos.alias("photos"), F.lit(None).cast("string").alias("color_int"), F.when(k % 2 == 0, "auto").alias("transmission"), F.lit("awd").alias("drivetrain"), F.array(F.lit("abs")).alias("features"),
        F.when(k % 20 == 1, "no_photos_published").alias("photo_exception"), F.when(k % 20 == 0, "no_price_published").alias("price_exception"),
        F.array(F.struct(F.lit("u").alias("url"), F.lit("data_full").alias("source"), F.lit(1200).alias("width"), F.lit(True).alias("full"))).alias("evidence"),
    )


_VEHICLES = """
WITH v AS (SELECT p_partkey AS k, p_partkey % 20 = 1 AS bare, p_partkey % 20 = 0 AS withheld, p_partkey % 10 = 0 AS unpriced, p_partkey % 3 <> 0 AS coloured FROM part),
a AS (SELECT COUNT(*) AS n, COUNT_IF(NOT bare AND NOT withheld AND NOT unpriced AND coloured) AS pub, COUNT_IF(NOT bare AND NOT withheld AND NOT (NOT unpriced AND coloured)) AS blk,
  round_even(COUNT_IF(coloured) / COUNT(*), 4) AS color, round_even(COUNT_IF(NOT withheld AND NOT unpriced) / COUNT_IF(NOT withheld), 4) AS priced, COUNT_IF(unpriced AND NOT withheld) AS bad,
  round_even(COUNT_IF(k % 2 = 0) / COUNT(*), 4) AS trans FROM v),
s AS (SELECT COUNT(*) AS shared FROM (SELECT k // 2 FROM v WHERE NOT bare GROUP BY k // 2 HAVING COUNT(*) > 1))
"""


@query(_VEHICLES + """
SELECT n AS record_count, CAST(pub AS BIGINT) AS publishable_count, CAST(blk AS BIGINT) AS blocked_count, color AS color_coverage, priced AS price_coverage, shared AS cross_vehicle_photo_count, 3 AS photo_count_min, FALSE AS passed,
  'incomplete_snapshot:natural_end; expected_total_unknown; field_coverage:price:' || printf('%.2f', priced) || '<1.00; field_coverage:color_ext:' || printf('%.2f', color) || '<1.00; field_coverage:transmission:' || printf('%.2f', trans) || '<0.80; nonpositive_prices:' || bad || '/' || n || '; cross_vehicle_photo_duplicates:' || shared AS issues FROM a, s""")
def vehicle_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Q.vehicle_report(_vehicles(spark, sf_dir), None)
    c = F.col("field_coverage")
    return r.select("record_count", "publishable_count", "blocked_count", c["color_ext"].alias("color_coverage"), c["price"].alias("price_coverage"), "cross_vehicle_photo_count", F.col("photo_count_min").cast("int").alias("photo_count_min"), "passed", F.array_join("issues", "; ").alias("issues"))


@query(_VEHICLES + "SELECT round_even(0 - 0.05 * 7 + 0.6 * (6 + priced + round_even(1.0, 4)) / 8 + 0.3 * 0.5 + 0.1 - LEAST(0.25, blk / n * 0.25), 6) AS score, 'incomplete_coverage,missing_field:price,missing_field:color_ext,missing_field:transmission,photo_ownership' AS causes FROM a")
def repair_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Q.vehicle_report(_vehicles(spark, sf_dir), None)
    return r.select(Q.repair_score(r).alias("score"), F.array_join(Q.causes(F.col("issues")), ",").alias("causes"))


@query("""
WITH q AS (SELECT c_custkey AS query, c_mktsegment AS seg, c_nationkey AS nat, CAST(floor(abs(c_acctbal)) AS BIGINT) % 4 AS b FROM customer),
l AS (SELECT s_suppkey AS origin, s_nationkey AS nat, CAST(floor(abs(s_acctbal)) AS BIGINT) % 4 AS b, s_suppkey % 5 AS v FROM supplier),
m AS (SELECT query, origin, (CASE WHEN q.nat = l.nat THEN 4.0 ELSE 0 END) + (CASE WHEN q.b = l.b THEN 3.0 ELSE 0 END) + (CASE WHEN q.nat = l.nat THEN 2.5 ELSE 0 END) + 1.0 AS overlap, v FROM q, l),
s AS (SELECT query, origin, overlap, ROUND(overlap * CASE v WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.95 WHEN 3 THEN 0.8 ELSE 0.6 END, 2) AS score FROM m)
SELECT query, origin, CAST(overlap AS DOUBLE) AS overlap, CAST(score AS DOUBLE) AS score, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, origin) AS rank FROM s WHERE score >= 7) WHERE rank <= 2""")
def similar_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's best matches by shared features: nation, balance class, photo host and one weak value."""

    def long(df: DataFrame, names: list[str], nation: str, balance: str) -> DataFrame:
        b = F.floor(F.abs(F.col(balance))) % 4
        cells = F.array(*(F.struct(F.lit(f).alias("feature"), v.alias("value")) for f, v in (("platform_tokens", F.col(nation).cast("string")), ("gallery_mechanisms", b.cast("string")), ("photo_cdn_hosts", F.col(nation).cast("string")), ("gallery_mechanisms", F.lit("gallery:srcset")))))
        return df.select(*names, F.explode(cells).alias("c")).select(*names, "c.*")

    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query"), F.lit(None).cast("string").alias("host"), "c_nationkey", "c_acctbal")
    verdict = F.element_at(F.array(*(F.lit(v) for v in ("verified", "ship", "review", "needs_repair", "fingerprint_only"))), (F.col("s_suppkey") % 5).cast("int") + 1)
    lib = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("origin"), F.col("s_name").alias("host"), verdict.alias("verdict"), "s_nationkey", "s_acctbal")
    return S.similar(long(q, ["query", "host"], "c_nationkey", "c_acctbal"), long(lib, ["origin", "host", "verdict"], "s_nationkey", "s_acctbal"), floor=7.0).withColumn("rank", F.col("rank").cast("bigint"))


@query("""
WITH o AS (SELECT o_orderkey AS k, lower(o_orderstatus) AS status, round_even(o_totalprice, 0) AS total, lower(o_orderpriority) AS priority FROM orders)
SELECT 'status' AS field, COUNT(*) AS matches, COUNT(*) AS agree, FALSE AS dropped FROM o
UNION ALL SELECT 'total', COUNT(*), CAST(COUNT_IF(k % 3 = 0) AS BIGINT), TRUE FROM o
UNION ALL SELECT 'priority', CAST(COUNT_IF(k % 4 <> 0) AS BIGINT), CAST(COUNT_IF(k % 4 <> 0) AS BIGINT), FALSE FROM o""")
def reconcile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    a = table(spark, sf_dir, "orders").select(k.alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"))
    b = a.select("k", F.concat(F.lit(" "), F.lower("status")).alias("status"), F.when(F.col("k") % 3 == 0, F.col("total")).otherwise(F.col("total") + 1000).alias("total"), F.when(F.col("k") % 4 != 0, F.col("priority")).alias("priority"))
    return S.reconcile(a, b, "k", ["status", "priority"], ["total"])


@query("""
SELECT url, COUNT(DISTINCT owner) AS owners FROM (SELECT 'img/' || (l_partkey % 500) AS url, l_suppkey AS owner FROM lineitem) GROUP BY url HAVING COUNT(DISTINCT owner) > 1""")
def shared_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets that more than one owner publishes."""
    given = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("img/"), (F.col("l_partkey") % 500).cast("string")).alias("url"), F.col("l_suppkey").alias("owner"))
    return given.distinct().groupBy("url").agg(F.count(F.lit(1)).alias("owners")).where("owners > 1")
