"""Thin wrappers of Spark's own operators on the star schema: grouping sets, windows, set operations and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, table

_CENTS = "CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue"


def _sum(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


@query(f"SELECT l_returnflag, l_linestatus, COUNT(*) AS lines, {_CENTS} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("lines"), _sum("l_extendedprice").alias("revenue"))


@query(f"SELECT l_returnflag, l_linestatus, COUNT(*) AS lines, {_CENTS} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("lines"), _sum("l_extendedprice").alias("revenue"))


@query(f"""
SELECT n_name, o_orderpriority, {_CENTS} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY n_name, o_orderpriority""")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    joined = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "o_orderpriority").agg(_sum("l_extendedprice").alias("revenue"))


@query("SELECT c_nationkey, c_custkey, rank FROM (SELECT *, RANK() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.rank().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, sf_dir, "customer").withColumn("rank", rank.cast("bigint")).where("rank <= 3").select("c_nationkey", "c_custkey", "rank")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").exceptAll(table(spark, sf_dir, "orders").select("o_custkey").distinct())


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def customers_with_finished_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")
