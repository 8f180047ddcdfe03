"""Queries of queue policies, lineage and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import queue as Q
from ..streaming import events as E
from .registry import query, table


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "purchase", "running").when(F.col("event_type") == "view", "queued").otherwise("done")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), (F.col("user_id") % 200).alias("origin"), state.alias("state"), at.alias("created_at"),
        F.when(F.col("event_type") != "view", at).alias("last_crawl_at"), F.when(F.col("event_type") == "error", "HTTP 429 too many requests").alias("refusal"),
    )


_JOBS = """
WITH j AS (SELECT event_id AS job_id, user_id % 200 AS origin, CASE event_type WHEN 'purchase' THEN 'running' WHEN 'view' THEN 'queued' ELSE 'done' END AS state, epoch_us(ts) / 1e6 AS created_at,
  CASE WHEN event_type <> 'view' THEN epoch_us(ts) / 1e6 END AS last_crawl_at, event_type = 'error' AS refused FROM events),
n AS (SELECT MAX(created_at) AS now FROM j),
c AS (SELECT origin, GREATEST(0.0, (CASE WHEN arg_max(refused, last_crawl_at) THEN 43200.0 ELSE 1800.0 END) - (ANY_VALUE(now) - MAX(last_crawl_at))) AS rest_left FROM j, n WHERE last_crawl_at IS NOT NULL GROUP BY origin)
"""


@query(_JOBS + "SELECT origin, ROUND(rest_left, 3) AS rest_left FROM c")
def cooldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    now = jobs.agg(F.max("created_at")).first()[0]
    return Q.cooldowns(jobs, F.lit(now)).select("origin", F.round("rest_left", 3).alias("rest_left"))


@query(_JOBS + """, f AS (SELECT * FROM j WHERE state = 'queued' AND origin NOT IN (SELECT origin FROM j WHERE state = 'running' AND origin % 3 = 0) AND origin NOT IN (SELECT origin FROM c WHERE rest_left > 0))
SELECT job_id, origin FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY origin ORDER BY created_at, job_id) AS r FROM f) WHERE r = 1 ORDER BY created_at, job_id LIMIT 25""")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    now = jobs.agg(F.max("created_at")).first()[0]
    jobs = jobs.withColumn("state", F.when((F.col("state") == "running") & (F.col("origin") % 3 != 0), "done").otherwise(F.col("state")))
    return Q.claims(jobs, F.lit(now), 25).select("job_id", "origin")


@query(_JOBS + """SELECT c_custkey AS origin, CASE WHEN c_custkey % 9 = 0 THEN 'origin_blocked' WHEN c_custkey IN (SELECT origin FROM j WHERE state IN ('queued', 'running')) THEN 'origin_active' ELSE 'queue_full' END AS decision FROM customer""")
def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("origin"))
    return Q.intake(requests, _jobs(spark, sf_dir), requests.where("origin % 9 = 0"))


@query("""
WITH RECURSIVE r AS (SELECT conv_id * 1000 + turn AS run, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent FROM conversations),
l AS (SELECT run, run AS root, 0 AS generation FROM r WHERE parent IS NULL UNION ALL SELECT r.run, l.root, l.generation + 1 FROM l JOIN r ON r.parent = l.run)
SELECT run, root, generation FROM l""")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.col("conv_id") * 1000 + F.col("turn")
    return Q.lineage(spark, table(spark, sf_dir, "conversations").select(run.alias("run"), F.when(F.col("turn") > 0, run - 1).alias("parent")))


@query("SELECT s_nationkey AS origin, MIN(s_name) AS name FROM supplier GROUP BY s_nationkey UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def library_shadowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("origin")).agg(F.min("s_name").alias("name"))
    return Q.shadowed(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("origin"), F.col("n_name").alias("name")), data)


@query("SELECT user_id AS run, CAST(COUNT_IF(event_type = 'view') AS BIGINT) AS n_rows, CAST(COUNT_IF(event_type = 'error') AS BIGINT) AS errors, CASE WHEN COUNT_IF(event_type = 'view') = 0 THEN 'failed' WHEN COUNT_IF(event_type = 'error') > 0 THEN 'partial' ELSE 'passed' END AS status FROM events GROUP BY user_id")
def run_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), (F.col("event_type") == "view").cast("bigint").alias("rows"), (F.col("event_type") == "error").cast("bigint").alias("errors"))
    return Q.roll_up(e).withColumnRenamed("rows", "n_rows")


@query("SELECT event_id, user_id FROM (SELECT *, MAX(ts) OVER () AS now FROM events) WHERE epoch_us(now) - epoch_us(ts) <= 600000000 ORDER BY ts DESC LIMIT 20")
def fresh_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return Q.pruned(e, F.lit(e.agg(F.max("at")).first()[0]), "at", 600.0, 20).select("event_id", "user_id")


@query("SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def event_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.numbered(table(spark, sf_dir, "events"), "user_id", ("ts", "event_id")).select("user_id", "event_id", "seq")


@query("SELECT event_id + 1 AS seq, event_type FROM events WHERE event_id + 1 > 100 AND event_type <> 'view' ORDER BY seq LIMIT 500")
def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("seq"), "event_type")
    return E.tail(E.without_noise(e, ["view"]), 100, 500)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("value", F.col("value").cast("decimal(18,2)"))


_TOTAL = "CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total"


@query(f"SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS window_start, event_type, COUNT(*) AS events, {_TOTAL} FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tumbling(_events(spark, sf_dir)).withColumn("window_start", F.unix_seconds("window_start")).withColumn("total", F.col("total").cast("double"))


@query(f"""
SELECT epoch_us(time_bucket(INTERVAL 15 MINUTE, ts)) // 1000000 - 900 * k AS window_start, event_type, COUNT(*) AS events, {_TOTAL}
FROM events, (SELECT UNNEST([0, 1, 2, 3]) AS k) GROUP BY 1, 2""")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sliding(_events(spark, sf_dir)).withColumn("window_start", F.unix_seconds("window_start")).withColumn("total", F.col("total").cast("double"))


@query("""
WITH g AS (SELECT user_id, epoch_us(ts) AS u, CASE WHEN epoch_us(ts) - LAG(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, SUM(b) OVER (PARTITION BY user_id ORDER BY u) AS s FROM g)
SELECT user_id, MIN(u) AS session_start, MAX(u) + 1800000000 AS session_end, COUNT(*) AS events FROM s GROUP BY user_id, s""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.sessions(_events(spark, sf_dir))
    return s.select("user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "events")
