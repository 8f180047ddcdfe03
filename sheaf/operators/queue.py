"""Work-queue policies, run lineage and libraries of specs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rest after a crawl and after a refusal, and the texts that mean a refusal.
REST_S, REFUSED_REST_S = 1800.0, 43200.0
REFUSAL = r"(?i)\b429\b|too many requests|rate.?limit"


def cooldowns(jobs: DataFrame, now: Column) -> DataFrame:
    """(origin, rest_left): seconds each origin must still rest after its latest crawl."""
    latest = jobs.where("last_crawl_at is not null").groupBy("origin").agg(F.max("last_crawl_at").alias("at"), F.max_by(F.coalesce("refusal", F.lit("")), "last_crawl_at").alias("refusal"))
    rest = F.when(F.col("refusal").rlike(REFUSAL), REFUSED_REST_S).otherwise(REST_S)
    return latest.select("origin", F.greatest(F.lit(0.0), rest - (now - F.col("at"))).alias("rest_left"))


def claims(jobs: DataFrame, now: Column, slots: int = 1) -> DataFrame:
    """The next queued jobs, oldest first: one for an origin, none of busy or resting ones."""
    busy = jobs.where("state = 'running'").select("origin").distinct()
    resting = cooldowns(jobs, now).where("rest_left > 0").select("origin")
    free = jobs.where("state = 'queued'").join(busy, "origin", "left_anti").join(resting, "origin", "left_anti")
    one = free.groupBy("origin").agg(F.min_by(F.struct(*free.columns), F.struct("created_at", "job_id")).alias("j")).select("j.*")
    return one.orderBy("created_at", "job_id").limit(slots)


def intake(requests: DataFrame, jobs: DataFrame, blocked: DataFrame, limit: int = 40) -> DataFrame:
    """(request, decision): queued, or why not."""
    active = jobs.where("state in ('queued', 'running')").select("origin").distinct().withColumn("active", F.lit(True))
    size = jobs.where("state = 'queued'").agg(F.count(F.lit(1)).alias("queued"))
    seen = requests.join(active, "origin", "left").join(blocked.select("origin").distinct().withColumn("blocked", F.lit(True)), "origin", "left").crossJoin(size)  # one row
    why = F.when(F.col("blocked"), "origin_blocked").when(F.col("active"), "origin_active").when(F.col("queued") >= limit, "queue_full").otherwise("queued")
    return seen.select(*requests.columns, why.alias("decision"))


def lineage(spark: SparkSession, runs: DataFrame, generations: int = 1000) -> DataFrame:
    """(run, root, generation) by parents; runs: (run, parent). A chain of more generations than stated is an error."""
    view = f"sheaf_runs_{uuid.uuid4().hex}"
    runs.createOrReplaceTempView(view)
    try:
        return spark.sql(f"""
            WITH RECURSIVE line(run, root, generation) MAX RECURSION LEVEL {int(generations)} AS (
              SELECT run, run, 0 FROM {view} WHERE parent IS NULL
              UNION ALL
              SELECT r.run, l.root, l.generation + 1 FROM line l JOIN {view} r ON r.parent = l.run
            ) SELECT run, root, generation FROM line""")
    finally:
        spark.catalog.dropTempView(view)


def shadowed(seed: DataFrame, data: DataFrame, key: str = "origin") -> DataFrame:
    """Data records, and seed records of other keys."""
    return data.unionByName(seed.join(data.select(key), key, "left_anti"))


def latest_rows(df: DataFrame, by: str, order: str, n: int = 100) -> DataFrame:
    return df.orderBy(F.desc(order), F.desc(by)).limit(n)


def pruned(df: DataFrame, now: Column, at: str, ttl_s: float, keep: int) -> DataFrame:
    """Records younger than the time to live, the newest keep of them (a top-k, not a global window)."""
    return df.where(now - F.col(at) <= ttl_s).orderBy(F.desc(at)).limit(keep)


def roll_up(events: DataFrame, run: str = "run") -> DataFrame:
    """(run, status) from row and error counts of its sources."""
    return events.groupBy(run).agg(F.sum("rows").alias("rows"), F.sum("errors").alias("errors")).withColumn("status", F.when(F.col("rows") == 0, "failed").when(F.col("errors") > 0, "partial").otherwise("passed"))


def retry_delay(attempt: Column, base: float, cap: float, retry_after: Column | None = None) -> Column:
    """The server's delay if it names one, else exponential backoff, at most cap."""
    backoff = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))
    return backoff if retry_after is None else F.coalesce(F.least(F.lit(cap), retry_after.try_cast("double")), backoff)


def strong_etag(c: Column) -> Column:
    return F.coalesce(c.rlike(r'^"[\x21\x23-\x7e]{1,510}"$'), F.lit(False))


def cacheable(headers: Column) -> Column:
    """No vary or set-cookie header, nothing private or not to be stored; headers: map of lower-case names."""
    control = F.lower(F.coalesce(headers["cache-control"], F.lit("")))
    return headers["vary"].isNull() & headers["set-cookie"].isNull() & ~control.contains("private") & ~control.contains("no-store")
