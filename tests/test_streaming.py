from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.streaming import events as E

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def write(spark, folder, rows):
    spark.sql("select " + ", ".join(f"'' as {c}" for c in "a")).count()
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string")
    df.select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(folder)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_stream_equals_batch_for_closed_windows(spark, tmp_path):
    folder = str(tmp_path / "e")
    write(spark, folder, [(1, "2024-01-01 00:10:00", 1, "view", 1.0, "{}"), (2, "2024-01-01 00:50:00", 1, "view", 2.0, "{}"), (3, "2024-01-01 05:00:00", 2, "view", 4.0, "{}")])
    run(E.tumbling(E.event_stream(spark, folder, SCHEMA)), "windows", "update")
    got = {(r["window_start"].hour, r["events"], r["total"]) for r in spark.table("windows").collect()}
    assert got == {(0, 2, 3.0), (5, 1, 4.0)}


def test_claims_keep_state(spark, tmp_path):
    folder = str(tmp_path / "c")
    spark.createDataFrame([("a", 0.0, False), ("a", 5.0, False), ("a", 11.0, True), ("a", 30.0, False), ("b", 1.0, False)], "origin string, at double, refused boolean").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("origin string, at double, refused boolean").parquet(folder)
    run(E.claim_stream(stream, 10.0, 100.0), "claims_state")
    got = sorted((r["origin"], r["at"], r["admitted"]) for r in spark.table("claims_state").collect())
    assert got == [("a", 0.0, True), ("a", 5.0, False), ("a", 11.0, True), ("a", 30.0, False), ("b", 1.0, True)]


def test_large_payloads_become_previews(spark):
    df = spark.createDataFrame([("x" * 40000,), ("y",)], "props string")
    a, b = (r["props"] for r in E.bounded_payload(df).collect())
    assert '"truncated":true' in a and len(a) < 2000 and b == "y"
