"""Event logs as streams: windows with late data, tails with a cursor, type filters, and per-origin cooldown state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed value: bytes of an event's payload before it is cut to a preview.
PAYLOAD = 32 << 10


def event_stream(spark: SparkSession, folder: str, schema: Any, files_per_trigger: int = 16) -> DataFrame:
    """Events of a folder of Parquet files as they arrive; ts becomes a timestamp, as watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, events, total) by windows that do not overlap."""
    return _windows(events, F.window("ts", every), late)


def sliding(events: DataFrame, length: str = "1 hour", every: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return _windows(events, F.window("ts", length, every), late)


def _windows(events: DataFrame, window: Any, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, events) by gaps of inactivity."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def tail(events: DataFrame, after: int, limit: int = 500) -> DataFrame:
    """Events after a cursor in order, limit at most."""
    return events.where(F.col("seq") > after).orderBy("seq").limit(min(limit, 500))


def without_noise(events: DataFrame, noisy: Iterable[str]) -> DataFrame:
    return events.where(~F.col("event_type").isin(*noisy))


def bounded_payload(events: DataFrame, column: str = "props") -> DataFrame:
    """Payloads over the cap become a preview that says so."""
    c = F.col(column)
    return events.withColumn(column, F.when(F.octet_length(c) > PAYLOAD, F.to_json(F.struct(F.lit(True).alias("truncated"), F.substring(c, 1, 1000).alias("preview")))).otherwise(c))


def follow(spark: SparkSession, folder: str, schema: Any, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append the events of a folder to a Parquet folder as they come, each once, from where an earlier call stopped.

    The cursor is the checkpoint, so a restart repeats nothing and misses nothing. Without an interval it reads what is
    there and ends; with one (as "30 seconds") it goes on, a tick at a time, until it is stopped.
    """
    writer = bounded_payload(event_stream(spark, folder, schema)).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ended(events: DataFrame, run: str = "run", terminal: Iterable[str] = ("passed", "partial", "failed")) -> DataFrame:
    """(run, last): of runs that are over the number of their last event; a tail of such a run ends there."""
    return events.where(F.col("event_type").isin(*terminal)).groupBy(run).agg(F.min("seq").alias("last"))


def numbered(events: DataFrame, run: str = "run", order: Iterable[str] = ("ts",)) -> DataFrame:
    """Events with a dense number in their run, in order: what an appender of one run would count."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(run).orderBy(*order)).cast("bigint"))


def claim_stream(crawls: DataFrame, rest_s: float, refused_rest_s: float) -> DataFrame:
    """(origin, at, admitted): crawl requests by origin as they come; one is admitted when the origin has rested.

    crawls: (origin, at double seconds, refused boolean). State is the end of an origin's rest.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free_at = state.get[0] if state.exists else 0.0
        out = []
        for part in parts:
            for at, refused in part.sort_values("at")[["at", "refused"]].itertuples(index=False):
                admitted = at >= free_at
                if admitted:
                    free_at = at + (refused_rest_s if refused else rest_s)
                out.append((key[0], float(at), bool(admitted)))
        state.update((float(free_at),))
        yield pd.DataFrame(out, columns=["origin", "at", "admitted"])

    return crawls.groupBy("origin").applyInPandasWithState(step, "origin string, at double, admitted boolean", "free_at double", "append", GroupStateTimeout.NoTimeout)
