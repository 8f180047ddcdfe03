"""Where query modules register a callable and, if SQL can express it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: The fewest and the most rows of a spread table's partition, its partitions for each core, and tables
#: whose long texts never enter a shuffle.
SPREAD, MOST, EACH, LONG = 5000, 50_000, 8, ("documents", "pages", "conversations", "embeddings")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores: a narrow table of many rows is a file of few bytes, which one task would read and work on.

    Pages are built and parsed after this, row by row, so only the narrow rows are shuffled.
    """
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism  # a count of Parquet footers
    rows = max(SPREAD, min(n // (EACH * cores), MOST))  # a task has a cost of its own: tasks of few rows are mostly that
    return df.repartition(-(-n // rows)) if n > SPREAD and df.rdd.getNumPartitions() < 4 * cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df if name in LONG else spread(df)
