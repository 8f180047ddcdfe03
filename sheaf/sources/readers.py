"""Readers of captured pages and records. Files are read by Spark's sources, so any store Spark reads will do."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

#: Caps of captured fixtures and record lines.
EXPANDED, COMPRESSED, LINE, ROWS = 16 << 20, (16 << 20) + (64 << 10), 512 << 10, 2000

VEHICLE_ROW = StructType(
    [
        *(StructField(n, StringType()) for n in ("vin", "stock_number", "make", "model", "trim", "name", "distance_unit", "color_ext", "color_int", "transmission", "drivetrain", "engine", "fuel", "body_type", "condition", "photo", "description", "detail_url", "source_listing_url")),
        StructField("vin_is_surrogate", BooleanType()),
        StructField("year", IntegerType()),
        StructField("price", DoubleType()),
        StructField("mileage", DoubleType()),
        StructField("photos", ArrayType(StringType())),
        StructField("features", ArrayType(StringType())),
    ]
)


def manifest_pages(spark: SparkSession, folder: str, manifest: str = "manifest.json") -> DataFrame:
    """(part, page_no, url, html) of the pages and details that a manifest lists, in its order."""
    entry = "array<struct<path: string, url: string>>"
    raw = spark.read.text(f"{folder}/{manifest}", wholetext=True)
    parsed = raw.select(F.from_json("value", f"struct<pages: {entry}, details: {entry}>").alias("m"), F.from_json("value", entry).alias("l"))
    part = lambda name, c: parsed.select(F.lit(name).alias("part"), F.posexplode(c).alias("page_no", "e")).select("part", "page_no", "e.path", "e.url")
    listed = part("pages", F.coalesce("m.pages", "l")).unionByName(part("details", "m.details"))
    files = fixtures(spark, folder)
    return listed.join(files, F.col("file").endswith(F.concat(F.lit("/"), F.col("path")))).select("part", "page_no", "url", "html")


def fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """(file, html, error) of all .html and .html.gz files below a folder; too large or broken ones have an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{html,gz}").load(folder)

    @F.pandas_udf("struct<html: string, error: string>")
    def expand(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        def one(path: str, data: bytes | None) -> tuple[str | None, str | None]:
            if data is None:
                return None, "compressed_too_large"
            try:
                if path.endswith(".gz"):
                    d = zlib.decompressobj(31)
                    data = d.decompress(data, EXPANDED + 1)
                if len(data) > EXPANDED:
                    return None, "expanded_too_large"
                return data.decode("utf-8"), None
            except (zlib.error, UnicodeDecodeError) as e:
                return None, type(e).__name__

        return pd.DataFrame([one(p, c) for p, c in zip(paths, contents)], columns=["html", "error"])

    small = F.when(F.col("length") <= COMPRESSED, F.col("content"))
    return files.select(F.col("path").alias("file"), expand("path", small).alias("x")).select("file", "x.html", "x.error")


def gzip_fixture(html: str) -> bytes:
    """The same bytes for the same page, whenever it is written."""
    return gzip.compress(html.encode(), compresslevel=6, mtime=0)


def records(spark: SparkSession, path: str, schema: StructType = VEHICLE_ROW) -> tuple[DataFrame, DataFrame]:
    """Valid rows of a JSON lines file and the lines that are not: too long, broken, of unknown or wrongly typed fields."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    strict = StructType([*schema.fields, StructField("_bad", StringType())])
    parsed = lines.withColumn("r", F.from_json("value", strict, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).withColumn("keys", F.json_object_keys("value"))
    known = F.array(*(F.lit(f.name) for f in schema.fields))
    keys = F.col("keys")
    error = (
        F.when(F.octet_length("value") > LINE, "line_too_long")
        .when(keys.isNull() | F.col("r._bad").isNotNull(), "broken")
        .when(F.size(F.array_distinct(keys)) < F.size(keys), "repeated_key")
        .when(F.size(F.array_except(keys, known)) > 0, "unknown_field")
    )
    for name, most in (("photos", 80), ("features", 160)):
        if name in schema.names:
            error = error.when(F.size(f"r.{name}") > most, f"too_many_{name}")
    judged = parsed.withColumn("error", error)
    return judged.where("error is null").select(*(F.col(f"r.{f.name}").alias(f.name) for f in schema.fields)), judged.where("error is not null").select("value", "error")


def library(spark: SparkSession, seed: str, data: str) -> DataFrame:
    """Spec records of two folders; those of the second win."""
    from ..operators.queue import shadowed

    own = spark.read.option("multiLine", "true").json(data)
    return shadowed(spark.read.option("multiLine", "true").schema(own.schema).json(seed), own)
