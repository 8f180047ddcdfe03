"""From raw documents to packed training sequences: the operators of sheaf.llm, one after another.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns
of documents; run() writes each stage's rows to the shared folder, reads them back, and drops what the stage has left. Rows of equal doc_id stand or
fall together where a stage drops documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import left_since, settle, staged, staged_so_far
from sheaf.llm.decontamination import contamination
from sheaf.llm.minhash import near_duplicates
from sheaf.llm.packing import pack
from sheaf.llm.queries import tokenizer
from sheaf.llm.suffix_dedup import remove_repeats
from sheaf.llm.toxicity import rejected, toxicity, train

#: Word shingles and similarity (per cent) of the near-duplicate stage.
SHINGLE, PERCENT = 5, 80
#: Runs of text that a worker of the packing stage remembers, beside what the stages before it have left in the executors.
RUNS = 400_000


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below their language's threshold."""
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity(docs, net)
    return scored.where(~rejected(net, F.col("score"), F.col("lang"))).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document of the smallest id."""
    found = near_duplicates(docs, k=SHINGLE, percent=PERCENT)
    copies = found.where(F.col("id") != F.col("component")).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that earlier documents hold; a document of which nothing is left goes."""
    cut = remove_repeats(docs, in_place=True)
    changed = F.size("spans") > 0
    left = cut.where(~changed | (F.col("text") != ""))
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids, sequence and offset."""
    return pack(docs, tokenizer("word_bpe_49k.json"), memory=RUNS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: A trained classifier, classes of near copies and tokenizers have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begun = staged_so_far()
    for name, stage in STAGES[:-1]:
        docs, path = staged(stage(spark, docs, sf_dir), name)
        left_since(begun, path)  # the stage's own tables and its input
        settle(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
