"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a frame; each is written
as Parquet in the shared folder and read again as the next stage's documents.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchpost.llm import bestfit, decontaminate, lines, quality, simhash
from watchpost.llm.base import scratch, ship, table
from watchpost.llm.queries import WORD_END, WORD_VOCABULARY
from watchpost.llm.tokens import SMALL


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; n_chars follows the text."""
    kept = lines.drop_boilerplate(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn(
            "n_chars", F.when(F.col("__n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        )
    return kept.select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates."""
    return simhash.keep_first(docs, shingle=3, radius=2)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the packed sequences."""
    found = bestfit.pack_documents(docs, WORD_VOCABULARY, WORD_END, budget=SMALL)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_boilerplate),
    ("simhash", without_near_duplicates),
    ("decontaminate", without_benchmark),
    ("best_fit", packed),
]

#: The stages 1, 3 and 5 are beyond SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
