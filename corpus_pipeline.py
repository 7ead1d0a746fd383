"""The corpus pipeline: documents are filtered, deduplicated, decontaminated and packed.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents. run() writes every stage as Parquet and reads it back, so that no stage's work is repeated.

Null and empty texts pass where the classifier keeps them, and pack as one piece each, the end mark; texts of any length are handled whole; of repeated
rows with words one stays; an empty table gives no rows. Columns are those of documents, by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliodiff.llm import decontaminate, factorisation, line_dedup, near_dedup, packing
from foliodiff.llm.common import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; learns from the labels that are not held out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = factorisation.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return factorisation.score(docs, model).filter("predicted = 1").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of repeated three-line windows."""
    done = line_dedup.dedup(docs).withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long"))
    return done.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return near_dedup.dedup(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in bins."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: the classifier and the packer are iterative. Tests hold line dedup, near dedup and decontamination against brute force, the
#: classifier against held-out labels and the packing against its invariants.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
