"""The corpus pipeline: five stages, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's docs.  All but the last return the columns of documents, with n_chars renewed where the text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heaploom.llm.common import written
from heaploom.llm.decontaminate import remove_contaminated
from heaploom.llm.jaccard_join import jaccard_components
from heaploom.llm.line_dedup import remove_boilerplate
from heaploom.llm.packing import pack_documents
from heaploom.llm.queries import table, tokenizer_path
from heaploom.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models call toxic go."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), keep=True)
    return scored.where(F.col("predicted") == 0).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines spread over many sites go, but for their first copy; every document stays, even if nothing of it is left."""
    out = remove_boilerplate(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links join, the one with the smallest id stays.

    Rows with a null id stay; of repeated rows one stays.
    """
    groups = jaccard_components(docs)
    gone = groups.where("doc_id != component_id").select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti").select(COLUMNS)
    again = groups.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 and doc_id is not null").select("doc_id")
    if not again.take(1):
        return rest
    return rest.join(again, "doc_id", "left_anti").unionByName(rest.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, to within a few word edits, go."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left is packed into sequences of 2048 tokens, a row per piece of a document."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express the stages' models, searches and tokenizer; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
