"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing and packing over documents.

Each stage takes (spark, docs, sf_dir); run() writes a stage's rows as Parquet to the shared
folder and the next one reads them, so a lost executor costs a stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import exact_dedup, mixing, packing, quality_rules, simhash
from changelens.llm._shared import dropped, n_words, staged, table


def _rows(docs: DataFrame, *columns: str) -> DataFrame:
    """docs with each row whole in __row, beside the columns a stage needs: users' columns of any name come through as they are."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), *columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    A null or empty text has no words and goes; rows are judged one by one, so repeated rows fare
    alike; texts of any length are read whole; an empty table stays empty.
    """
    return quality_rules.cascade(_rows(docs, "text")).filter("kept").select("__row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest as written, then the smallest doc_id, a null one last.

    Null, empty and blank texts are one group; of rows that repeat a doc_id and text one stays.
    """
    return exact_dedup.exact_dedup(_rows(docs, "doc_id", "text"), carry=["__row", "doc_id"]).filter("kept").select("__row.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id; a row without one stays only where all lack it."""
    keyed = staged(_rows(docs, "doc_id").withColumn("__at", F.monotonically_increasing_id()), "near-rows")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__at").alias("row"))
    found = simhash.near_duplicates(keyed.select(key.alias("doc_id"), F.col("__row.text").alias("text")))
    gone = found.filter(F.col("doc_id.row") != F.col("component_id.row")).select(F.col("doc_id.row").alias("__at"))
    return keyed.join(gone, "__at", "left_anti").select("__row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in its order.

    A text without words is never taken; null sources are one source, the last; rows that repeat a
    doc_id are documents of their own.
    """
    words = n_words(F.col("text")).alias("__words")  # counted here, so that each text is carried once
    return mixing.mixed_stream(_rows(docs, "doc_id", "source", words), size=F.col("__words")).select("__row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents with their places in sequences.

    A null text is empty and gives its end token; rows that repeat a doc_id are packed each on its own.
    """
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL has no XXH64 fingerprints and no byte-pair encoding, so it can't express the third and fifth stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        written = staged(stage(spark, docs, sf_dir), f"pipeline-{k}-{name.replace(' ', '-')}")
        if k:  # the stage before is read no more
            dropped(docs)
        docs = written
    return docs
