"""A corpus pipeline of operators in ``wardloom.llm``: each stage works on all that the one before it kept.

The first three stages return the columns of documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.llm import decontaminate, ordinal, packing, shingle_join
from wardloom.llm.queries import encoder_args, table
from wardloom.llm.work import saved


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good and not toxic with a probability of one half or more."""
    return ordinal.selected(docs, ordinal.grades_of(table(spark, sf_dir, "labels")), top=2, wanted=2)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by shingles one stays: that of smallest id, rows without an id last.

    Rows are told apart by their place in the table, so of rows that repeat an id, with one text or several, no copy
    stays beside another. Texts without words are linked with nothing and stay.
    """
    rows = docs.withColumn("row_number", F.monotonically_increasing_id())
    groups = shingle_join.similar_groups(rows.select(F.col("row_number").alias("doc_id"), "text"))
    ids = rows.select("row_number", F.col("doc_id").alias("id"))
    groups = groups.select(F.col("doc_id").alias("row_number"), "component_id").join(ids, "row_number")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row_number")).alias("first"))
    kept = first.select(F.col("first.row_number").alias("row_number"))
    return rows.join(kept.hint("shuffle_hash"), "row_number", "left_semi").select(docs.columns)


def no_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_passages(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs, encoder_args(), keep_ids=False)


STAGES = [
    ("quality_classifier", good_documents),
    ("ngram_jaccard_join", one_per_group),
    ("benchmark_decontamination", no_benchmark_items),
    ("best_fit_packing", packed),
]

ORACLE_SQL = None  # no stage can be said in SQL; tests/llm/test_pipeline.py holds it against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
