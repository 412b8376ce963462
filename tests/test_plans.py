"""The physical plans that the operators rely on at scale."""

import numpy as np
from pyspark.sql import functions as F

from tests.test_tables_and_search import kb_rows
from wardloom.operators import cases as case_ops
from wardloom.operators import knowledge, search, tagging
from wardloom.operators.chunking import chunk
from wardloom.schemas import CASE_STORE
from wardloom.sources import registry
from wardloom.tables import latest_per_key


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark):
    return spark.range(100).select(
        (F.col("id") % 3).cast("string").alias("source"), F.col("id").cast("string").alias("source_id"),
        F.lit("t").alias("title"), F.lit("a stroke").alias("content"), F.lit("abstract").alias("content_type"),
        F.lit(None).cast("struct<authors:array<string>,publication_date:date,specialty:array<string>,credibility:string,url:string,doi:string>").alias("metadata"),
    )


def test_ingest_is_narrow_up_to_the_upsert(spark):
    text = plan(tagging.tag_specialty(chunk(documents(spark))))
    assert "Exchange" not in text and "Join" not in text


def test_text_is_searched_once_for_all_specialties(spark):
    text = plan(tagging.tag_specialty(chunk(documents(spark))))
    assert text.count("regexp_extract_all(") == 1


def test_row_cap_is_cut_before_its_shuffle(spark):
    text = plan(registry.limit_per_source(documents(spark), 5))
    assert text.count("WindowGroupLimit") >= 3 and "Partial" in text


def test_latest_row_is_cut_before_its_shuffle(spark):
    assert "partial_max_by" in plan(latest_per_key(documents(spark), "source", [F.col("source_id")]))


def test_search_keeps_the_best_of_each_task(spark):
    kb = knowledge.flat_metadata(kb_rows(spark, ("a", "s", "t", 1.0, 0.0, "curated")))
    assert "TakeOrderedAndProject" in plan(search.search(kb, np.ones(2), 3))


def test_case_filters_reach_the_scan_without_the_json(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([], CASE_STORE).write.parquet(path)
    store = spark.read.schema(CASE_STORE).parquet(path)
    rows = case_ops.list_rows(store, topic="x", difficulty="resident", min_accuracy=0.5).select("case_id", "generated_at")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(rows)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(topic,x)" in text and "GreaterThanOrEqual(accuracy_score,0.5)" in text
    assert "case_json" not in text and "TakeOrderedAndProject" in text
    assert "ReadSchema: struct<case_id:string>" in plan(store.select("case_id"))
