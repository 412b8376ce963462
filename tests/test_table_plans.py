"""A read of a keyed table leaves the rows where they lie."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tests.test_plans import plan
from wardloom.tables import KeyedTable


def test_rows_are_not_shuffled_to_leave_out_replaced_ones(spark, tmp_path):
    schema = StructType([StructField("id", StringType()), StructField("body", StringType())])
    table = KeyedTable(spark, str(tmp_path / "t"), schema, key="id", rank=F.col("body"))
    rows = spark.range(70_000).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("id"), F.lit("a").alias("body"))
    table.upsert(rows.coalesce(1))
    few = rows.where("id IS NULL OR cast(id AS long) % 3 = 0").withColumn("body", F.lit("b"))
    table.upsert(few.union(few.withColumn("body", F.lit("c"))))
    found = table.read()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = plan(found)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    wanted = {(None if i == 0 else str(i), "c" if i % 3 == 0 else "a") for i in range(70_000)}
    got = [(r["id"], r["body"]) for r in found.collect()]
    assert len(got) == 70_000 and set(got) == wanted


def test_rows_are_stored_small(spark, tmp_path):
    schema = StructType([StructField("id", StringType()), StructField("body", StringType())])
    table = KeyedTable(spark, str(tmp_path / "t"), schema, key="id", rank=F.col("body"))
    table.upsert(spark.range(10).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("body")))
    kinds = {pq.ParquetFile(file).metadata.row_group(0).column(0).compression for file in (tmp_path / "t").rglob("*.parquet")}
    assert kinds == {"ZSTD"} and table.count() == 10
