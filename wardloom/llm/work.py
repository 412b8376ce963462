"""Tables that cut lineage, and connected components over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.session import work_path


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back, so that a lost executor repeats none of what made them."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(df: DataFrame, name: str, kind: str) -> F.Column:
    """A column by its name whatever else the table holds; of nulls if there is none."""
    names = {c.lower(): c for c in df.columns}
    if name.lower() not in names:
        return F.lit(None).cast(kind).alias(name)
    return F.col(f"`{names[name.lower()]}`").cast(kind).alias(name)


def take(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast to the named types."""
    return df.select(*[column(df, name, kind) for name, kind in kinds.items()])


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of the edges ``(a, b)``: root is the smallest node it is connected with.

    Large-star and small-star steps in turn: in each, the neighbours of a node are hung on the smallest node
    near it, until nothing moves. The number of rounds grows with the logarithm of the longest path. The
    driver sees two sums per round. Edges of a hub are rows of their own all the time, never a list.
    """
    spark = edges.sparkSession
    ab = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    # from here on each row hangs `child` on a smaller `parent`
    hung = saved(ab.where("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct(), "edges")
    nodes = ab.select(F.col("a").alias("node")).union(ab.select("b")).distinct()
    before = None
    while True:
        both = hung.union(hung.select("parent", "child")).toDF("node", "near")
        least = both.groupBy("node").agg(F.min("near").alias("low")).select("node", F.least("node", "low").alias("low"))
        large = both.join(least, "node").where("near > node").select(F.col("near").alias("child"), F.col("low").alias("parent")).distinct()
        lows = large.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("low"))
        small = large.join(lows, large["child"] == lows["node"]).select("child", "parent", "low")
        hung = saved(
            small.select("child", F.col("low").alias("parent"))
            .union(small.where("parent <> low").select(F.col("parent").alias("child"), F.col("low").alias("parent")))
            .where("child <> parent")
            .distinct(),
            "edges",
        )
        now = hung.agg(F.count("*"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).head()
        if now == before or not now[0]:
            break
        before = now
    roots = hung.select(F.col("child").alias("node"), F.col("parent").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
