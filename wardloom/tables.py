"""Keyed tables as plain Parquet folders by batch number (K1, K3, K4).

An upsert appends its own rows under the next number. A read takes of each key the row of the greatest batch that has
it, and inside a batch the one of the greatest rank: the narrow columns are ordered by key, and the rows found replaced are
broadcast as bitmaps, one bit a row of the blocks that have some. Rows themselves are never shuffled by a read.

Rows are laid out by an optional column, whose values are kept in the rows as well, so that empty and null values
stay what they are. Nothing written is changed later: a reader keeps the files it has listed, and a job that dies
leaves the table as it was. One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

BLOCK_BITS = 15  # rows of a block as a power of two: those whose bits one bitmap of Spark's holds


def latest_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the greatest by ``order``. Copies of a hot key are cut down before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return (
        df.groupBy(F.col(key).alias("_key"))
        .agg(F.max_by(row, F.struct(*order)).alias("_row"))
        .select("_row.*")
    )


class KeyedTable:
    """``rank`` is a narrow text per row that decides between equal keys of one batch."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: StructType,
        key: str,
        rank: Column,
        layout: str | None = None,
        sort_within: tuple[str, ...] = (),
    ) -> None:
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key
        self.rank, self.layout, self.sort_within = rank, layout, sort_within or (key,)
        own = [StructField("_rank", StringType()), StructField("_row", LongType()), StructField("batch", LongType()), StructField("part", StringType())]
        self._stored = StructType([*schema.fields, *own])

    def _rows(self) -> DataFrame:
        """All rows of all batches; none where nothing was written yet."""
        try:
            return self.spark.read.schema(self._stored).parquet(self.root)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self._stored)

    def _part_of(self, value: Column) -> Column:
        return F.concat(F.lit("v"), F.coalesce(value.cast("string"), F.lit("")))

    def read(self, layout_value: str | None = None) -> DataFrame:
        """The newest row of every key; with a value of the layout column only what is stored under it."""
        rows = stored = self._rows()
        if layout_value is not None:
            rows = rows.where((F.col("part") == self._part_of(F.lit(layout_value))) & (F.col(self.layout) == layout_value))
        rows = rows.withColumn("_block", F.shiftright("_row", BLOCK_BITS))
        kept = rows.join(F.broadcast(self._replaced(stored)), ["batch", "_block"], "left")
        place = F.pmod(F.col("_row"), F.lit(1 << BLOCK_BITS))
        byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        replaced = F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1
        return kept.where(F.col("_bits").isNull() | ~replaced).select(*self.schema.names)

    def _replaced(self, stored: DataFrame) -> DataFrame:
        """``batch, _block, _bits``: a bit for each row of a block that a later one replaces; blocks without such rows are left out."""
        order = Window.partitionBy(self.key).orderBy(F.desc("batch"), F.desc("_rank"), F.desc("_row"))
        old = stored.select(self.key, "batch", "_rank", "_row").withColumn("_n", F.row_number().over(order)).where("_n > 1")
        place = F.pmod(F.col("_row"), F.lit(1 << BLOCK_BITS))
        return old.groupBy("batch", F.shiftright("_row", BLOCK_BITS).alias("_block")).agg(F.bitmap_construct_agg(place).alias("_bits"))

    def count(self) -> int:
        return self.read().count()

    def written(self, batch: int) -> DataFrame:
        """The rows of one upsert as they were given to it."""
        return self._rows().where(F.col("batch") == batch).select(*self.schema.names)

    def upsert(self, rows: DataFrame) -> int:
        """Insert rows, replacing those of equal key; returns the number of the batch.

        The rows are computed once and nothing else is written.
        """
        number = (self._rows().agg(F.max("batch")).head()[0] or 0) + 1
        part = self._part_of(F.col(self.layout)) if self.layout else F.lit("v")
        laid = rows.select(*self.schema.names, self.rank.cast("string").alias("_rank"), part.alias("part"))
        if self.layout:
            laid = laid.hint("rebalance", "part")
        laid = laid.sortWithinPartitions("part", *self.sort_within).withColumn("_row", F.monotonically_increasing_id())
        laid.write.mode("append").option("compression", "zstd").partitionBy("part").parquet(f"{self.root}/batch={number}")
        return number
