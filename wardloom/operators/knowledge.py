"""The knowledge table of embedded chunks (K1-K3, A1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions.text import strings, strip, text_or_empty
from wardloom.operators.chunking import chunk, chunk_texts
from wardloom.operators.embedding import EmbedFn, embed
from wardloom.operators.tagging import tag_specialty
from wardloom.reference_data import CHUNK_OVERLAP, CHUNK_SIZE
from wardloom.schemas import KB_CHUNK
from wardloom.tables import KeyedTable


def source_of(document_key: Column) -> Column:
    """Text before the first colon of a document key, empty without a colon."""
    return F.when(F.instr(document_key, ":") > 0, F.substring_index(document_key, ":", 1)).otherwise(F.lit(""))


def knowledge_table(spark: SparkSession, root: str) -> KeyedTable:
    """Chunks by chunk id, laid out by source: ``read(source)`` reads that source only.

    Of equal ids in one batch the latest publication date counts, then a hash of the text.
    """
    date = F.coalesce(F.col("metadata.publication_date").cast("string"), F.lit(""))
    return KeyedTable(
        spark, root, KB_CHUNK, key="chunk_id", layout="source", rank=F.concat_ws(" ", date, F.md5("text")),
        sort_within=("source_document_id", "position"),
    )


def single_version(documents: DataFrame, order: Column | None = None) -> DataFrame:
    """One version of each document (source, source_id): the greatest by ``order``, by default the publication date.

    A batch may hold a document more than once. Deciding on whole documents keeps the chunks of two versions apart.
    Ties are cut by a hash of the whole document; equal rows are one. Only documents that come more than once are joined.
    """
    rank = F.col("metadata.publication_date") if order is None else order
    version = F.struct(rank.alias("rank"), F.xxhash64("title", "content", "content_type", F.to_json("metadata")).alias("hash"))
    keyed = documents.withColumn("_key", F.struct("source", "source_id")).withColumn("_version", version)
    best = keyed.groupBy("_key").agg(F.count("*").alias("_copies"), F.max("_version").alias("_best")).where("_copies > 1")
    picked = keyed.join(best, keyed["_key"].eqNullSafe(best["_key"]), "left").where("_copies IS NULL OR _version <=> _best")
    once = picked.where("_copies IS NULL").select(documents.columns)
    copies = picked.where("_copies IS NOT NULL").select(documents.columns)
    return once.unionByName(copies.dropDuplicates(["source", "source_id"]))


def knowledge_rows(
    documents: DataFrame,
    fn: EmbedFn | None = None,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Documents to rows of the knowledge table: chunk, tag, embed. Narrow steps only."""
    tagged = tag_specialty(chunk(documents, size, overlap))
    return embed(tagged, fn).withColumn("source", source_of(F.col("source_document_id"))).select(*KB_CHUNK.names)


def upsert_chunks(table: KeyedTable, rows: DataFrame) -> None:
    table.upsert(rows)


def count_chunks(kb: DataFrame) -> DataFrame:
    return kb.agg(F.count("*").alias("chunks"))


def flat_metadata(chunks: DataFrame) -> DataFrame:
    """Chunks with their metadata as plain scalar columns."""
    key, m = F.col("source_document_id"), F.col("metadata")
    return chunks.select(
        "chunk_id",
        "text",
        key,
        source_of(key).alias("source"),
        "position",
        m["credibility"].alias("credibility"),
        F.array_join(strings(m["specialty"]), ",").alias("specialty"),
        F.array_join(strings(m["authors"]), ",").alias("authors"),
        text_or_empty(m["doi"]).alias("doi"),
        text_or_empty(m["url"]).alias("url"),
        *[F.col(c) for c in ("embedding",) if c in chunks.columns],
    )


def _totals(rows: DataFrame) -> DataFrame:
    """Per source and, with a null source, in total. Sums are formed before the shuffle."""
    return (
        rows.rollup("source")
        .agg(F.sum("documents").alias("documents"), F.sum("chunks").alias("chunks"), F.grouping("source").alias("total"))
        .select(
            "source",
            (F.col("total") == 1).alias("is_total"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("chunks", F.lit(0)).alias("chunks"),
        )
    )


def ingest_summary(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents and chunks per source and in total; sources without documents do not appear."""
    counted = documents.select("source", F.lit(1).alias("documents"), F.lit(0).alias("chunks")).unionByName(
        chunks.select(
            source_of(F.col("source_document_id")).alias("source"),
            F.lit(0).alias("documents"),
            F.lit(1).alias("chunks"),
        )
    )
    return _totals(counted)


def ingest_summary_of(documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """The same straight from documents: one scan, chunks counted in place and not exploded."""
    pieces = F.filter(chunk_texts(size, overlap), lambda p: strip(p) != "")
    return _totals(
        documents.select("source", F.lit(1).alias("documents"), F.size(pieces).alias("chunks"))
    )
