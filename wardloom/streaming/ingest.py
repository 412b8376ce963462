"""Incremental ingest of landed payloads.

A micro-batch may be repeated after a failure. Chunks are upserted by key and the progress of a batch is
written under its number, so a repeat leaves the same state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardloom.operators.embedding import EmbedFn
from wardloom.operators.knowledge import ingest_summary, knowledge_rows, single_version
from wardloom.schemas import DOCUMENT
from wardloom.sources import registry
from wardloom.sources.base import Source
from wardloom.tables import KeyedTable


def read_landed(spark: SparkSession, path: str, max_files: int = 1_000) -> DataFrame:
    """Payload files of a folder as a stream, one row per file with its path; at most ``max_files`` a batch."""
    return (
        spark.readStream.format("text")
        .option("wholetext", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(path)
        .select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("file"))
    )


def progress(documents: DataFrame, chunks: DataFrame, batch_id: int, path: str) -> None:
    """Counts of one batch by source and in total: the documents that came, the chunks that were written of them.

    Chunks are counted where they are stored, from two narrow columns, so no document is chunked again.
    """
    ingest_summary(documents, chunks).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("source string, is_total boolean, documents long, chunks long, batch_id long").parquet(path)


def quarantine(rejected: DataFrame, batch_id: int, path: str) -> None:
    """What of one batch gave no document."""
    rejected.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("source string, payload string, batch_id long").parquet(path)


def ingest_source(
    landed: DataFrame,
    source: Source,
    kb: KeyedTable,
    checkpoint: str,
    progress_path: str | None = None,
    quarantine_path: str | None = None,
    fn: EmbedFn | None = None,
) -> StreamingQuery:
    """Ingest landed payloads of a source. A payload is parsed once, for its documents and for what it leaves out."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        # kept on disk: a batch is as large as its files, and the memory is the upsert's
        parsed = source.parsed(batch).persist(StorageLevel.DISK_ONLY)
        try:
            documents = source.good(parsed)
            number = kb.upsert(knowledge_rows(single_version(documents), fn))
            if progress_path:
                progress(documents, kb.written(number), batch_id, progress_path)
            if quarantine_path:
                quarantine(source.bad(parsed), batch_id, quarantine_path)
        finally:
            parsed.unpersist()

    return (
        landed.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_documents(
    landed: DataFrame,
    to_documents: Callable[[DataFrame], DataFrame],
    kb: KeyedTable,
    checkpoint: str,
    progress_path: str | None = None,
    fn: EmbedFn | None = None,
) -> StreamingQuery:
    """Start ingesting what has landed: normalise, chunk, tag, embed, upsert. Ends when all is in."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        documents = to_documents(batch).persist()
        try:
            number = kb.upsert(knowledge_rows(single_version(documents), fn))
            if progress_path:
                progress(documents, kb.written(number), batch_id, progress_path)
        finally:
            documents.unpersist()

    return (
        landed.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _newest(key: tuple, versions: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of one document's versions the latest, unless a later one was seen before. Only the best so far is held."""
    best = None
    for part in versions:
        top = part.sort_values(["day", "hash"], kind="stable").iloc[[-1]]
        if best is None or tuple(top[["day", "hash"]].iloc[0]) > tuple(best[["day", "hash"]].iloc[0]):
            best = top
    day = best["day"].iloc[0]
    if not state.exists or day >= state.get[0]:
        state.update((day,))
        yield best[["document"]]


def newest_versions(documents: DataFrame) -> DataFrame:
    """Of a stream of documents those that no later version has come before, one per document and micro-batch.

    The version is the publication date; a document without one is older than any with one. Of equal dates the one of
    the later batch counts, within a batch that of the greater hash. The state is one date per (source, source_id).
    """
    keyed = documents.select(
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("source_id", F.lit("")).alias("source_id"),
        F.coalesce(F.col("metadata.publication_date").cast("string"), F.lit("")).alias("day"),
        F.xxhash64("title", "content", "content_type", F.to_json("metadata")).alias("hash"),
        F.to_json(F.struct(*DOCUMENT.names)).alias("document"),
    )
    kept = keyed.groupBy("source", "source_id").applyInPandasWithState(
        _newest, "document string", "day string", "update", GroupStateTimeout.NoTimeout
    )
    return kept.select(F.from_json("document", DOCUMENT).alias("d")).select("d.*")


def ingest_versions(
    landed: DataFrame,
    to_documents: Callable[[DataFrame], DataFrame],
    kb: KeyedTable,
    checkpoint: str,
    progress_path: str | None = None,
    fn: EmbedFn | None = None,
) -> StreamingQuery:
    """Ingest documents that land in any order of their versions: an older one that comes late changes nothing.

    Which versions were seen is the query's state, so it goes with its checkpoint.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        # the state is read once: what passed it is used twice
        documents = batch.persist()
        try:
            number = kb.upsert(knowledge_rows(documents, fn))
            if progress_path:
                progress(documents, kb.written(number), batch_id, progress_path)
        finally:
            documents.unpersist()

    return (
        newest_versions(to_documents(landed)).writeStream.foreachBatch(one_batch)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_ingest(
    spark: SparkSession,
    in_dir: str,
    source: str,
    kb: KeyedTable,
    checkpoint: str,
    progress_path: str | None = None,
    fn: EmbedFn | None = None,
    quarantine_path: str | None = None,
    max_files: int = 1_000,
) -> StreamingQuery:
    """Ingest the payload files of one source."""
    landed = read_landed(spark, in_dir, max_files)
    return ingest_source(landed, registry.source(source), kb, checkpoint, progress_path, quarantine_path, fn)
