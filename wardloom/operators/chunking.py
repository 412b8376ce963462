"""Chunking (C1-C5): documents in, chunks out, as one narrow projection per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.functions.text import string_array, strip
from wardloom.reference_data import (
    CHUNK_OVERLAP,
    CHUNK_SIZE,
    DRUG_LABEL_HEADERS,
    TRIAL_HEADERS,
)

_FOLD_STATE = "struct<done array<string>, open array<string>, length int>"
_BLOCK_STATE = "struct<done array<array<string>>, open array<string>, length int>"
PARAGRAPHS = 256  # paragraphs folded before what they closed is put aside


def split_sections(content: Column, headers: list[str]) -> Column:
    """Pieces that start at header lines; text before the first header is a piece of its own if not blank.

    A header fills its whole line. A blank line follows it in the piece. Without any header the content
    is one piece.
    """
    names = "|".join(headers)
    pieces = F.split(content, rf"(?md)(?=^(?:{names})$)")
    spaced = F.transform(pieces, lambda p: F.regexp_replace(p, rf"(?md)\A({names})$", "$1\n"))
    kept = F.filter(spaced, lambda p: strip(p) != "")
    return F.when(F.size(kept) > 0, kept).otherwise(string_array(content))


def split_by_size(content: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Paragraphs packed up to ``size`` characters; a paragraph is never cut.

    When the next paragraph would pass the size, the open paragraphs are closed as a chunk and the last
    of them are carried on while their total stays within ``overlap``. Only paragraph characters count.

    A fold copies what it has closed at every step, so paragraphs are folded in blocks: each starts with the
    paragraphs still open and puts its closed chunks aside, which keeps the time in proportion to the document.
    """
    paragraphs = F.filter(F.transform(F.split(content, "\n\n+"), strip), lambda p: p != "")

    def joined(open_: Column) -> Column:
        return F.array_join(open_, "\n\n")

    def total(open_: Column) -> Column:
        return F.aggregate(open_, F.lit(0), lambda n, p: n + F.length(p))

    def tail(open_: Column) -> Column:
        # paragraphs are not empty, so the totals from the end only grow and the longest tail that
        # fits is the one reached by going back while it fits
        return F.filter(
            open_, lambda _, i: total(F.slice(open_, i + 1, F.size(open_))) <= overlap
        )

    def add(state: Column, paragraph: Column) -> Column:
        n = F.length(paragraph)
        full = (state["length"] + n > size) & (F.size(state["open"]) > 0)
        grown = F.struct(
            state["done"].alias("done"),
            F.concat(state["open"], F.array(paragraph)).alias("open"),
            (state["length"] + n).alias("length"),
        )
        kept = tail(state["open"])
        closed = F.struct(
            F.concat(state["done"], F.array(joined(state["open"]))).alias("done"),
            F.concat(kept, F.array(paragraph)).alias("open"),
            (total(kept) + n).alias("length"),
        )
        return F.when(full, closed).otherwise(grown)

    def add_block(state: Column, block: Column) -> Column:
        begin = F.struct(string_array().alias("done"), state["open"].alias("open"), state["length"].alias("length")).cast(_FOLD_STATE)
        folded = F.aggregate(block, begin, add)
        # bound to a variable: it is read three times and made once
        return F.transform(
            F.array(folded),
            lambda made: F.struct(
                F.concat(state["done"], F.array(made["done"])).alias("done"), made["open"].alias("open"), made["length"].alias("length")
            ),
        )[0]

    def finish(state: Column) -> Column:
        last = F.concat(F.flatten(state["done"]), F.array(joined(state["open"])))
        return F.when(F.size(state["open"]) > 0, last).otherwise(string_array(content))

    def folded(every: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.greatest(F.size(every), F.lit(1)) - 1) / PARAGRAPHS).cast("int")),
            lambda i: F.slice(every, i * PARAGRAPHS + 1, PARAGRAPHS),
        )
        start = F.struct(F.array().alias("done"), string_array().alias("open"), F.lit(0).alias("length")).cast(_BLOCK_STATE)
        return F.aggregate(blocks, start, add_block, finish)

    return F.transform(F.array(paragraphs), folded)[0]


def chunk_texts(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunk texts of a document row, by its content type."""
    kind, content = F.col("content_type"), F.col("content")
    return (
        F.when(kind == "abstract", string_array(content))
        .when(kind == "drug_label", split_sections(content, DRUG_LABEL_HEADERS))
        .when(kind == "trial_protocol", split_sections(content, TRIAL_HEADERS))
        .otherwise(split_by_size(content, size, overlap))
    )


def document_key(source: Column, source_id: Column) -> Column:
    return F.concat(source, F.lit(":"), source_id)


def chunk_id(source: Column, source_id: Column, position: Column) -> Column:
    return F.sha2(F.concat(document_key(source, source_id), F.lit(":"), position.cast("string")), 256)


def chunk(documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of every document. Positions count all pieces, blank pieces are then left out."""
    pieces = documents.select(
        "source", "source_id", "metadata", F.posexplode(chunk_texts(size, overlap)).alias("position", "piece")
    )
    return (
        pieces.withColumn("text", strip(F.col("piece")))
        .where(F.col("text") != "")
        .select(
            chunk_id(F.col("source"), F.col("source_id"), F.col("position")).alias("chunk_id"),
            document_key(F.col("source"), F.col("source_id")).alias("source_document_id"),
            "text",
            "position",
            "metadata",
        )
    )
