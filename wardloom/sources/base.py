"""What all landed sources share: a payload column in, documents out.

A landed table has one row per stored API answer with its text in ``payload``. Every source turns
such a table into the ``documents`` schema with column expressions. Rows whose payload cannot be read
give no documents, nor do records inside a payload that cannot be dated; ``rejected`` returns both, so a job
can quarantine them. ``parsed`` is the parsed table that both are taken from, for jobs that keep it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.functions.text import strings, text_or_empty
from wardloom.schemas import DOCUMENT

BAD = "_corrupt_record"
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}


def parsed_json(payload: Column, ddl: str) -> Column:
    return F.from_json(payload, f"{ddl}, {BAD} string", _OPTIONS)


def parsed_xml(payload: Column, ddl: str) -> Column:
    return F.from_xml(payload, f"{ddl}, {BAD} string", {**_OPTIONS, "ignoreSurroundingSpaces": "false"})


def readable(parsed: Column) -> Column:
    return parsed.isNotNull() & parsed[BAD].isNull()


@dataclass(frozen=True)
class Source:
    """One source plug-in.

    ``parse`` gives the parsed form of the payload column, ``documents`` the normalised rows of a
    table holding it in ``parsed``. ``left_out`` gives, of such a table, the records that ``documents`` leaves out, as
    texts in ``payload``. ``keys`` are columns that a landed table has beside the payload; absent ones are null.
    """

    name: str
    parse: Callable[[Column], Column]
    documents: Callable[[DataFrame], DataFrame]
    left_out: Callable[[DataFrame], DataFrame] | None = None
    keys: tuple[str, ...] = ()

    def parsed(self, landed: DataFrame, payload: str = "payload") -> DataFrame:
        for key in self.keys:
            if key not in landed.columns:
                landed = landed.withColumn(key, F.lit(None).cast("string"))
        return landed.withColumn("parsed", self.parse(F.col(payload)))

    def good(self, parsed: DataFrame) -> DataFrame:
        """Documents of a parsed table."""
        return conform(self.documents(parsed.where(readable(F.col("parsed")))))

    def bad(self, parsed: DataFrame, payload: str = "payload") -> DataFrame:
        """What of a parsed table gives no document: ``source, payload``."""
        rows = parsed.where(~F.coalesce(readable(F.col("parsed")), F.lit(False))).select(F.col(payload).alias("payload"))
        if self.left_out is not None:
            rows = rows.union(self.left_out(parsed.where(readable(F.col("parsed")))).select("payload"))
        return rows.select(F.lit(self.name).alias("source"), "payload")

    def normalize(self, landed: DataFrame, payload: str = "payload") -> DataFrame:
        return self.good(self.parsed(landed, payload))

    def rejected(self, landed: DataFrame, payload: str = "payload") -> DataFrame:
        return self.bad(self.parsed(landed, payload), payload)


def document(
    source: str,
    source_id: Column,
    title: Column,
    content: Column,
    content_type: str,
    credibility: Column | str,
    authors: Column | None = None,
    publication_date: Column | None = None,
    specialty: Column | None = None,
    url: Column | None = None,
    doi: Column | None = None,
) -> list[Column]:
    """The columns of one normalised document."""
    empty = F.array().cast("array<string>")
    rank = F.lit(credibility) if isinstance(credibility, str) else credibility
    metadata = F.struct(
        (strings(authors) if authors is not None else empty).alias("authors"),
        (publication_date if publication_date is not None else F.lit(None)).cast("date").alias("publication_date"),
        (strings(specialty) if specialty is not None else empty).alias("specialty"),
        rank.alias("credibility"),
        (url if url is not None else F.lit(None)).cast("string").alias("url"),
        (doi if doi is not None else F.lit(None)).cast("string").alias("doi"),
    )
    return [
        F.lit(source).alias("source"),
        text_or_empty(source_id).alias("source_id"),
        text_or_empty(title).alias("title"),
        text_or_empty(content).alias("content"),
        F.lit(content_type).alias("content_type"),
        metadata.alias("metadata"),
    ]


def conform(documents: DataFrame) -> DataFrame:
    """Check a documents table against the schema and put its columns in order."""
    wanted = {f.name: f.dataType.simpleString() for f in DOCUMENT.fields}
    found = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    wrong = {name: found.get(name) for name, kind in wanted.items() if found.get(name) != kind}
    if wrong:
        raise ValueError(f"not a documents table, wrong or missing columns: {wrong}")
    return documents.select(*wanted)
