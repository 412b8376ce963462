"""Source plug-ins by name, and operators over many sources."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardloom.functions.text import text_or_empty
from wardloom.reference_data import LIMIT_PER_SOURCE, RECENT_DAYS
from wardloom.sources.articles import CURATED, FULLTEXT, MEDRXIV, PUBMED, WEB
from wardloom.sources.base import Source
from wardloom.sources.drugs import DAILYMED, OPENFDA, RXNORM
from wardloom.sources.trials import TRIALS

_SOURCES: dict[str, Source] = {
    s.name: s
    for s in (PUBMED, OPENFDA, DAILYMED, RXNORM, MEDRXIV, TRIALS, CURATED, FULLTEXT, WEB)
}


def register_source(source: Source) -> None:
    """Add a source plug-in, or replace the one of that name."""
    _SOURCES[source.name] = source


def source_names() -> list[str]:
    return list(_SOURCES)


def get_source(name: str) -> Source | None:
    return _SOURCES.get(name)


def source(name: str) -> Source:
    return _SOURCES[name]


def normalize(landed: DataFrame, name: str, payload: str = "payload") -> DataFrame:
    return _SOURCES[name].normalize(landed, payload)


def rejected(landed: DataFrame, name: str, payload: str = "payload") -> DataFrame:
    return _SOURCES[name].rejected(landed, payload)


def normalize_all(landed: dict[str, DataFrame], payload: str = "payload") -> DataFrame:
    """Documents of several landed tables by source name. Unreadable payloads of one source add
    nothing and leave the other sources as they are."""
    return union_documents(*[normalize(df, name, payload) for name, df in landed.items()])


def union_documents(*documents: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), documents)


def filter_sources(documents: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Rows of the named sources; names that do not occur are ignored, ``None`` keeps all."""
    return documents if names is None else documents.where(F.col("source").isin(list(names)))


def limit_per_source(
    documents: DataFrame,
    n: int = LIMIT_PER_SOURCE,
    order: Column | list[Column] | None = None,
    caps: Mapping[str, int] | None = None,
    salts: int = 32,
) -> DataFrame:
    """The first ``n`` rows of every source, fewer for a source that ``caps`` gives a lower cap.

    Two rank limits: first inside each salt of a source, which spreads one large source over many
    tasks, then over the at most ``salts * n`` rows left of it. Both are also cut before their shuffle.
    """
    keys = [F.col("source_id")] if order is None else order if isinstance(order, list) else [order]
    salted = documents.withColumn("_salt", F.pmod(F.xxhash64("source", "source_id"), F.lit(salts)))
    capped = {name: cap for name, cap in (caps or {}).items() if cap < n}
    own_cap = F.lit(True)
    for name, cap in capped.items():
        own_cap = own_cap & ((F.col("source") != name) | (F.col("_rank") <= cap))
    in_salt = Window.partitionBy("source", "_salt").orderBy(*keys)
    in_source = Window.partitionBy("source").orderBy(*keys)
    return (
        salted.withColumn("_rank", F.row_number().over(in_salt))
        .where(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(in_source))
        .where(F.col("_rank") <= n)
        .where(own_cap)
        .drop("_salt", "_rank")
    )


def match_any_term(
    documents: DataFrame, query: str, limit: int = LIMIT_PER_SOURCE, feed_order: Column | None = None
) -> DataFrame:
    """Documents whose title or content holds any word of the query, the first ``limit`` in feed order."""
    terms = query.lower().split()
    # terms hold no white space, so none can match across the line break
    text = F.lower(F.concat(text_or_empty(F.col("title")), F.lit("\n"), text_or_empty(F.col("content"))))
    hit = text.rlike("|".join(re.escape(t) for t in terms)) if terms else F.lit(False)
    order = feed_order if feed_order is not None else F.col("source_id")
    return documents.where(hit).orderBy(order).limit(limit)


def recent(documents: DataFrame, as_of: date, days: int = RECENT_DAYS) -> DataFrame:
    """Documents published in the last ``days`` days up to and with ``as_of``."""
    published = F.col("metadata.publication_date")
    return documents.where(published.between(F.lit(as_of - timedelta(days=days)), F.lit(as_of)))


def get_document(documents: DataFrame, source: str, source_id: str) -> DataFrame:
    """The document of that key; no row when there is none."""
    return documents.where((F.col("source") == source) & (F.col("source_id") == source_id)).limit(1)
