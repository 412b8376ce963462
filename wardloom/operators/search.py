"""Vector search, credibility re-rank and retrieval text (V2-V9)."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardloom.functions.text import string_array, text_or_empty
from wardloom.operators.embedding import EmbedFn, embed
from wardloom.reference_data import (
    CONTEXT_SEPARATOR,
    CREDIBILITY_RANK,
    DEFAULT_CREDIBILITY,
    RETRIEVE_LIMIT,
    SEARCH_LIMIT,
    UNKNOWN_CREDIBILITY_RANK,
)

# chunks and queries that meet in one group of a task, at least
CHUNK_BLOCK, QUERY_BLOCK = 16_384, 4_096
# a block grows with the rows, so that they make this many blocks, up to as many vector components as a task holds well
BLOCKS, BLOCK_CELLS = 8, 1 << 22
# scores held at once by a task
SCORE_CELLS = 4_000_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two float arrays, in double precision; 0 for a zero vector."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def search(
    kb: DataFrame, query: Iterable[float], n: int = SEARCH_LIMIT, source: str | None = None
) -> DataFrame:
    """The ``n`` chunks nearest to one query vector, best first, with their score.

    Every task keeps its own best ``n``; only those meet for the final order.
    """
    rows = kb.where(F.col("source") == source) if source else kb
    vector = np.asarray(list(query), dtype=np.float64)
    length = float(np.sqrt(vector @ vector))
    wanted = F.lit((vector / length if length > 0 else vector).tolist())
    embedding = F.col("embedding")
    dot = F.aggregate(
        F.zip_with(embedding, wanted, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p
    )
    norm = F.sqrt(
        F.aggregate(embedding, F.lit(0.0), lambda s, p: s + p.cast("double") * p.cast("double"))
    )
    score = F.when(norm > 0, dot / norm).otherwise(F.lit(0.0))
    return rows.withColumn("score", score).drop("embedding").orderBy(F.desc("score"), "chunk_id").limit(n)


def unsearchable(rows: DataFrame) -> DataFrame:
    """Rows whose vector is null, empty or holds nulls; searches leave them out."""
    return rows.where(~searchable())


def searchable() -> Column:
    whole = F.forall("embedding", lambda x: x.isNotNull())
    return F.coalesce((F.size("embedding") > 0) & whole, F.lit(False))


def unit_vectors(column) -> np.ndarray:
    """Rows of a list column at length one; zero vectors stay."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    matrix = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms > 0, norms, 1.0)


def _best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest scores, of equal ones the first."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= cut)
    else:
        places = np.arange(len(scores))
    return places[np.argsort(-scores[places], kind="stable")[:k]]


def _block_scores(asked: np.ndarray, held: np.ndarray, lists: list | None, places: dict[int, np.ndarray]) -> np.ndarray:
    """Scores of queries and chunks; with ``lists``, those each query names alone, the others minus infinity."""
    if lists is None:
        return asked @ held.T
    scores = np.full((len(asked), len(held)), -np.inf)
    naming: dict[int, list[int]] = {}
    for q, named_ in enumerate(lists):
        for item in named_:
            naming.setdefault(item, []).append(q)
    for item, rows in naming.items():
        if item in places:
            scores[np.ix_(rows, places[item])] = asked[rows] @ held[places[item]].T
    return scores


def _meeting(k: int):
    """The best ``k`` chunks of a group for each of its queries; of the lists a query names, where it names some."""

    def run(queries: pa.Table, chunks: pa.Table) -> pa.Table:
        query_ids, chunk_ids, scores = [], [], []
        if queries.num_rows and chunks.num_rows:
            chunks = chunks.sort_by("chunk_id")  # ties go to the smaller id
            asked, held = unit_vectors(queries.column("embedding")), unit_vectors(chunks.column("embedding"))
            names = np.asarray(chunks.column("chunk_id").to_pylist(), dtype=object)
            step = max(1, SCORE_CELLS // len(held))
            ids = queries.column("query_id").to_pylist()
            lists, places = None, {}
            if "lists" in queries.column_names:
                lists, of = queries.column("lists").to_pylist(), chunks.column("list").to_numpy()
                places = {int(item): np.flatnonzero(of == item) for item in np.unique(of)}
            for start in range(0, len(asked), step):
                block = _block_scores(asked[start : start + step], held, lists and lists[start : start + step], places)
                for q, row in enumerate(block, start):
                    best = _best_of(row, k)
                    best = best[row[best] > -np.inf] if lists else best
                    query_ids.extend([ids[q]] * len(best))
                    chunk_ids.extend(names[best].tolist())
                    scores.extend(row[best].tolist())
        columns = {"query_id": query_ids, "chunk_id": chunk_ids}
        return pa.table({n: pa.array(v, pa.string()) for n, v in columns.items()} | {"score": pa.array(scores, pa.float64())})

    return run


def block_counts(rows: DataFrame, least: int, name: str, keys: list[str]) -> DataFrame:
    """How many blocks the rows of each code and width make. Every row travels once per block of the other side, so blocks are
    as large as a task holds as soon as there are enough of them for all tasks."""
    held = (F.lit(BLOCK_CELLS) / F.greatest(F.lit(1), F.col("width"))).cast("long")
    size = F.greatest(F.lit(least), F.least(held, F.ceil(F.count("*") / BLOCKS)))
    return rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))


def best_of_codes(
    chunks: DataFrame, queries: DataFrame, k: int, chunk_block: int = CHUNK_BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the best ``k`` per query where ``code`` and the width of the vectors are equal.

    Each side is cut into blocks by hash, as many as a code's rows need, and every two blocks of a code meet in a
    group of their own; groups are dealt to tasks, and of a group only the best of each query go on. Both sides
    are read once however many queries there are. A code held by many rows is only more groups. Where queries have ``lists``
    and chunks a ``list``, a query is scored with the chunks of its lists alone.
    """
    keys = ["width", "code"]
    named_lists = "lists" in queries.columns
    chunks = chunks.where(searchable()).withColumn("width", F.size("embedding"))
    queries = queries.where(searchable()).withColumn("width", F.size("embedding"))

    # a row per code and width, and codes are the lists of an index: at most vector_index.LISTS
    c_blocks, q_blocks = block_counts(chunks, chunk_block, "c_blocks", keys), block_counts(queries, query_block, "q_blocks", keys)
    sizes = F.broadcast(c_blocks.join(q_blocks, keys))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    met_chunks = chunks.join(sizes, keys).withColumn("c", F.pmod(F.xxhash64("chunk_id"), F.col("c_blocks"))).withColumn("q", every("q_blocks"))
    met_queries = queries.join(sizes, keys).withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("q_blocks"))).withColumn("c", every("c_blocks"))
    group = [*keys, F.col("q").cast("long"), F.col("c").cast("long")]
    found = (
        met_queries.select("query_id", "embedding", *["lists"] * named_lists, *keys, "q", "c").groupBy(*group)
        .cogroup(met_chunks.select("chunk_id", "embedding", *["list"] * named_lists, *keys, "q", "c").groupBy(*group))
        .applyInArrow(_meeting(k), "query_id string, chunk_id string, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def named(queries: DataFrame) -> DataFrame:
    # a column of its own, also where the chunks themselves are the queries
    return queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("embedding").alias("embedding"))


def search_many(
    kb: DataFrame, queries: DataFrame, k: int = SEARCH_LIMIT, block: int = QUERY_BLOCK, chunk_block: int = CHUNK_BLOCK
) -> DataFrame:
    """Exact top ``k`` for every row of ``queries`` (query_id, embedding); ``chunk_id`` is the key of ``kb``.

    Blocks of queries meet blocks of chunks and are scored as matrix products. Vectors that are null or hold
    nulls find nothing and are not found; vectors of another width do not meet.
    """
    one = F.lit(0)
    chunks = kb.select("chunk_id", "embedding", one.alias("code"))
    best = best_of_codes(chunks, named(queries).withColumn("code", one), k, chunk_block, block)
    # what else the chunks have is fetched for the winners alone
    return kb.drop("embedding").join(best, "chunk_id")


def search_text(
    kb: DataFrame, queries: DataFrame, k: int = SEARCH_LIMIT, fn: EmbedFn | None = None, text: str = "text"
) -> DataFrame:
    """The same for query texts (query_id, text), embedded as the chunks were."""
    return search_many(kb, embed(queries.select("query_id", text), fn, text), k)


# --- re-rank and retrieval text --------------------------------------------------


def credibility_rank(credibility: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in CREDIBILITY_RANK.items() for x in pair])
    return F.coalesce(ranks[credibility], F.lit(UNKNOWN_CREDIBILITY_RANK))


def rerank(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Hits with their place by credibility, then score. Hits are at most the search limit per query."""
    level = F.coalesce("credibility", F.lit(DEFAULT_CREDIBILITY))
    scored = hits.withColumn("credibility", level).withColumn("credibility_rank", credibility_rank(level))
    order = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy(
        "credibility_rank", F.desc("score"), "chunk_id"
    )
    return scored.withColumn("place", F.row_number().over(order))


_HIT = ("source_document_id", "source", "specialty", "doi", "url")


def _hit_columns(hits: DataFrame) -> DataFrame:
    for name in _HIT:
        hits = hits.withColumn(name, text_or_empty(F.col(name)))
    return hits


def retrieve(kb: DataFrame, topic_vector: Iterable[float], limit: int = RETRIEVE_LIMIT) -> DataFrame:
    """The nearest chunks of a topic, re-ranked by credibility. Cut to ``limit`` before the re-rank."""
    hits = rerank(search(kb, topic_vector, limit))
    return _hit_columns(hits).select(
        "place", "chunk_id", "text", "score", "credibility", "credibility_rank", *_HIT
    )


def retrieve_many(kb: DataFrame, topics: DataFrame, limit: int = RETRIEVE_LIMIT) -> DataFrame:
    """The same for every row of ``topics`` (topic, embedding)."""
    hits = search_many(kb, topics.select(F.col("topic").alias("query_id"), "embedding"), limit)
    ranked = rerank(hits.withColumnRenamed("query_id", "topic"), by=("topic",))
    return _hit_columns(ranked).select(
        "topic", "place", "chunk_id", "text", "score", "credibility", "credibility_rank", *_HIT
    )


def _section() -> Column:
    return F.concat(
        F.lit("[Source "), F.col("place").cast("string"), F.lit("] ("), F.col("credibility"), F.lit(", "),
        F.col("source"), F.lit(")\n"), F.col("text"),
    )


def _reference() -> Column:
    return F.struct(
        F.col("source").alias("type"),
        F.col("source_document_id").alias("reference"),
        string_array(F.col("chunk_id")).alias("chunk_ids"),
    )


def contexts(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Context text and source references of each group of re-ranked hits, in retrieval order.

    A group holds at most the search limit.
    """
    item = F.struct("place", _section().alias("section"), _reference().alias("reference"))
    listed = hits.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return listed.select(
        *by,
        F.array_join(F.transform("_items", lambda x: x["section"]), CONTEXT_SEPARATOR).alias("context"),
        F.transform("_items", lambda x: x["reference"]).alias("sources"),
    )


def format_context(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One context text per group of re-ranked hits."""
    return contexts(hits, by).select(*by, "context")


def source_refs(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One list of source references per group of re-ranked hits."""
    return contexts(hits, by).select(*by, "sources")
