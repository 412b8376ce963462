"""Embedding (V1, U3): a plugged batch model, or the built-in hashed term weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, CountVectorizerModel, IDFModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.reference_data import EMBEDDING_WIDTH

EmbedFn = Callable[[list[str]], np.ndarray]


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def place(term: Column, width: int) -> Column:
    """Where a term counts: the first 32 bits of its MD5 digest modulo ``width``, which any SQL engine can recompute."""
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % width


def _counts(df: DataFrame, text: str, width: int) -> DataFrame:
    counting = CountVectorizerModel.from_vocabulary([str(i) for i in range(width)], inputCol="_places", outputCol="_counts")
    places = F.transform(terms(F.coalesce(F.col(text), F.lit(""))), lambda t: place(t, width).cast("string"))
    return counting.transform(df.withColumn("_places", places)).drop("_places")


def fit_idf(df: DataFrame, text: str = "text", width: int = EMBEDDING_WIDTH) -> IDFModel:
    """Inverse document frequencies of a corpus: one pass, ``width`` sums in all."""
    return IDF(inputCol="_counts", outputCol="_weights").fit(_counts(df, text, width))


def stored_idf(df: DataFrame, path: str, text: str = "text", width: int = EMBEDDING_WIDTH) -> IDFModel:
    """Frequencies fitted on ``df`` and kept at ``path``, from where ``IDFModel.load`` gives them to later chunks and queries.

    Chunks and queries are comparable only under the same frequencies, so a path that is taken is an error.
    """
    fit_idf(df, text, width).save(path)
    return IDFModel.load(path)


def embed(
    df: DataFrame,
    fn: EmbedFn | None = None,
    text: str = "text",
    width: int = EMBEDDING_WIDTH,
    idf: IDFModel | None = None,
    batch: int = 256,
) -> DataFrame:
    """Add an ``embedding`` column.

    ``fn`` maps a list of texts to a matrix with one row per text and is called on batches inside the
    tasks. Without it the embedding is the hashed term counts, weighted by ``idf`` if given, as a unit
    vector; a null text, or one without a weighted term, is zeros. Queries and chunks must go through the same call.
    """
    if fn is None:
        counted = _counts(df, text, width)
        weighted = idf.transform(counted) if idf is not None else counted.withColumnRenamed("_counts", "_weights")
        scaled = Normalizer(inputCol="_weights", outputCol="_unit").transform(weighted)
        return scaled.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_counts", "_weights", "_unit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            vectors: list[np.ndarray] = []
            for start in range(0, len(rows), batch):
                part = rows[text].iloc[start : start + batch].tolist()
                vectors.extend(np.asarray(fn(part), dtype=np.float32))
            yield rows.assign(embedding=vectors)

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{names}, embedding array<float>")


