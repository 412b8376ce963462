"""Ordinal quality classifier: one set of hashed text weights, ordered thresholds.

``P(grade >= j) = sigmoid(score - t_j)`` with ``t_1 < t_2 < ...``: all grades share the weights, and a threshold says how
much it takes to pass. The expected grade is the sum of these tail probabilities.

A text's features are its distinct words, how its words begin and end, and how much it repeats itself, each hashed
to one of ``2 ** BITS`` weights; beginnings let the forms of one stem share a weight. The fit takes a sample of rated documents of bounded size (``SAMPLE``); every document is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.llm.text import mix, pieces, word_hashes
from wardloom.llm.work import saved, take

BITS = 18
SAMPLE = 8_192  # rated documents that the fit uses, at most about
STEPS, RATE = 300, 0.05
PENALTY, SPARSE = 2e-4, 6e-4  # on squares and on absolute weights


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, feature, value`` of all texts."""
    words, at, endings, beginnings = word_hashes(column, endings=True, beginnings=True)
    n = len(column)
    row = np.repeat(np.arange(n), np.diff(at))
    ending = mix(endings.astype(np.uint64) + np.uint64(1 << 32))
    word_rows, word_keys, times = _distinct(row, words)
    stem_rows, stem_keys, _ = _distinct(row, mix(beginnings.astype(np.uint64) + np.uint64(1 << 33)))
    end_rows, end_keys, end_times = _distinct(row, ending)
    size = np.diff(at)
    different = np.bincount(word_rows, minlength=n)
    share = np.floor(10 * different / np.maximum(size, 1)).astype(np.uint64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, word_rows, times)
    peak = np.floor(20 * most / np.maximum(size, 1)).astype(np.uint64)
    length = np.floor(np.log2(size + 1)).astype(np.uint64)
    whole = np.concatenate([mix(share + np.uint64(1 << 40)), mix(peak + np.uint64(1 << 41)), mix(length + np.uint64(1 << 42)), mix((share << np.uint64(8)) + length + np.uint64(1 << 43))])
    rows = np.concatenate([word_rows, stem_rows, end_rows, np.tile(np.arange(n), 4)])
    keys = np.concatenate([word_keys, stem_keys, end_keys, whole]) >> np.uint64(64 - BITS)
    # how often a word comes says little, which endings prevail says much
    values = np.concatenate([np.ones(len(word_rows)), np.full(len(stem_rows), 2.0), 4 * end_times / np.maximum(size[end_rows], 1) ** 0.5, np.full(4 * n, 2.0)])
    return rows, keys.astype(np.int64), values


def _distinct(row, key):
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(fresh)
    return row[first], key[first], np.diff(np.append(first, len(row)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def thresholds(raw: np.ndarray) -> np.ndarray:
    """Rising thresholds from free numbers: the first, then logarithms of the gaps."""
    return np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def fit(sizes: np.ndarray, keys: np.ndarray, values: np.ndarray, grades: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds for grades 0 to ``top``, by the likelihood of the grades with a penalty on the weights.

    The penalty on absolute weights leaves them to the features that tell grades apart in many documents.

    Features come document after document, ``sizes`` (one at least) of each.
    """
    n = len(grades)
    starts = np.cumsum(sizes) - sizes
    w, raw = np.zeros(1 << BITS), np.concatenate([[-1.0], np.zeros(top - 1)])
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(raw), np.zeros_like(raw)]
    for step in range(1, STEPS + 1):
        t = thresholds(raw)
        score = np.add.reduceat(values * w.astype(np.float32)[keys], starts)
        # cumulative probabilities from 1 (grade >= 0) to 0 (grade > top); a grade has the difference of two
        tails = np.column_stack([np.ones(n), _sigmoid(score[:, None] - t), np.zeros(n)])
        slopes = tails * (1 - tails)
        at = np.arange(n)
        p = np.maximum(tails[at, grades] - tails[at, grades + 1], 1e-9)
        d_score = -(slopes[at, grades] - slopes[at, grades + 1]) / p / n
        d_t = np.zeros(top + 2)
        np.add.at(d_t, grades, slopes[at, grades] / p / n)
        np.add.at(d_t, grades + 1, -slopes[at, grades + 1] / p / n)
        d_t = d_t[1 : top + 1]
        d_raw = np.concatenate([[d_t.sum()], np.exp(raw[1:]) * np.cumsum(d_t[::-1])[::-1][1:]])
        d_w = np.bincount(keys, values * np.repeat(d_score.astype(np.float32), sizes), len(w)) + PENALTY * w + SPARSE * np.sign(w)
        rate = RATE * min(1.0, 2 - 2 * step / (STEPS + 1))
        for k, (x, d) in enumerate(((w, d_w), (raw, d_raw))):
            m, s = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (d - m)
            s += 0.01 * (d * d - s)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return w, thresholds(raw)


def fit_on(docs: DataFrame, ratings: DataFrame, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The classifier fitted on documents with a grade; at most about ``SAMPLE`` of them, chosen by a hash of the id."""
    rated = take(ratings, doc_id="long", grade="int").where(F.col("doc_id").isNotNull() & F.col("grade").between(0, top))
    rated = rated.groupBy("doc_id").agg(F.min("grade").alias("grade"))  # of unlike grades the lowest counts
    count = rated.count()
    if count > SAMPLE:
        rated = rated.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * SAMPLE / count))
    listed = rated.toArrow()
    ids = listed.column("doc_id").to_numpy()
    order = np.argsort(ids)
    ids, grades = ids[order], listed.column("grade").to_numpy()[order]

    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("doc_id")))
            own = batch.column("doc_id").to_numpy()
            place = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
            found = ids[place] == own if len(ids) else np.zeros(len(own), bool)
            if not found.any():
                continue
            rated_rows = batch.append_column("grade", pa.array(grades[place].astype(np.int32))).filter(pa.array(found))
            for chosen in pieces(rated_rows):
                rows, keys, values = features(chosen.column("text"))
                order = np.argsort(rows, kind="stable")
                cuts = np.searchsorted(rows[order], np.arange(chosen.num_rows + 1))
                keys, values = keys[order].astype(np.int32), values[order].astype(np.float32)
                yield pa.record_batch(
                    [chosen.column("doc_id"), chosen.column("grade"),
                     *[pa.array([x[s:e].tobytes() for s, e in zip(cuts[:-1], cuts[1:])], pa.binary()) for x in (keys, values)]],
                    ["doc_id", "grade", "keys", "values"],
                )

    sample = docs.mapInArrow(run, "doc_id long, grade int, keys binary, values binary")
    table = saved(sample.dropDuplicates(["doc_id"]), "rated-features").sort("doc_id").toArrow()
    if not table.num_rows:
        return np.zeros(1 << BITS), np.arange(top) - (top - 1) / 2
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int32).astype(np.int64)
    values = np.frombuffer(b"".join(table.column("values").to_pylist()), np.float32)
    sizes = pc.binary_length(table.column("keys")).to_numpy().astype(np.int64) // 4
    own_grades = table.column("grade").to_numpy().astype(np.int64)
    del table
    return fit(sizes, keys, values, own_grades, top)


def graded(docs: DataFrame, ratings: DataFrame, top: int, wanted: int, least: float = 0.5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id, expected_grade, tail_probability, selected``.

    ``ratings`` has ``doc_id, grade`` with grades 0 to ``top``; others and nulls are ignored. ``tail_probability`` is that of grade
    ``wanted`` or more; a document is selected if it is ``least`` or more. Other columns are ignored.

    A null or empty text has only the features of its length. Repeated rows are scored each time; in the fit a
    repeated id counts once. A null doc_id is scored and never used for the fit. Without ratings the scores are all
    zero and a grade is as probable as the even thresholds make it. An empty table gives an empty result.
    """
    docs = take(docs, doc_id="long", text="string")
    w, t = fit_on(docs, ratings, top)
    w = w.astype(np.float32)  # what travels to the tasks

    def run(batches):
        for piece in (p for batch in batches for p in pieces(batch)):
            tails = tail_probabilities(piece.column("text"), w, t)
            tail = tails[:, wanted - 1]
            yield pa.record_batch(
                [piece.column("doc_id"), pa.array(tails.sum(1)), pa.array(tail), pa.array(tail >= least)],
                ["doc_id", "expected_grade", "tail_probability", "selected"],
            )

    return docs.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, selected boolean")


def selected(docs: DataFrame, ratings: DataFrame, top: int, wanted: int, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``graded`` selects."""
    w, t = fit_on(take(docs, doc_id="long", text="string"), ratings, top)
    w = w.astype(np.float32)

    def run(batches):
        for piece in (p for batch in batches for p in pieces(batch)):
            yield piece.filter(pa.array(tail_probabilities(piece.column("text"), w, t)[:, wanted - 1] >= least))

    return docs.mapInArrow(run, docs.schema)


def tail_probabilities(column: pa.Array, w: np.ndarray, t: np.ndarray) -> np.ndarray:
    """``P(grade >= j)`` for j from 1 on, a row per text."""
    rows, keys, values = features(column)
    return _sigmoid(np.bincount(rows, values * w[keys], len(column))[:, None] - t)


def grades_of(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` of 0/1 labels: 0 poor, 1 good but toxic, 2 good."""
    good, toxic = F.coalesce(F.col("quality"), F.lit(0)), F.coalesce(F.col("toxic"), F.lit(0))
    grade = F.when(good == 0, 0).when(toxic != 0, 1).otherwise(2)
    return take(labels, doc_id="long", quality="int", toxic="int").select("doc_id", grade.alias("grade"))
