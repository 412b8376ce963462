import random

import numpy as np
import pytest

from tests.llm import brute
from wardloom.llm import shingle_join as join

SCHEMA = "doc_id long, text string"


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 20, 60, 150]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((n, " ".join(copy)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [3, 4])
def test_groups_are_those_of_all_pairs(spark, seed):
    rows = corpus(seed)
    got = result(join.similar_groups(spark.createDataFrame(rows, SCHEMA)))
    assert got == sorted(brute.jaccard_groups(rows), key=repr)


def test_nulls_blanks_repeats_and_clashing_columns(spark):
    long_text = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a  B"), (None, "a b"), (6, "a b c d e"), (6, "a b c d e"),
            (7, "other words in here now"), (7, "a b c d e"), (8, long_text), (9, long_text + " tail")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA + ", set_id string, signature int")
    assert result(join.similar_groups(df)) == sorted(brute.jaccard_groups(rows), key=repr)
    assert result(join.similar_groups(spark.createDataFrame([], SCHEMA))) == []


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for n in [5, 6, 7, 9, 14, 30, 77, 200, 900]:
        for _ in range(30):
            base = rng.integers(0, 2**63, n, dtype=np.uint64)
            drop = int(rng.integers(0, n // 9 + 1))
            other = np.concatenate([base[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64)])
            common, union = n - drop, n + drop
            if 100 * common >= 80 * union:
                a, b = (set(join.signatures(np.unique(x)).tolist()) for x in (base, other))
                assert a & b, (n, drop)


def test_large_buckets_are_compared_in_slices(spark, monkeypatch):
    rows = corpus(9)
    monkeypatch.setattr(join, "SLICE", 3)
    got = result(join.similar_groups(spark.createDataFrame(rows, SCHEMA)))
    assert got == sorted(brute.jaccard_groups(rows), key=repr)


def test_pairs_under_a_common_head_without_a_common_signature_there_meet_elsewhere(spark):
    """Sets 10 and 11 are both under head 1, by different signatures, and share one only under head 5."""
    held = [(1, 1, 1), (1, 10, 1), (2, 1, 1), (2, 11, 1), (9, 5, 5), (9, 10, 5), (9, 11, 5), (8, 5, 5), (8, 10, 5)]
    sets = {1: range(100, 200), 5: range(200, 300), 10: range(300, 400), 11: range(301, 401)}
    buckets = spark.createDataFrame([(s, x, h, x, 100) for s, x, h in held], "signature long, set_id long, head long, root long, n_shingles long")
    mixed = {x: (np.array(list(e), np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15) for x, e in sets.items()}
    reps = spark.createDataFrame([(x, bytearray(join.sketch(e).tobytes())) for x, e in mixed.items()], "set_id long, sketch binary")
    got = [tuple(r) for r in join._crossed(buckets, reps, 80).collect()]
    assert got == [(10, 11)]


def test_sketches_bound_the_difference_and_tell_long_sets_apart():
    rng = np.random.default_rng(8)
    sets, raw = [], []
    for n in (5, 100, 300, 900, 3000, 20_000):
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for drop in (0, n // 30, n // 10):
            sets.append(np.unique(np.concatenate([base[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64)])))
        sets.append(np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)))
    raw = [join.sketch(s).tobytes() for s in sets]
    left, right = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    found = join.Sketches(raw).unlike(left, right)
    for i, j, bits in zip(left.tolist(), right.tolist(), found.tolist()):
        assert bits <= len(np.setxor1d(sets[i], sets[j]))
        assert bits == join.unlike(raw[i], raw[j])
    for four in range(4, 20, 4):  # sets of 100 to 3000 elements that have nothing in common
        n = len(sets[four]) + len(sets[four + 3])
        assert join.unlike(raw[four], raw[four + 3]) * 180 > 20 * n


def test_signatures_leave_most_unrelated_sets_apart():
    """Sets with a fifth of their elements in common share hardly any of their signatures."""
    rng = np.random.default_rng(9)
    shared = 0
    for _ in range(50):
        both, one, two = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (67, 133, 133))  # similarity one fifth
        a, b = (set(join.signatures(np.unique(np.concatenate([both, x]))).tolist()) for x in (one, two))
        shared += len(a & b)
    assert shared < 50 * 4
