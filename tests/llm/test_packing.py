import zlib

import numpy as np
import pytest

from wardloom.llm import packing
from wardloom.llm.queries import encoder_args

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(*encoder_args())


def expected(encoder, text, capacity):
    ids = [*encoder.exact.encode(text or "", add_special_tokens=False).ids, 0]
    first = (len(ids) - 1) % capacity + 1
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(s, ids[s:e]) for s, e in zip(cuts, cuts[1:])]


def check(rows, packed, encoder, capacity):
    wanted = sorted(
        (str(d), k, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        for d, t in rows for k, (s, ids) in enumerate(expected(encoder, t, capacity))
    )
    got = packed.collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got) == wanted
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by_sequence


def test_pieces_and_sequences(spark, encoder):
    rows = [(i, "some words " * (i % 37) + "tail") for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "a<|endoftext|>b  <|endoftext|>"), (None, "no id"), (5, rows[5][1]), (5, rows[5][1]), (1003, "long words and more " * 900)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA + ", piece_id string, block int")
    packed = packing.pack(df, encoder_args(), capacity=64)
    packed.cache()
    found = check(rows, packed, encoder, 64)
    total = sum(r.length for r in packed.collect())
    assert len(found) <= -(-total // 64) + 2
    texts = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert set(texts) == set(found) and sum(map(len, texts.values())) == total
    assert packing.pack(spark.createDataFrame([], SCHEMA), encoder_args()).count() == 0


def test_exact_fit_and_boundaries(spark, encoder):
    words = " a" * 200
    rows = [(n, words[: 2 * n]) for n in (62, 63, 64, 126, 127, 128, 130)]
    check(rows, packing.pack(spark.createDataFrame(rows, SCHEMA), encoder_args(), capacity=64), encoder, 64)


def test_genetic_steps_keep_pieces_and_capacity():
    rng = np.random.default_rng(2)
    # sizes that best fit does not pack at once
    lengths = rng.integers(25, 60, 400)
    first = packing.seeded(lengths, 100, rng)
    second = packing.seeded(lengths, 100, rng)
    for child in (packing.crossed(first, second, lengths, 100, rng), packing.loosened(first, lengths, 100, rng)):
        assert (child >= 0).all() and np.bincount(child, lengths).max() <= 100
    best = packing.evolved(lengths, [first, second], 1, 100)[0]
    assert packing.fitness(best, lengths, 100) <= min(packing.fitness(x, lengths, 100) for x in (first, second))
    small = np.array([5, 5, 4, 3, 3])
    assert packing.fitness(packing.evolved(small, [], 1, 10)[0], small, 10)[0] == 2


def test_long_runs_of_one_kind(spark, encoder):
    rows = [(1, " " * 1_000_000), (2, "a" * 1_000_000), (3, "\n" * 1_000_000), (4, "漢字" * 150_000), (5, "　" * 100_000), (6, "plain words")]
    found = packing.pack(spark.createDataFrame(rows, SCHEMA), encoder_args())
    check(rows, found, encoder, 2048)
