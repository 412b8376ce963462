import random

import numpy as np

from tests.llm import brute
from wardloom.llm import decontaminate as de

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def plain(item, text):
    """Least edits between the item and any stretch of the text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i + 1] + 1, row[i] + (x != w), new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def expected(docs, items):
    out = []
    for d, t in docs:
        for i, x in items:
            a, b = brute.words(x), brute.words(t)
            if a and b:
                distance = plain(a, b)
                if distance <= len(a) * 20 // 100:
                    out.append((d, i, distance))
    return out


def edited(rng, words, k, vocabulary):
    words = list(words)
    for _ in range(k):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = rng.choice(vocabulary)
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, rng.choice(vocabulary))
    return words


def test_passages_are_found_and_exact(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([1, 2, 4, 7, 12, 15, 15, 23, 30, 44, 59, 80] * 2)]
    docs, exact = [], []
    for d in range(300):
        text = rng.choices([f"o{i}" for i in range(2000)] + vocabulary[:60], k=rng.randrange(1, 400))
        if d % 2:
            i, x = rng.choice(items)
            words = x.split()
            k = rng.choice([0, 0, 1, 2, len(words) * 20 // 100])
            if k == 0:
                exact.append((d, i))
            at = rng.randrange(len(text) + 1)
            text[at:at] = edited(rng, words, min(k, len(words) * 20 // 100), vocabulary)
        docs.append((d, " ".join(text)))
    rows = de.passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    got = {(r.doc_id, r.item_id, r.distance) for r in rows}
    true = set(expected(docs, items))
    pairs = {x[:2] for x in true}
    assert {x[:2] for x in got} <= pairs
    assert set(exact) <= {x[:2] for x in got}
    assert len(got & true) >= 0.95 * len(true), (len(got & true), len(true))
    texts = dict(docs)
    for r in rows:
        part = brute.words(texts[r.doc_id])[r.start_word : r.end_word]
        item = brute.words(dict(items)[r.item_id])
        assert plain(item, part) == r.distance and len(part) <= len(item) + r.distance


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "x A b C y"), (3, "x A b C y"), (None, "a b c"), (4, "far away"), (5, "w " * 40_000 + "a b c")]
    items = [(7, "a B c"), (7, "a B c"), (8, None), (9, " "), (None, "y")]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in docs], DOCS + ", item_id int, n_words string")
    found = de.passages(df, spark.createDataFrame(items, ITEMS))
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in found.collect()), key=repr)
    assert got == sorted([(3, 7, 0), (3, 7, 0), (None, 7, 0), (5, 7, 0), (3, None, 0), (3, None, 0)], key=repr)
    empty = spark.createDataFrame([], DOCS)
    assert de.passages(empty, spark.createDataFrame(items, ITEMS)).count() == 0
    assert de.passages(df, spark.createDataFrame([], ITEMS)).count() == 0


def test_bit_parallel_distance_is_that_of_the_table():
    rng = np.random.default_rng(4)
    for _ in range(200):
        item = rng.integers(0, 6, rng.integers(1, 70)).astype(np.uint64)
        text = rng.integers(0, 6, rng.integers(0, 100)).astype(np.uint64)
        assert de.within(item, text)[0] == plain(item.tolist(), text.tolist())


def test_recall_of_copies_with_all_allowed_edits_in_small_bands():
    """One item alone in its band, and a rare length among many items of another."""
    rng = np.random.default_rng(17)

    def fresh(n):
        return rng.integers(1, 1 << 62, n).astype(np.uint64)

    def recall(items, copied, copies=400):
        keyed = [(b, b.keys()) for b in de.banded(items)]
        known = de.HashTable(np.unique(np.concatenate(items)))
        item, met, tried = items[copied], 0, 0
        while tried < copies:
            copy = de.edited(item, de.allowed(len(item)), rng)
            text = np.concatenate([fresh(30), copy, fresh(80)])
            if plain(item.tolist(), text.tolist()) != de.allowed(len(item)):
                continue
            symbols, at = np.append(text, np.zeros(1, np.uint64)), np.array([0, len(text)])
            hits = (i for b, keys in keyed for _, i in de._candidates(b, keys, symbols, at, known.find(text) < 0))
            met, tried = met + any(copied in i for i in hits), tried + 1
        return met / copies

    for n in (5, 10, 20, 20, 20, 40, 40, 60):
        got = recall([fresh(n)], 0)
        assert got >= 0.93, (n, got)
    # 10 words beside many items of 9, which may have one edit less
    got = recall([fresh(9) for _ in range(200)] + [fresh(10) for _ in range(3)], 200)
    assert got >= 0.93, got
