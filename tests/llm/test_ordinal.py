import random

import numpy as np

from wardloom.llm import ordinal

DOCS, RATED = "doc_id long, text string", "doc_id long, grade int"


def corpus(n=900):
    rng = random.Random(1)
    good, bad, junk = ([f"{p}{i}" for i in range(k)] for p, k in (("w", 200), ("bad", 6), ("j%%%", 150)))
    docs, grades = [], []
    for i in range(n):
        grade = i % 3
        words = rng.choices(good, k=rng.randrange(20, 120))
        if grade == 0:
            words = rng.choices(junk, k=60)
        elif grade == 1:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words)))
        grades.append((i, grade))
    return docs, grades


def test_held_out_grades(spark):
    docs, grades = corpus()
    rated = [g for g in grades if g[0] % 4]  # a quarter is held out
    got = {r.doc_id: r for r in ordinal.graded(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(rated, RATED), 2, 2).collect()}
    held = [g for g in grades if g[0] % 4 == 0]
    right = np.mean([got[i].selected == (g == 2) for i, g in held])
    order = [np.mean([got[i].expected_grade for i, g in held if g == k]) for k in range(3)]
    assert right > 0.95 and order == sorted(order)
    assert all(r.selected == (r.tail_probability >= 0.5) and 0 <= r.expected_grade <= 2 for r in got.values())
    kept = ordinal.selected(spark.createDataFrame([(*d, "k") for d in docs], DOCS + ", tail string").repartition(3), spark.createDataFrame(rated, RATED), 2, 2)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.selected} and kept.columns == ["doc_id", "text", "tail"]


def test_odd_rows(spark):
    docs, grades = corpus(60)
    docs += [(100, None), (101, ""), (None, "w1 w2"), (5, docs[5][1]), (102, "long " * 50_000)]
    rated = spark.createDataFrame([*grades, (None, 2), (7, None), (8, 9), (3, 1), (999, 0)], RATED)
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS + ", grade int, keys string")
    assert ordinal.graded(df, rated, 2, 2).count() == len(docs)
    assert ordinal.graded(spark.createDataFrame([], DOCS), rated, 2, 2).count() == 0
    none = ordinal.graded(df, spark.createDataFrame([], RATED), 2, 2).collect()
    assert len({r.tail_probability for r in none}) == 1
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    assert sorted((r.doc_id, r.grade) for r in ordinal.grades_of(labels).collect()) == [(1, 0), (2, 1), (3, 2), (4, 0)]


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    rows, keys, values = np.repeat(np.arange(40), 3), rng.integers(0, 50, 120), np.ones(120)
    grades = rng.integers(0, 4, 40)
    w, t = ordinal.fit(np.full(40, 3), keys, values, grades, 3)
    assert (np.diff(t) > 0).all()

    def loss(w, t):
        score = np.bincount(rows, values * w[keys], 40)
        tails = np.column_stack([np.ones(40), 1 / (1 + np.exp(-(score[:, None] - t))), np.zeros(40)])
        at = np.arange(40)
        return -np.log(tails[at, grades] - tails[at, grades + 1]).mean() + ordinal.PENALTY / 2 * (w * w).sum() + ordinal.SPARSE * np.abs(w).sum()

    best = loss(w, t)
    for _ in range(30):
        assert loss(w + 0.2 * rng.normal(size=len(w)) * (np.arange(len(w)) < 50), t) > best - 1e-4
