import math

import numpy as np

from wardloom.llm import cover_tree as cover

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, every=5, positives=5, negatives=3):
    kept = []
    for i, (vec, v, label) in enumerate(rows):
        if vec is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum((abs(256 * float(np.float32(x))) + 1) ** 2 for x in v) < 2**62:
            kept.append((i, vec, label, whole))

    def product(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for i, vec, label, v in kept:
        if vec % every:
            continue
        scored = [(-product(v, w), other, lab) for j, other, lab, w in kept if j != i]
        for score, positive, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            inside = sorted(s for s in scored if s[2] != label and -50 * score <= -100 * s[0] <= -95 * score)[:negatives]
            out += [(vec, positive, k + 1, other, -score, -s) for k, (s, other, _) in enumerate(inside)]
    return sorted(out)


def clustered(seed, n=400, d=12, labels=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(9, d))
    x = middle[rng.integers(0, 9, n)] + rng.normal(size=(n, d)) * 0.3
    x[::17] = x[0]  # copies
    x /= np.linalg.norm(x, axis=1)[:, None] * rng.choice([0.7, 1.0, 1.0], n)[:, None]
    return [(int(i), [float(np.float32(v)) for v in row], int(rng.integers(0, labels))) for i, row in enumerate(x)]


def result(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def test_equal_to_all_pairs(spark, monkeypatch):
    rows = clustered(1)
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert result(cover.hard_negatives(df, "vec_id % 5 = 0")) == want and len(want) > 300
    for name, value in (("BLOCK", 40), ("LEAF", 3), ("ANCHORS", 7), ("SUMMARIES", 4), ("SEEDS", 5), ("VISITS", 2)):
        monkeypatch.setattr(cover, name, value)
    assert result(cover.hard_negatives(df.repartition(3), "vec_id % 5 = 0")) == want


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, 0.5], 1), (5, None, 1), (10, [], 1), (15, [0.5, None], 1), (20, [nan, 0.1], 2), (25, [inf, 0.1], 2), (30, [0.5, 0.4], None),
            (None, [0.5, 0.4], 2), (35, [0.5, 0.5, 0.9], 1), (40, [0.4], 2), (40, [0.4], 2), (45, [3e38, 1.0], 1), (50, [0.3, 0.25], 2), (55, [0.0, 0.0], 3),
            (60, [-0.5, -0.5], 1), (0, [0.5, 0.5], 1), (61, [1e5, 1e5], 1), (62, [7e4, 7e4], 2), (-5, [0.5, 0.45], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", name string, x int")
    want = plain(rows)
    assert result(cover.hard_negatives(df, "vec_id % 5 = 0")) == want and want
    assert result(cover.hard_negatives(df.limit(0), "vec_id % 5 = 0")) == []
    assert result(cover.hard_negatives(df, "vec_id < -100")) == []


def test_numbers_beyond_doubles_are_exact():
    rng = np.random.default_rng(2)
    x = rng.integers(-(1 << 30), 1 << 30, (30, 3))
    assert (cover.scores(x, x, 2.0**62) == np.array([[sum(int(a) * int(b) for a, b in zip(r, s)) for s in x] for r in x])).all()


def test_tree_holds_every_row_once_and_its_bounds_hold():
    rng = np.random.default_rng(4)
    for n, d in ((1, 3), (300, 2), (500, 20)):
        x = rng.integers(-200, 200, (n, d))
        x[n // 2 :: 5] = x[0]
        tree = cover.grown(x)
        assert sorted(tree["rows"].tolist()) == list(range(n))
        below = [None] * len(tree["centre"])
        for node in range(len(below) - 1, -1, -1):
            rows = tree["rows"][tree["row_at"][node] : tree["row_at"][node + 1]].tolist()
            below[node] = rows + sum((below[c] for c in range(tree["child_at"][node], tree["child_at"][node + 1])), [])
        q = rng.integers(-200, 200, (20, d))
        lengths = np.sqrt((q.astype(float) ** 2).sum(1))
        for node, rows in enumerate(below):
            low, high = cover.bounds(cover.scores(q, x[tree["centre"][[node]]], 1e9), lengths, tree["top"][0], tree["angle"][[node]])
            real = q @ x[rows].T
            assert (low <= real).all() and (real <= high).all()


def test_clustered_candidates_are_mostly_left_out():
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(40, 16))
    x = np.floor(256 * (middle[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 16)) * 0.05)).astype(np.int64)
    tree = cover.grown(x)
    asked = {"x": x[:50], "anchor": np.arange(50), "high": np.full(50, 1 << 62), "name": np.arange(50), "length": np.sqrt((x[:50].astype(float) ** 2).sum(1))}
    found = cover.Found(50, 5, np.full(50, cover.LOWEST + 1))
    computed = cover.searched(tree, x, np.arange(2000), np.arange(2000), asked, np.arange(50), found)
    real = x[:50] @ x.T
    real[np.arange(50), np.arange(50)] = cover.LOWEST
    assert (found.score == -np.sort(-real, axis=1)[:, :5]).all()
    assert computed < 0.5 * real.size
