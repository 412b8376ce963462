import numpy as np

from tests.llm import brute
from wardloom.llm import near_vectors as near

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, threshold=0.9):
    links, n = [], [0] * len(rows)
    vectors = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        vectors.append(np.array(v, np.float32).astype(float) if ok else None)
    for i, x in enumerate(vectors):
        for j in range(i):
            y = vectors[j]
            if x is not None and y is not None and len(x) == len(y):
                if x @ y >= threshold * np.linalg.norm(x) * np.linalg.norm(y):
                    links.append((j, i))
                    n[i] += 1
                    n[j] += 1
    roots = brute.grouped(len(rows), links)
    least = {}
    for (vec, _), r in zip(rows, roots):
        if vec is not None:
            least[r] = min(least.get(r, vec), vec)
    return [(vec, n[i], least.get(roots[i]), vec is not None and vec == least.get(roots[i])) for i, (vec, _) in enumerate(rows)]


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def rows_of(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(12):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            rows.append(base + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.25, 0.4]))
    rng.shuffle(rows)
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


def test_links_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near, "TILE", 7)
    for seed in (1, 2):
        rows = rows_of(seed)
        assert result(near.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == sorted(plain(rows), key=repr)


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (None, [3.0, 0.1]), (9, [1.0]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], SCHEMA + ", name int, label string")
    assert result(near.near_duplicates(df)) == sorted(plain(rows), key=repr)
    assert result(near.near_duplicates(spark.createDataFrame([], SCHEMA))) == []


def test_bound_holds_and_spanning_connects():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = near.quantised(x)
    wrong = np.abs(x @ x.T - (q * s[:, None]).astype(float) @ (q * s[:, None]).astype(float).T)
    assert (wrong <= e[:, None] + e[None] + e[:, None] * e[None] + 1e-12).all()
    for density in (0.001, 0.02, 0.3):
        tile = rng.random((40, 50)) < density
        edges = list(zip(*near._spanning(tile)))
        assert all(tile[r, c] for r, c in edges) and len(edges) <= 90
        both = [[(int(r), 40 + int(c)) for r, c in pairs] for pairs in (edges, zip(*np.nonzero(tile)))]
        assert brute.grouped(90, both[0]) == brute.grouped(90, both[1])
