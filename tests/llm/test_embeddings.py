from __future__ import annotations

import math

import numpy as np
import pytest

from shopledger.llm import embeddings

SCHEMA = "vec_id bigint, embedding array<float>, label int, links bigint, lead string, component string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA)


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, threshold):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x, p) in enumerate(rows):
        for j in range(i):
            b, y, q = rows[j]
            if None in (a, b, p, q) or p != q or not usable(x) or not usable(y) or len(x) != len(y):
                continue
            x_, y_ = np.array(x), np.array(y)
            if float((x_ * y_).sum() / (math.sqrt((x_ * x_).sum()) * math.sqrt((y_ * y_).sum()))) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        r = find(i)
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], links[i], least.get(find(i)), rows[i][0] == least.get(find(i))) for i in range(len(rows))), key=str)


def vectors(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dims))
    rows = []
    for i in range(n):
        v = centers[rng.integers(12)] + rng.normal(size=dims) * rng.choice(spread)
        rows.append((1000 - i, [float(x) for x in v * rng.uniform(0.1, 9)], int(rng.integers(3)) if i % 3 else 0))
    return rows


@pytest.mark.parametrize("dims,tile,threshold", [(16, 512, 0.93), (16, 20, 0.93), (5, 15, 0.8), (1, 10, 0.93), (2, 9, -0.2)])
def test_links_are_those_of_all_pairs(spark, dims, tile, threshold):
    rows = vectors(dims, 250, dims, (0.05, 0.2, 0.3, 0.5))
    rows += rows[:30] + [(2000 + i, rows[4][1], rows[4][2]) for i in range(40)]
    got = embeddings.near_duplicates(table(spark, rows), threshold, tile)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, threshold)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], None), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [1.0, nan], 1),
        (8, [inf, 0.0], 1), (9, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [-1.0, 0.0], 1), (12, [1.0, 0.0], 2),
        (1, [1.0, 0.0], 1), (13, [1.0, 0.0, 0.001], 1),
    ]
    got = sorted((tuple(r) for r in embeddings.near_duplicates(table(spark, rows)).collect()), key=str)
    assert got == sorted([
        (1, 2, 1, True), (1, 2, 1, True), (9, 2, 1, False), (10, 1, 10, True), (13, 1, 10, False), (None, 0, None, True),
        *[(i, 0, i, True) for i in (2, 3, 4, 5, 6, 7, 8, 11, 12)],
    ], key=str)
    assert embeddings.near_duplicates(table(spark, [])).count() == 0


def test_early_stops_lose_no_pair():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 40)) * np.linspace(3, 0.1, 40)
    x[100:] = x[:100] + rng.normal(size=(100, 40)) * 0.3
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    for step in (1, 8, 64):
        pairs = set(zip(*map(np.ndarray.tolist, embeddings.close_pairs(x[:150], x[150:], 0.93, step))))
        assert {(int(a), int(b)) for a, b in zip(*np.nonzero(x[:150] @ x[150:].T >= 0.93))} <= pairs
        assert len(pairs) < 150 * 50 / 2
