"""Centroid clustering against plain k-means in Python integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from docweave.llm import clusters


def plain(rows, k, rounds, width, scale, most=1 << 26):
    kept = [(i, [max(-most, min(most, math.floor(max(-2.0**40, min(2.0**40, scale * float(np.float32(x))))))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        for j, g in groups.items():
            centroids[j] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    at = [nearest(v) for _, v in kept]
    sums = defaultdict(int)
    for d, j in at:
        sums[j] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, sums[j], sum(sums.values()), names[j]) for (i, _), (d, j) in zip(kept, at, strict=True)), key=repr)


def got(spark, rows, **how):
    frame = spark.createDataFrame([(i, v, "c", "d") for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance string")
    return sorted((tuple(r) for r in clusters.k_means(frame, **how).collect()), key=repr)


def test_against_plain(spark):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(draw.choice([-2, 0, 3]), 1) for _ in range(4)]) for i in range(300)]
    # ties: a grid, whole copies, a hot point; then rows that take no part
    rows += [(1000 + i, [float(i % 3), float(i % 2), 0.0, 0.0]) for i in range(60)]
    rows += [(2000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(200)] + [rows[0], rows[0], (rows[1][0], [9.0, 9.0, 9.0, 9.0]), (None, [0.5, 0.5, 0.5, 0.5])]
    rows += [(1, None), (2, []), (3, [1.0] * 3), (4, [1.0] * 5), (5, [1.0, None, 1.0, 1.0]), (6, [1.0, float("nan"), 1.0, 1.0]), (7, [1.0, float("inf"), 0.0, 0.0])]
    for k, rounds in ((1, 2), (7, 3), (40, 5), (16, 0)):
        assert got(spark, rows, k=k, rounds=rounds, width=4) == plain(rows, k, rounds, 4, 64.0)


def test_large_components(spark):
    rows = [(i, [3e38 if i % 3 else -3e38, float(i), 1e6]) for i in range(20)]
    assert got(spark, rows, k=5, rounds=3, width=3) == plain(rows, 5, 3, 3, 64.0)


def test_fewer_than_k_and_none(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [2.0, 2.0])]
    assert got(spark, rows, k=16, rounds=3, width=2) == plain(rows, 16, 3, 2, 64.0)
    assert got(spark, [], k=16, width=2) == [] and got(spark, [(1, None)], k=16, width=2) == []


@pytest.mark.parametrize("grid", [1, 2, 5])
def test_bounds_skip_and_keep_ties(grid):
    """Exponion's assignments equal a full scan's round by round, on points full of ties,
    and it computes fewer distances."""
    draw = np.random.default_rng(grid)
    x = draw.integers(-grid, grid + 1, size=(4000, 3)) + draw.choice([0, 40, 90], size=(4000, 1))
    c = x[draw.choice(4000, 20, replace=False)].astype(np.int64)
    x = x.astype(np.int64)
    a, upper, lower, moved = np.zeros(4000, np.int32), np.full(4000, np.inf), np.zeros(4000), np.zeros(20)
    looked = 0
    for _ in range(6):
        search = clusters.Exponion(c, moved)
        plain_squared = search.squared

        def counted(rows, j, f=plain_squared):
            nonlocal looked
            looked += len(rows)
            return f(rows, j)

        search.squared = counted
        a, upper, lower = search.assign(x, a, upper, lower)
        full = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (a == full.argmin(axis=1)).all()
        new = np.array([x[a == j].sum(axis=0) // max(1, (a == j).sum()) if (a == j).any() else c[j] for j in range(20)])
        moved, c = np.sqrt(((new - c) ** 2).sum(axis=1).astype(float)), new
    assert looked < 6 * 4000 * 20
