import hashlib
import math
import random

import numpy as np
import pytest

from quittance.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, q string, cluster string, kind int"


def brute(rows, components, clusters, rounds, scale=256):
    """Plain rounds over Python integers."""
    kept = []
    for vec_id, e, *_ in rows:
        if e is not None and len(e) == components and all(x is not None and math.isfinite(x) and abs(x * scale) < clustering.LARGEST for x in e):
            kept.append((vec_id, [math.floor(scale * x) for x in e]))
    by_digest = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [q for _, q in by_digest[:clusters]]

    def nearest(q):
        return min((sum((x - y) ** 2 for x, y in zip(q, one, strict=True)), j) for j, one in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(nearest(q)[1], []).append(q)
        for j, g in groups.items():
            c[j] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    found = [(vec_id, *nearest(q)) for vec_id, q in kept]
    of = {}
    for _, d, j in found:
        of[j] = of.get(j, 0) + d
    fits = lambda n: n if n < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((v, j, d, fits(of[j]), fits(sum(of.values())), digest[j]) for v, d, j in found), key=str)


def run(spark, rows, components, clusters, rounds):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = clustering.clustered(clustering.whole_vectors(df, components), clusters, rounds)
    return sorted(map(tuple, got.collect()), key=str)


def row(i, e):
    return (i, e, 0, "clash", "clash", 1)


def test_awkward_rows_against_brute_force(spark):
    """Nulls, odd lengths, values that aren't finite or are very large, repeated rows, equal vectors, ties, a hot vector."""
    rng = random.Random(1)
    rows = [row(i, [float(np.float32(rng.gauss(i % 5, 0.4))) for _ in range(4)]) for i in range(200)]
    rows += [row(300 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(150)]
    rows += [row(500 + i, [float(x), 0.0, 0.0, 0.0]) for i, x in enumerate((-2, -1, 0, 1, 2) * 3)]
    rows += [row(600, None), row(601, []), row(602, [1.0] * 3), row(603, [1.0] * 5), row(604, [None, 0.0, 0.0, 0.0]), row(605, [math.nan, 0.0, 0.0, 0.0])]
    rows += [row(606, [math.inf, 0.0, 0.0, 0.0]), row(607, [0.0, -math.inf, 0.0, 0.0]), row(608, [1e30, 0.0, 0.0, 0.0]), row(609, [400_000.0, -400_000.0, 0.1, 0.0])]
    rows += [row(None, [0.5, 0.25, 0.0, 0.0]), row(None, [3.0, 3.0, 3.0, 3.0]), rows[5], rows[5]]
    for clusters, rounds in ((12, 5), (1, 3), (40, 0), (40, 4)):
        assert run(spark, rows, 4, clusters, rounds) == brute(rows, 4, clusters, rounds)


def test_few_and_none(spark):
    rows = [row(1, [0.0, 1.0]), row(2, [0.0, 1.0]), row(3, [5.0, 1.0])]
    assert run(spark, rows, 2, 40, 5) == brute(rows, 2, 40, 5)
    assert run(spark, [row(1, None)], 2, 40, 5) == [] == run(spark, [], 2, 40, 5)


@pytest.mark.parametrize("seed", range(6))
def test_ball_keeps_ties_and_saves_work(seed):
    """After moves the search finds what a full scan finds, on a small grid full of ties, with fewer distances on clumped data."""
    rng = np.random.default_rng(seed)
    grid = seed % 2 == 0
    c = rng.integers(-3, 4, (30, 2)) if grid else rng.integers(-10**5, 10**5, (30, 8))
    x = rng.integers(-4, 5, (3000, 2)) if grid else c[rng.integers(0, 30, 3000)] + rng.integers(-3000, 3000, (3000, 8))
    d = clustering.squared(x, c)
    a, s = d.argmin(1), np.sort(np.sqrt(d), axis=1)
    upper, lower = s[:, 0] * (1 + 1e-12), s[:, 1] * (1 - 1e-12)
    for _ in range(4):
        step = rng.integers(-1, 2, c.shape) * (1 if grid else 300)
        moved = np.sqrt((step**2).sum(1)) * (1 + 1e-12)
        c = c + step
        clustering.moved_bounds(a, upper, lower, moved)
        n = clustering.Centroids(c).assign(x, a, upper, lower)
        want = clustering.squared(x, c)
        assert (a == want.argmin(1)).all()
        own = np.sqrt(want[np.arange(len(x)), a])
        assert (upper >= own).all() and (lower <= np.sort(np.sqrt(want), axis=1)[:, 1] * (1 + 1e-9)).all()
        assert grid or n < want.size / 3


def test_large_components_are_exact():
    x, c = np.array([[(1 << 27) - 1, -(1 << 27)]]), np.array([[-(1 << 27), (1 << 27) - 1], [3, 5]])
    assert clustering.squared(x, c).tolist() == [[sum((int(p) - int(q)) ** 2 for p, q in zip(x[0], y, strict=True)) for y in c]]
