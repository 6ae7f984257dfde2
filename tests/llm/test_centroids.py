"""Centroid clustering against a plain Lloyd loop, and its bounds."""

import hashlib
import math

import numpy as np
import pytest

from bidscout.llm import centroids as K

KINDS = "vec_id long, embedding array<float>, label int, v string, cluster int"


def lloyd(rows, k, rounds, size):
    """(id, cluster, distance) sorted, and centroids, in Python integers."""
    kept = []
    for i, x, *_ in rows:
        if x is not None and len(x) == size and all(c is not None and math.isfinite(c) for c in x):
            kept.append((i, [math.floor(256 * float(np.float32(c))) for c in x]))
    rank = lambda i: "~" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (rank(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for n in range(len(centres)):
            own = [v for (_, v), m in zip(kept, at, strict=True) if m == n]
            if own:
                centres[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, *reversed(near(v))) for i, v in kept]
    return sorted(found, key=repr), centres


def rows_of(rng, n, size, groups=6):
    middles = rng.normal(0, 1, (groups, size))
    return [(int(i), [float(c) for c in middles[rng.integers(groups)] + rng.normal(0, 0.15, size)], 0, "v", 1) for i in range(n)]


@pytest.mark.parametrize("k,rounds", [(5, 4), (40, 3), (3, 0)])
def test_cluster(spark, k, rounds):
    rng = np.random.default_rng(k)
    rows = rows_of(rng, 90, 8)
    rows += [rows[3], rows[3], (None, rows[5][1], 0, "v", 1), (500, None, 0, "v", 1), (501, [1.0] * 7, 0, "v", 1), (502, [1.0] * 7 + [None], 0, "v", 1)]
    rows += [(503, [float("nan")] + [0.0] * 7, 0, "v", 1), (504, [float("inf")] + [0.0] * 7, 0, "v", 1), (505, [], 0, "v", 1), (506, [1e30] * 8, 0, "v", 1)]
    df = spark.createDataFrame(rows, KINDS).repartition(4)
    found, centres = K.clustered(df, k=k, rounds=rounds, size=8)
    expected, middle = lloyd([r for r in rows if r[0] != 506], k, rounds, 8)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()), key=repr) == expected
    assert centres.tolist() == middle


def test_bounds_save_scans(spark):
    """Of well-parted groups few vectors are scanned once the centroids hardly move."""
    rows = rows_of(np.random.default_rng(1), 400, 16, groups=4)
    found, _ = K.clustered(spark.createDataFrame(rows, KINDS), k=4, rounds=6, size=16)
    assert found.filter("scanned").count() < 100


def test_loosening():
    """No point of a cluster's sphere comes nearer to another centroid by more; and the bound is often far less than the drift."""
    rng = np.random.default_rng(7)
    shares = []
    for _ in range(200):
        old = rng.normal(0, 100, (4, 3))
        new = old + rng.normal(0, rng.choice([1, 30, 200]), (4, 3))
        radius = rng.uniform(0, 80, 4)
        lost = K.loosening(old, new, radius)
        drift = np.linalg.norm(new - old, axis=1)
        for i in range(4):
            way = rng.normal(0, 1, (300, 3))
            points = old[i] + way / np.linalg.norm(way, axis=1)[:, None] * radius[i] * rng.uniform(0, 1, (300, 1)) ** 0.1
            for j in range(4):
                if j != i:
                    nearer = np.linalg.norm(points - old[j], axis=1) - np.linalg.norm(points - new[j], axis=1)
                    assert nearer.max() <= lost[i] + 1e-6
            shares.append(lost[i] / np.delete(drift, i).max())
    assert max(shares) <= 1 + 1e-6 and np.mean(shares) < 0.8


def test_large_components():
    """Beyond what doubles hold exactly, distances are still exact."""
    v = np.array([[K.SPAN, -K.SPAN], [K.SPAN - 1, 5]])
    c = np.array([[-K.SPAN, K.SPAN], [K.SPAN - 2, 5]])
    assert K.squares(v, c).tolist() == [[int(sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True))) for y in c] for x in v]


def test_empty(spark):
    found, centres = K.clustered(spark.createDataFrame([], KINDS))
    assert found.collect() == [] and len(centres) == 0
