"""Centroid clustering against k-means by hand with unlimited integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from daygrain.llm import clustering

INF, NAN = float("inf"), float("nan")


def by_hand(rows, k=16, rounds=3, dims=64):
    """Rows of ``(vec_id, vector)`` to rows of ``(vec_id, cluster, distance, cluster_inertia, inertia, digest)``."""
    kept = [
        (i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    points = [(i, [math.floor(64 * int(x)) if abs(x) >= 2**53 else math.floor(64 * x) for x in v]) for i, v in kept]

    def order(at):
        i, v = kept[at]
        return i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest(), v

    centers = [points[at][1] for at in sorted(range(len(kept)), key=order)[:k]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        own = [[p for (_, p), j in zip(points, chosen) if j == c] for chosen in [[nearest(p)[1] for _, p in points]] for c in range(len(centers))]
        centers = [[sum(x) // len(x) for x in zip(*o)] if o else c for o, c in zip(own, centers)]
    found = [(i, *nearest(p)) for i, p in points]
    most = 1 << 63

    def total(parts):
        parts = list(parts)
        return None if any(d >= most for d in parts) or sum(parts) >= most else sum(parts)

    return [
        (
            i,
            c,
            d if d < most else None,
            total(e for _, e, f in found if f == c),
            total(e for _, e, _ in found),
            hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest(),
        )
        for i, d, c in found
    ]


def check(spark, rows, dims, **options):
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, _id int")
    got = clustering.centroid_clusters(df.repartition(3), dims=dims, **options)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, by_hand(rows, dims=dims, **options)))


def test_small_vectors_with_ties(spark):
    rng = random.Random(2)
    # a coarse grid, so that many distances are equal
    rows = [(i, [rng.randrange(-3, 4) / 64 for _ in range(3)]) for i in range(300)]
    check(spark, rows, 3, k=16)
    check(spark, rows, 3, k=1, rounds=0)
    check(spark, rows[:5], 3, k=16)


def test_awkward_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(100, None), (101, []), (102, [1.0] * 3), (103, [1.0] * 5), (104, [1.0, None, 1.0, 1.0]), (105, [1.0, NAN, 1, 1])]
    rows += [(106, [INF, 1.0, 1.0, 1.0]), (107, [0.0, -INF, 1.0, 1.0]), (108, [0.0, -0.0, 0.0, 0.0]), (None, [0.5, 0.25, 1.0, -1.0])]
    rows += [(7, [0.1, 0.2, 0.3, 0.4])] * 3 + [(None, [0.5, 0.25, 1.0, -1.0]), (7, [9.0, 9.0, 9.0, 9.0])]
    check(spark, [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], 4, k=8)


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) * 10.0 ** rng.randrange(0, 12) for _ in range(3)]) for i in range(40)]
    rows += [(50, [1.7e308, -1.7e308, 1.0]), (51, [1.0e30, 2.0e30, 3.0]), (52, [2.0**53 + 2, 0.1, -(2.0**60)])]
    check(spark, rows, 3, k=6)
    check(spark, rows[:40], 3, k=3)


def test_no_usable_vectors(spark):
    check(spark, [(1, None), (2, [1.0])], 3)
    check(spark, [], 3)


def test_limbs_add_up():
    for total in (0, -1, 5, -5, 1 << 32, -(1 << 32), (1 << 200) + 12345, -(1 << 200) - 7, (1 << 32) - 1):
        parts = clustering.limbs(total)
        assert sum(p << (32 * i) for i, p in enumerate(parts)) == total and all(p >= 0 for p in parts[:-1])


def test_bisectors_find_the_nearest():
    rng = np.random.default_rng(5)
    centers = rng.integers(-4, 5, (20, 3)).tolist()
    points = rng.integers(-5, 6, (500, 3))
    planes = clustering.Bisectors(centers)
    for kind in (np.int64, object):
        best, apart = planes.nearest(points.astype(kind))
        all_distances = ((points[:, None, :] - np.array(centers)[None]) ** 2).sum(axis=2)
        assert best.tolist() == all_distances.argmin(axis=1).tolist()
        assert apart.tolist() == all_distances.min(axis=1).tolist()


def test_options_are_checked(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for options in ({"k": 0}, {"k": 1000}, {"dims": 0}):
        with pytest.raises(ValueError):
            clustering.centroid_clusters(df, **options)
