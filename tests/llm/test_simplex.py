"""Clusters against exact rounds in Python integers; bounds against true distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from stratalens.llm import simplex


def rounds(rows, k=40, n_rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    order = sorted(kept, key=lambda r: (digest(r[0]), np.array(r[1], "<i4").tobytes()))
    centroids = [v for _, v in order[:k]]

    def assign():
        found = []
        for _, v in kept:
            found.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)))
        return found

    for _ in range(n_rounds):
        members = {}
        for (_, v), (_, j) in zip(kept, assign()):
            members.setdefault(j, []).append(v)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j])] if j in members else c for j, c in enumerate(centroids)]
    last = assign()
    sums = {}
    for d, j in last:
        sums[j] = sums.get(j, 0) + d
    total = sum(sums.values())
    return sorted(str((i, j, d, sums[j], total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()))
                  for (i, _), (d, j) in zip(kept, last))


def shown(df):
    return sorted(str(tuple(r)) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def vectors(rng, n):
    heads = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    return [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(heads)]) for i in range(n)]


def test_clusters_equal_exact_rounds(spark):
    rng = random.Random(13)
    rows = vectors(rng, 260)
    rows += [(500 + i, rows[7][1]) for i in range(130)]  # a third are copies
    rows += [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None] + [0.5] * 63), (905, [float("nan")] * 64),
             (906, [float("inf")] + [0.0] * 63), (907, [0.0] * 64), (907, [0.0] * 64), (None, [-0.1] * 64), (908, [3e4] * 64)]
    schema = "vec_id long, embedding array<double>, Cluster string, apex int, label int"
    df = spark.createDataFrame([(i, v, "c", 1, 2) for i, v in rows], schema).repartition(7)
    assert shown(simplex.clustered(df)) == rounds(rows)
    assert simplex.clustered(df.where("false")).collect() == []
    few = spark.createDataFrame([(i, v) for i, v in rows[:5]] + [(7, [1.0] * 64)] * 3, "vec_id long, embedding array<double>")
    assert shown(simplex.clustered(few)) == rounds(rows[:5] + [(7, [1.0] * 64)] * 3)


def test_floats_and_equal_vectors(spark):
    rows = [(i, [0.25] * 64) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    assert shown(simplex.clustered(df)) == rounds(rows)
    with pytest.raises(Exception, match="fit a long"):
        simplex.clustered(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()


@pytest.mark.parametrize("spread", [3, 3000, 60_000_000])
def test_bounds_hold_and_filter(spread):
    rng = np.random.default_rng(5)
    heads = rng.integers(-spread, spread, (40, 64))
    points = heads[rng.integers(0, 40, 900)] + rng.integers(-spread // 8 - 1, spread // 8 + 1, (900, 64))
    points[:40] = heads  # some points are pivots, at height zero
    base = simplex.Simplex(heads)
    apexes = base.apexes(base.squared_distances(points))
    number, least, compared = simplex.nearest(points, apexes, heads, base)
    true = ((points[:, None] - heads[None]) ** 2).sum(axis=2)
    assert (least == true.min(axis=1)).all() and (number == true.argmin(axis=1)).all()
    assert compared < 0.6 * true.size
    other = base.apexes(base.squared_distances(heads))
    flat = ((apexes[:, None, :-2] - other[None, :, :-2]) ** 2).sum(axis=2)
    lower = np.sqrt(flat + (apexes[:, None, -2] - other[None, :, -2]) ** 2)
    upper = np.sqrt(flat + (apexes[:, None, -2] + other[None, :, -2]) ** 2)
    slack = simplex.ROUNDING * (apexes[:, None, -1] + other[None, :, -1])
    assert (lower - slack <= np.sqrt(true)).all() and (upper + slack >= np.sqrt(true)).all()
