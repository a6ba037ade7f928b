"""Centroid clustering against brute force in whole numbers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from forkline.llm import centroids


def plain(rows, k, rounds, dims, scale=256, seed=2):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    means = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((away(v, c), n) for n, c in enumerate(means))
    for _ in range(rounds):
        groups = [[] for _ in means]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        means = [[sum(c) // len(g) for c in zip(*g)] if g else m for g, m in zip(groups, means)]
    members = [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept]
    total = sum(d for _, _, d in members)
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted(map(str, ((i, c, d, sum(e for _, o, e in members if o == c), total, sha[c]) for i, c, d in members)))


def found(table, **options):
    made = centroids.with_inertia(*centroids.cluster(table, **options))
    assert made.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(str(tuple(r)) for r in made.collect())


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=3).round(2).tolist()) for i in range(60)]
    rows += [(1, rows[1][1]), (1, rows[1][1]), (None, [0.5, 0.5, 0.5]), (None, [0.25, 0.5, 0.5]), (70, None), (71, [1.0, None, 1.0]), (72, [float("nan")] * 3), (73, [1.0, float("-inf"), 0.0]), (74, []), (75, [1.0] * 4)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    for given in (table, table.withColumn("v", F.lit("x")).withColumn("cluster", F.lit(1)).withColumn("h", F.lit(1))):
        assert found(given, k=7, rounds=3, dims=3) == plain(rows, 7, 3, 3)
    assert found(table, k=500, rounds=1, dims=3) == plain(rows, 500, 1, 3)
    assert found(table.limit(0)) == []
    assert found(table.filter("embedding IS NULL")) == []


def test_empty_clusters_stay(spark):
    """Copies of one vector start several centroids; the smallest number takes all of them."""
    rows = [(i, [1.0, 2.0]) for i in range(50)] + [(100 + i, [-1.0, 0.001 * i]) for i in range(5)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert found(table, k=10, rounds=4, dims=2) == plain(rows, 10, 4, 2)


@pytest.mark.parametrize("case", range(5))
def test_search_is_exact_and_rejects(case):
    rng = np.random.default_rng(case)
    x = [
        rng.integers(-300, 300, (2000, 8)),
        rng.integers(-2, 3, (2000, 4)),  # many ties of means and distances
        rng.integers(-300, 300, (2000, 1)) + np.zeros((1, 8), np.int64),  # no deviation at all
        rng.integers(-(1 << 26), 1 << 26, (500, 64)),
        np.repeat(rng.integers(-3, 4, (40, 6)) * 100, 50, axis=0) + rng.integers(-3, 4, (2000, 6)),
    ][case]
    c = x[rng.choice(len(x), 40, replace=False)]
    c[7] = c[3]
    tested = []
    who, distance = centroids.nearest(x, centroids.Centroids(c), tested)
    apart = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert (who == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()
    assert sum(tested) <= (0.5 if case in (2, 4) else 1) * apart.size


def test_too_large_components_are_refused(spark):
    table = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception):
        found(table, dims=2)
