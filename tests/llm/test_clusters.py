"""Clusters of whole-number vectors against plain arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from labelspark.llm import lookup_clusters

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
    + [T.StructField(name, T.StringType()) for name in ("cluster", "x", "v", "ids", "label")]
)
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA).repartition(3)


def plain(rows, k=8, rounds=10, size=64):
    kept = []
    for name, x in rows:
        if x is not None and len(x) == size and all(c is not None and math.isfinite(c) for c in x):
            kept.append((name, [math.floor(1024 * float(np.float32(c))) for c in x]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min((away(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assign()
    total = sum(s for s, _ in found)
    out = []
    for (name, _), (s, j) in zip(kept, found, strict=True):
        spent = sum(t for t, c in found if c == j)
        out.append((name, j, s, spent, total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()))
    return sorted(out, key=str)


def clusters(spark, rows, **options):
    return sorted((tuple(r) for r in lookup_clusters.cluster(frame(spark, rows), **options)[0].select(*COLUMNS).collect()), key=str)


def vectors(seed, n, size=64, spread=1.0):
    rng = random.Random(seed)
    return [(k, [rng.gauss(0, spread) for _ in range(size)]) for k in range(n)]


def test_clusters_of_random_vectors(spark, monkeypatch):
    monkeypatch.setattr(lookup_clusters, "BLOCK", 50)
    rows = vectors(1, 220)
    assert clusters(spark, rows) == plain(rows)


def test_ties_copies_and_empty_clusters(spark):
    # few different vectors: several first centroids are equal, so later ones stay empty
    rows = [(k, [float(k % 3)] * 64) for k in range(40)] + [(5, [0.5] * 64), (5, [0.25] * 64), (None, [2.0] * 64), (None, [0.125] * 64)]
    assert clusters(spark, rows) == plain(rows)


def test_rows_that_are_no_vectors(spark):
    good = vectors(2, 5)
    bad = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [1.0] * 63 + [None]), (105, [math.nan] + [0.0] * 63), (106, [math.inf] * 64), (107, [-math.inf] + [0.0] * 63)]
    got = clusters(spark, good + bad)
    assert got == plain(good) and len(got) == 5
    assert clusters(spark, bad) == [] and clusters(spark, []) == []


def test_large_components(spark):
    rows = vectors(3, 30, spread=20000.0)
    assert clusters(spark, rows) == plain(rows)
    with pytest.raises(PySparkException, match="beyond"):
        clusters(spark, [(1, [1e30] * 64)])


def test_other_sizes(spark):
    rows = vectors(4, 60, size=3)
    assert clusters(spark, rows, k=2, rounds=4, size=3) == plain(rows, 2, 4, 3)
