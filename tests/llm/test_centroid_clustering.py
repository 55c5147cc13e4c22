"""Sort-means against a plain version in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ensolith.llm import centroid_clustering as C
from ensolith.llm import queries

R = random.Random(8)


def brute(rows, k, rounds, seed, dims, scale):
    """Sorted rows (id, cluster, distance, cluster_inertia, inertia, sha256), every vector against every centroid."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(scale * x) < 1 << 27 for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)
    centroids = [v for _, _, v in named[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    got = [(i, *nearest(v)) for i, v in kept]
    by = {n: sum(d for _, d, m in got if m == n) for n in range(len(centroids))}
    return sorted(((i, n, d, by[n], sum(by.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in got), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert rows_of(queries.op12_centroid_clustering(spark, sf_dir)) == brute(rows, 8, 10, 3, 64, 1024)


@pytest.mark.parametrize("spread", [1, 300])
def test_ties_repeated_rows_and_unfit_vectors(spark, spread):
    rows = [(i, [R.randint(-2, 2) / 1024 * spread for _ in range(3)]) for i in range(120)]
    rows += rows[:7] + [(7, [0.5, 0.5, 0.25])] * 40 + [(None, [0.1, -0.1, 0.0])] * 2
    rows += [(200, None), (201, [1.0]), (202, [1.0, None, 2.0]), (203, [float("nan"), 0.0, 0.0]), (204, [float("inf"), 0.0, 0.0]), (205, []), (206, [3e38, 0.0, 0.0]), (207, [100000.0, -100000.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).select("*", F.lit("x").alias("cluster"), F.lit(1).alias("id"), F.lit(2).alias("v"), F.lit(3).alias("sums"))
    got, centroids = C.sort_means(df, k=5, rounds=4, dims=3)
    assert rows_of(got) == brute(rows, 5, 4, 3, 3, 1024)
    assert len(centroids) == 5


def test_few_or_no_vectors(spark):
    rows = [(1, [0.5, 1.0]), (2, [-0.5, 0.0]), (3, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert rows_of(C.sort_means(df, dims=2)[0]) == brute(rows, 8, 10, 3, 2, 1024)
    assert C.sort_means(df.where("vec_id = 3"), dims=2)[0].count() == 0
    assert C.sort_means(df.where("false"), dims=2)[0].count() == 0
    alone = spark.createDataFrame([(None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert C.sort_means(alone, dims=2)[0].count() == 1


def test_scan_stops_early_and_finds_the_nearest():
    rng = np.random.default_rng(4)
    middles = rng.integers(-10_000, 10_000, (12, 6))
    x = np.concatenate([m + rng.integers(-300, 300, (50, 6)) for m in middles])
    start = np.repeat(np.arange(12), 50)
    number, distance, computed = C.nearest(x, start, middles)
    every = ((x[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert computed < 1.2 * len(x)  # of 12 times as many
    wrong, _, more = C.nearest(x, np.zeros(len(x), int), middles)
    assert (wrong == number).all() and more > computed
