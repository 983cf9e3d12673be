"""Exact top products against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldsift.llm import norm_search
from fieldsift.llm.norm_search import Bucket, feasible, top_products


def plain(rows, every=20, k=20, scale=64):
    kept = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [max(-(1 << 26), min(1 << 26, math.floor(scale * x))) for x in v]))
    out = []
    for i, q in {(i, tuple(v)) for i, v in kept if i % every == 0}:
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in kept if j != i)
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumn("score", F.lit(1)).withColumn("row", F.lit("x")).withColumn("bucket", F.lit(2))


def clustered(n, size=12, lengths=True):
    rng = np.random.default_rng(n)
    made = rng.normal(size=(9, size))[rng.integers(0, 9, n)] + rng.normal(size=(n, size)) * 0.05
    if lengths:
        made *= np.exp(rng.normal(size=(n, 1)))
    return [(int(i), np.float32(v).tolist()) for i, v in enumerate(made)]


ODD = [
    (20, None), (40, [1.0, None]), (60, [float("nan")] * 3), (80, [float("-inf")]), (None, [9.0] * 12), (100, []),
    (120, [0.0] * 12), (140, [0.5]), (1001, [2.0] * 14), (1002, [1e30, 1e30]), (160, [-1e30]), (20, [1.0] * 12), (20, [1.0] * 12),
]
HOT = [(2000 + i, [1.0, -1.0] * 6) for i in range(300)] + [(3000, [1.0, -1.0] * 6)] * 30


@pytest.mark.parametrize(
    ("rows", "components"),
    [([], 1), (clustered(15), 1), (clustered(700), 1), (clustered(700, lengths=False) + ODD + HOT, 1), (clustered(300), 1 << 19)],
)
def test_top_products_equal_plain(spark, rows, components, monkeypatch):
    monkeypatch.setattr(norm_search, "COMPONENTS", components)  # 1: blocks of 64 vectors, several waves
    found = top_products(table(spark, rows).repartition(3))
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == plain(rows)


@pytest.mark.parametrize("cosine", [0.0001, 0.9, 2.0])
@pytest.mark.parametrize("largest", [1e3, 1e18])
def test_bucket_finds_all_that_reach_the_threshold(cosine, largest, monkeypatch):
    monkeypatch.setattr(norm_search, "COSINE", cosine)
    rng = np.random.default_rng(3)
    vectors = np.floor(rng.normal(size=(500, 8)) * 20).astype(np.int64)
    vectors[100:150] = vectors[7]
    vectors[200:210] = 0
    ids = rng.permutation(500)
    bucket = Bucket(ids, vectors, largest)
    queries, names = vectors[:40], ids[:40]
    products = queries @ vectors.T
    for k, least in ((5, None), (5, 0.8), (400, 0.3)):
        bounds = np.full(40, -math.inf) if least is None else np.floor(np.sort(products, axis=1)[:, -2] * least)
        wanted = {
            (q, int(i)): int(products[q, j])
            for q in range(40)
            for _, i, j in sorted(
                (-products[q, j], ids[j], j) for j in range(500) if j != q and products[q, j] >= bounds[q]
            )[:k]
        }
        found = {}
        for q, own, scores in bucket.search(names, queries, bounds, k, float(bucket.norms[0])):
            found.update(zip(zip(q.tolist(), own.tolist()), scores.tolist()))
        assert all(found.get(key) == score for key, score in wanted.items())


def test_feasible_intervals_hold_all_near_vectors():
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(2000, 4))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    for cosine in (0.2, 0.9, 0.999, 1.0):
        low, high = feasible(unit[0], cosine)
        near = unit[unit @ unit[0] >= cosine]
        assert ((near >= low) & (near <= high)).all()
