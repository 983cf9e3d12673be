"""Nearest neighbours against brute force; the pipeline against a plain run."""

import numpy as np
import pytest

from fieldsift.llm import nearest as nearest_module
from fieldsift.llm.nearest import nearest


def brute(rows, k):
    out = {}
    good = {}
    for i, v in rows:
        v = None if v is None or any(x is None for x in v) else np.array(v, float)
        if i is not None and v is not None and len(v) == 4 and np.isfinite(v).all() and v.any():
            good[i] = v
    for q in (i for i in good if i % 20 == 0):
        ranked = sorted(((-float(v @ good[q]), i) for i, v in good.items() if i != q))[:k]
        out[q] = [(i, -s) for s, i in ranked]
    return out


@pytest.mark.parametrize("n", [0, 1, 15, 900])
def test_nearest_equals_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(n)]
    if n > 100:
        rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]  # one vector in a third of all rows
        rows += [(1000, None), (1020, [0.0] * 4), (1040, [1.0, None, 0.0, 0.0]), (1060, [float("nan")] * 4), (1080, [1.0] * 3)]
        rows += [(20, rows[20][1]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as id")
    found = {}
    for r in sorted(nearest(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    wanted = {q: w for q, w in brute(rows, 20).items() if w}
    assert found.keys() == wanted.keys()
    hits = total = 0
    for q, own in found.items():
        assert len(own) == len(wanted[q])
        hits += len({i for i, _ in own} & {i for i, _ in wanted[q]})
        total += len(own)
    assert hits >= 0.9 * total


def search(df, monkeypatch, cell):
    """Found rows by query, with cells of that many vectors."""
    monkeypatch.setattr(nearest_module, "CELL", cell)
    monkeypatch.setattr(nearest_module, "BLOCK", 2 * cell)
    out = {}
    for r in sorted(nearest(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("kind", ["clustered", "spread"])
def test_recall_over_many_cells(spark, monkeypatch, kind):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(3000, 64))
    if kind == "clustered":
        vectors = rng.normal(size=(40, 64))[rng.integers(0, 40, 3000)] + 0.3 * vectors
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = search(df, monkeypatch, 150)
    scores = vectors @ vectors.T
    hits = 0
    assert sorted(found) == list(range(0, 3000, 20))
    for q, own in found.items():
        best = np.lexsort((np.arange(3000), -scores[q]))
        hits += len({i for i, _ in own} & set(best[best != q][:20].tolist()))
        assert len(own) == 20 and all(abs(s - scores[q, i]) < 1e-9 for i, s in own)
    assert hits >= 0.9 * 20 * len(found)


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    rows = [(20, [1.0, 0.0, 0.0, 0.0])] + [(i if i < 20 else i + 1, [1.0, float(i), float(i % 7), 1.0]) for i in range(400)]
    rows += [(1000, [0.0, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for cell in (4096, 60):
        found = search(df, monkeypatch, cell)
        assert found[20] == [(i, 1.0) for i in range(20)]
        assert [s for _, s in found[1000]] == [1.0] * 20 and [i for i, _ in found[1000]] == list(range(20))


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, apply in p.STAGES[:-1]:
        docs = apply(spark, docs, sf)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.toArrow())
    assert 0 < p.run(spark, sf).count() == docs.count() <= 3 * n
