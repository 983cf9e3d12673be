"""Vector codes against a plain version."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldsift.llm import vector_codes as codes


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = []
    for i, v, label in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [max(-(1 << 26), min(1 << 26, math.floor(scale * x))) for x in v], label))
    if not kept:
        return [], None
    width = -(-max(1, max(len(v) for _, v, _ in kept)) // parts)
    cut = []
    for _, v, _ in kept:
        v = v + [0] * (width * parts - len(v))
        cut.append([v[p * width : (p + 1) * width] for p in range(parts)])
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[cut[r][p] for r in order] for p in range(parts)]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [[] for _ in books[p]]
            for row in cut:
                own[near(p, row[p])[1]].append(row[p])
            new.append([[sum(c) // len(g) for c in zip(*g)] if g else e for g, e in zip(own, books[p])])
        books = new
    found, sums = [], {}
    for (i, _, label), row in zip(kept, cut):
        picks = [near(p, row[p]) for p in range(parts)]
        error = sum(d for d, _ in picks)
        sums[label] = sums.get(label, 0) + error
        found.append([i, "".join(f"{k:02x}" for _, k in picks), error, label])
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label], digest) for i, c, e, label in found), key=repr), books


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumn("v", F.lit(1)).withColumn("id", F.lit("x")).withColumn("error", F.lit(2))


def make(n, size=16, step=64):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(5, size))
    made = centres[rng.integers(0, 5, n)] + rng.normal(size=(n, size)) * 0.2
    made = np.float32(np.round(made * step) / step)
    rows = [(int(i), v.tolist(), int(i % 3) if i % 7 else None) for i, v in enumerate(made)]
    return rows


ODD = [
    (7, None, 1), (8, [1.0, None], 1), (9, [float("nan")] * 16, 2), (10, [float("inf")] * 16, 2), (11, [], 0),
    (12, [0.5], None), (13, [1e30, -1e30], 9), (None, [0.25] * 16, 5), (14, [0.5] * 19, 5),
]


@pytest.mark.parametrize("rows", [[], make(3), make(400), make(300, step=2) + ODD + [(1, [2.0] * 16, 1)] * 200])
def test_compress_equals_plain(spark, rows):
    found = codes.compress(table(spark, rows).repartition(3))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows)[0]


def test_traverse_shares_paths_over_blocks():
    rng = np.random.default_rng(1)
    parts, entries = rng.integers(-3, 3, (2000, 6)), rng.integers(-3, 3, (5, 6))
    distinct, place, weight = codes.leaves(parts)
    assert weight.sum() == 2000 and (distinct[place] == parts).all()
    assert [tuple(x) for x in distinct] == sorted(map(tuple, parts.tolist())) or len(distinct) < 2000
    distances = ((distinct[:, None, :] - entries) ** 2).sum(axis=2)
    for block in (1, 7, 10_000):
        nearest, distance = codes.traverse(distinct, entries, block)
        assert (nearest == distances.argmin(axis=1)).all() and (distance == distances.min(axis=1)).all()


def test_decode_gives_the_entries(spark):
    rows = make(200)
    books = codes.learn(table(spark, rows), rounds=2)
    assert books.entries.tolist() == plain(rows, rounds=2)[1]
    coded = codes.encode(table(spark, rows), books)
    back = {r.id: r.vector for r in codes.decode(coded, books).collect()}
    exact = {i: np.floor(np.array(v) * 4096) for i, v, _ in rows}
    for r in coded.collect():
        assert round(((exact[r.id] - np.array(back[r.id]) * 4096) ** 2).sum()) == r.error
