"""Nearest neighbours by inner product: stable projections in kd-trees.

Vectors get one more component, so that the largest inner product is the
smallest distance. Normal (2-stable) projections to M dimensions keep distances:
the squared projected distance over the squared true one is chi-squared with M
degrees of freedom. So a search goes through projected neighbours from near to
far, verifies each by its true inner product, and stops when a vector that is
better than the ones held would lie within the projected distance reached with
probability STOP.

A kd-tree over a sample of projections cuts the space into cells; all vectors
are dealt to the cells, and each cell has its own kd-tree. A query searches its
own cell, which gives a bound, and then all cells that the chi-square test
leaves open; within a cell, all queries go through its leaves together. Equal
vectors are searched once. Cells and their queries meet in
blocks of a bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldsift.llm.shared import col, stage

K = 20
# Projected dimensions, seed of the projections, and the stopping probability.
M, SEED, STOP = 8, 17, 0.98
# Vectors that the outer tree is built on, and the most cells it may have.
SAMPLE, CELLS = 65_536, 4096
# Vectors of a cell on average; most vectors and most queries of a block.
CELL, BLOCK, QUERIES = 4096, 8192, 2048
# Queries whose open cells are listed at a time.
SOME = 64
# Vectors of a leaf of a cell's tree.
LEAF = 256


def chi_square(x: np.ndarray | float) -> np.ndarray | float:
    """Distribution function with M degrees of freedom, M even."""
    half = np.minimum(np.asarray(x, float) / 2, 700.0)
    terms = sum(half**i / math.factorial(i) for i in range(M // 2))
    return 1.0 - np.exp(-half) * terms


def projection(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, M))


def lift(vectors: np.ndarray, radius: float) -> np.ndarray:
    """With a component that brings all lengths to ``radius``."""
    rest = np.maximum(radius * radius - np.einsum("ij,ij->i", vectors, vectors), 0.0)
    return np.column_stack([vectors, np.sqrt(rest)])


def lift_queries(vectors: np.ndarray, radius: float) -> np.ndarray:
    """Scaled to ``radius``, which keeps the order of inner products."""
    length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return np.column_stack([vectors * (radius / length)[:, None], np.zeros(len(vectors))])


class Tree:
    """kd-tree of projections: cuts at medians, leaves with bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.cuts: list[tuple[int, float, int, int]] = []  # axis, value, left, right; leaves are ~leaf
        self.leaves: list[np.ndarray] = []
        self.root = self._build(points, np.arange(len(points)), leaf)
        self.low = np.array([points[i].min(axis=0) for i in self.leaves]).reshape(-1, M)
        self.high = np.array([points[i].max(axis=0) for i in self.leaves]).reshape(-1, M)

    def _build(self, points: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        own = points[rows]
        if len(rows) > leaf:
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            cut = float(np.median(own[:, axis]))
            left = own[:, axis] < cut
            if left.any():  # else more than half of the values are equal
                at = len(self.cuts)
                self.cuts.append((axis, cut, 0, 0))
                sides = self._build(points, rows[left], leaf), self._build(points, rows[~left], leaf)
                self.cuts[at] = (axis, cut, *sides)
                return at
        self.leaves.append(rows)
        return ~(len(self.leaves) - 1)

    def locate(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point."""
        out = np.empty(len(points), np.int64)
        open_ = [(self.root, np.arange(len(points)))]
        while open_:
            node, rows = open_.pop()
            if node < 0:
                out[rows] = ~node
                continue
            axis, cut, left, right = self.cuts[node]
            below = points[rows, axis] < cut
            open_ += [(left, rows[below]), (right, rows[~below])]
        return out


def box_distances(low: np.ndarray, high: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes: a row for each point."""
    far = np.zeros((len(points), len(low)))
    for axis in range(low.shape[1]):
        own = points[:, axis, None]
        far += np.maximum(np.maximum(low[:, axis] - own, own - high[:, axis]), 0.0) ** 2
    return far


def settled(far: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Whether what lies at projected distances from ``far`` on can be left out.

    ``reach`` is the squared distance of a vector as good as the worst one held.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        unlikely = chi_square(far / reach) >= STOP
    return np.where(reach > 0, unlikely, far > 0)


class Cell:
    """Vectors of one block, searched by growing projected distance, for all queries at once."""

    def __init__(self, first: np.ndarray, names: np.ndarray, vectors: np.ndarray, radius: float):
        order = np.lexsort((names, first))  # rows stand in the order of ties
        self.names, self.vectors, self.radius = names[order], vectors[order], radius
        self.points = lift(self.vectors, radius) @ projection(vectors.shape[1] + 1)
        self.tree = Tree(self.points, LEAF)

    def _leaf(self, rows: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(query, row, score) of a leaf's k best for each query, and of all that equal the last."""
        scores = queries @ self.vectors[rows].T
        if len(rows) > k:
            least = np.maximum(least, np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k])
        query, at = np.nonzero(scores >= least[:, None])
        return query, rows[at], scores[query, at]

    def search(
        self, queries: np.ndarray, points: np.ndarray, k: int, bounds: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, name, score) of the k best found for each query.

        ``bounds``: k-th best scores known already, -inf where there is none.
        Each step takes every open query to its next leaf, so the queries that
        meet in a leaf share a product.
        """
        lengths = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        far = box_distances(self.tree.low, self.tree.high, points)
        ways = np.argsort(far, axis=1, kind="stable")
        worst = bounds.astype(float).copy()
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        open_ = np.arange(len(queries))
        for step in range(ways.shape[1]):
            leaf = ways[open_, step]
            # Squared distance of the lifted pair with this inner product.
            reach = 2 * self.radius * (self.radius - worst[open_] / lengths[open_])
            more = ~settled(far[open_, leaf], reach)
            open_, leaf = open_[more], leaf[more]
            if not len(open_):
                break
            found = [best]
            for own in np.unique(leaf).tolist():
                some = open_[leaf == own]
                query, rows, scores = self._leaf(self.tree.leaves[own], queries[some], worst[some], k)
                found.append([some[query], rows, scores])
            query, rows, scores = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((rows, -scores, query))
            query, rows, scores = query[order], rows[order], scores[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            best = [query[place < k], rows[place < k], scores[place < k]]
            last = place == k - 1
            worst[query[last]] = np.maximum(worst[query[last]], scores[last])
        return best[0], self.names[best[1]], best[2]


def _usable(rows: DataFrame) -> DataFrame:
    """(id, v) with distinct (id, vector): v not null, not zero, all finite, of the usual length."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = rows.filter(F.col("id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    sizes = fine.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    usual = sizes.orderBy(F.desc("c"), "n").first()
    return fine.filter(F.size("v") == (usual["n"] if usual else -1)).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float) if len(column) else np.empty((0, 0))


def nearest(rows: DataFrame, row_id: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found.

    Queries are the rows whose id is divisible by ``every``; rows with the
    query's id are no candidates. Ties go to the smaller id. Rows without an id
    and vectors that are null, zero, of an unusual length, or hold null or
    non-finite components take no part; rows repeated in full count once. An
    empty table gives no rows.
    """
    data = _usable(rows.select(col(row_id).cast("long").alias("id"), col(vector).cast("array<double>").alias("v")))
    data = stage(data, "vectors")
    keep = k + 1
    # Of equal vectors the first k + 1 ids are enough; the group is limited before the shuffle.
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    members = data.withColumn("place", place).filter(F.col("place") <= keep)
    unique = stage(
        members.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
            F.element_at("ids", 1).alias("first"), "v", "ids"
        ),
        "unique_vectors",
    )
    # A vector's name is its first id, made unique where one id has several vectors.
    named = stage(unique.withColumn("name", F.xxhash64("first", "v")), "named_vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = named.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(square)).alias("radius"), F.max(F.size("v")).alias("size")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not facts["n"]:
        return rows.sparkSession.createDataFrame([], schema)
    radius, size = float(facts["radius"]), int(facts["size"])

    # About twice as many as are taken, so that no task gets many more.
    draw = F.xxhash64("name", F.lit("sample"))
    share = min(1.0, 2 * SAMPLE / facts["n"])
    some = named.filter(F.pmod(draw, F.lit(1 << 40)) < int(share * (1 << 40)))
    sampled = some.orderBy(draw, "name").limit(SAMPLE).select("v").toArrow()
    points = lift(_matrix(sampled["v"].combine_chunks()), radius) @ projection(size + 1)
    cells = min(CELLS, max(1, facts["n"] // CELL))
    outer = Tree(points, max(1, math.ceil(len(points) / cells)))
    del points, sampled

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = projection(size + 1)
        for batch in batches:
            if batch.num_rows:
                own = outer.locate(lift(_matrix(batch.column(1)), radius) @ matrix)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(own, pa.int64())], ["name", "v", "first", "cell"]
                )

    schema_of_cells = "name long, v array<double>, first long, cell long"
    dealt = stage(named.select("name", "v", "first").mapInArrow(to_cells, schema_of_cells), "cells")
    # One row for each cell.
    counts = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}
    parts = {c: max(1, math.ceil(n / BLOCK)) for c, n in counts.items()}

    # Boxes of all vectors of a cell: the cell's region is not bounded by the sample.
    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, low, high = projection(size + 1), {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            own = lift(_matrix(batch.column(1)), radius) @ matrix
            where = batch.column(3).to_numpy()
            for c in np.unique(where):
                mine = own[where == c]
                low[c] = np.minimum(low.get(c, math.inf), mine.min(axis=0))
                high[c] = np.maximum(high.get(c, -math.inf), mine.max(axis=0))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(low), pa.int64()),
                pa.array([x.tolist() for x in low.values()], pa.list_(pa.float64())),
                pa.array([high[c].tolist() for c in low], pa.list_(pa.float64())),
            ],
            ["cell", "low", "high"],
        )

    box_rows = dealt.mapInArrow(boxes, "cell long, low array<double>, high array<double>")
    box_rows = box_rows.groupBy("cell").agg(
        *(F.min(F.col("low")[i]).alias(f"l{i}") for i in range(M)), *(F.max(F.col("high")[i]).alias(f"h{i}") for i in range(M))
    ).collect()
    box_cells = np.array([r["cell"] for r in box_rows], np.int64)
    low = np.array([[r[f"l{i}"] for i in range(M)] for r in box_rows])
    high = np.array([[r[f"h{i}"] for i in range(M)] for r in box_rows])

    # Each distinct vector of a query is searched once.
    asked = data.filter(F.col("id") % every == 0)
    names = named.select("name", F.col("v").alias("own"))
    owners = stage(
        asked.join(names, F.col("v") == F.col("own")).select(F.col("id").alias("query_id"), "name"), "queries"
    )
    queries = dealt.join(owners.select("name").distinct(), "name", "left_semi")

    def searched(visits: DataFrame) -> DataFrame:
        """Staged (query, name, score) of (name, v, cell, bound)."""
        visits = stage(visits, "visits")
        asked_by = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
        rounds = {c: max(1, math.ceil(n / QUERIES)) for c, n in asked_by.items()}
        # At most CELLS rows.
        plan = spark.createDataFrame(
            [(c, parts[c], n) for c, n in rounds.items()] or [(-1, 1, 1)], "at long, parts int, rounds int"
        )
        plan = F.broadcast(plan)
        blocks = (
            dealt.join(plan, F.col("cell") == F.col("at"))
            .withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")))
            .withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
            .select("cell", "part", F.col("round").cast("long").alias("round"), "name", "v", "first")
        )
        turns = (
            visits.join(plan, F.col("cell") == F.col("at"))
            .withColumn("round", F.pmod(F.xxhash64("name", F.lit(1)), F.col("rounds")))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("cell", F.col("part").cast("long").alias("part"), "round", "name", "v", "bound")
        )

        def run(points: pa.Table, turns: pa.Table) -> pa.Table:
            found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            if points.num_rows and turns.num_rows:
                names, first = points["name"].to_numpy(), points["first"].to_numpy()
                cell = Cell(first, names, _matrix(points["v"].combine_chunks()), radius)
                vectors, asked = _matrix(turns["v"].combine_chunks()), turns["name"].to_numpy()
                projected = lift_queries(vectors, radius) @ projection(size + 1)
                bounds = turns["bound"].to_numpy().astype(float)  # null: NaN
                bounds = np.where(np.isnan(bounds), -math.inf, bounds)
                query, own, scores = cell.search(vectors, projected, keep, bounds)
                found = [asked[query], own, scores]
            return pa.table(dict(zip(["query", "name", "score"], found, strict=True)))

        keys = ["cell", "part", "round"]
        both = blocks.groupBy(*keys).cogroup(turns.groupBy(*keys))
        return stage(both.applyInArrow(run, "query long, name long, score double"), "found")

    spark = rows.sparkSession
    first = searched(queries.select("name", "v", "cell", F.lit(None).cast("double").alias("bound")))
    best = Window.partitionBy("query").orderBy(F.desc("score"))
    bounds = (
        first.withColumn("place", F.row_number().over(best))
        .filter(F.col("place") == keep)
        .select(F.col("query").alias("name"), F.col("score").alias("bound"))
    )

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = projection(size + 1)
        for batch in (b.slice(at, SOME) for b in batches for at in range(0, b.num_rows, SOME)):
            vectors = _matrix(batch.column(1))
            projected = lift_queries(vectors, radius) @ matrix
            home = batch.column(2).to_numpy()
            bound = batch.column(3).to_numpy(zero_copy_only=False).astype(float)  # null: NaN
            bound = np.where(np.isnan(bound), -math.inf, bound)
            reach = 2 * radius * (radius - bound / np.sqrt(np.einsum("ij,ij->i", vectors, vectors)))
            far = box_distances(low, high, projected)
            open_ = ~settled(far, np.broadcast_to(reach[:, None], far.shape)) & (box_cells != home[:, None])
            pick, to = np.nonzero(open_)
            to = box_cells[to]
            taken = batch.take(pa.array(pick, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken.column(0), taken.column(1), pa.array(to, pa.int64()), taken.column(3)],
                ["name", "v", "cell", "bound"],
            )

    more = queries.join(bounds, "name", "left").select("name", "v", "cell", "bound")
    second = searched(more.mapInArrow(others, "name long, v array<double>, cell long, bound double"))

    # Equal vectors back to rows; the first k + 1 of a query's vector, then each query without itself.
    top = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    shorter = Window.partitionBy("query").orderBy(F.desc("score"), "first")
    found = (
        first.unionByName(second)
        .join(named.select("name", "ids", "first"), "name")
        .withColumn("place", F.row_number().over(shorter))
        .filter(F.col("place") <= keep)
        .select("query", "score", F.explode("ids").alias("vec_id"))
        .withColumn("place", F.row_number().over(top))
        .filter(F.col("place") <= keep)
        .drop("place")
    )
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        owners.withColumnRenamed("name", "query")
        .join(found, "query")
        .filter(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(by_query))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
