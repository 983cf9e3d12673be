"""Exact largest inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets, the longest first. A query goes
through the buckets in this order, in waves of growing size, and after each wave
knows the score that a vector must reach. With the length of the longest vector
of a bucket, that score is a cosine that a vector of the bucket needs at least,
the query's local threshold there:

- above 1, the query is done: this bucket and all later ones hold nothing for it;
- from COSINE on, candidates come from the bucket's sorted coordinates: each of
  the query's largest coordinates leaves an interval for the vector's own;
- below, candidates are the vectors that are long enough, the head of the bucket.

Products of candidates are exact. Vectors of a bucket and the queries that are
open there meet in blocks of bounded size; at most BUCKETS rows are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldsift.llm.shared import col, stage
from fieldsift.llm.vectors import longest, matrix, whole_vectors

K, SCALE = 20, 64
# Buckets at most; components of the vectors of a block, which give its rows.
BUCKETS, COMPONENTS = 4096, 1 << 19
# Queries of a block, and those that are multiplied at a time.
QUERIES, TOGETHER = 2048, 256
# Local threshold from which coordinates are searched, and how many of a query's.
COSINE, FOCUS = 0.9, 3
# Buckets of a wave over those of the wave before.
GROWTH = 8
# Products below this are exact in doubles; room for rounding in bounds.
EXACT, ROOM = 1 << 53, 1e-9
# Stands for no product.
NONE = -(1 << 62)


def feasible(unit: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of a unit vector's coordinates whose cosine with ``unit`` is at least ``cosine``."""
    own = np.arccos(np.clip(unit, -1.0, 1.0))
    reach = math.acos(min(1.0, max(-1.0, cosine)))
    return np.cos(np.minimum(own + reach, math.pi)) - ROOM, np.cos(np.maximum(own - reach, 0.0)) + ROOM


class Bucket:
    """Vectors of one block, the longest first, with sorted coordinates made as needed."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float):
        square = np.einsum("ij,ij->i", vectors.astype(float), vectors.astype(float))
        order = np.lexsort((ids, -square))
        self.ids, self.norms = ids[order], np.sqrt(square[order])
        # In doubles where all products with vectors up to ``largest`` are exact.
        exact = self.norms[:1].sum() * largest < EXACT
        self.vectors = vectors[order].astype(float if exact else np.int64)
        self.units = vectors[order] / np.maximum(self.norms, 1.0)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def head(self, least: np.ndarray) -> np.ndarray:
        """Numbers of vectors that are at least so long."""
        return np.searchsorted(-self.norms, -least * (1 - ROOM), side="right")

    def near(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Rows in the intervals of the query's largest coordinates."""
        low, high = feasible(unit, cosine)
        best = None
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        for f in focus.tolist():
            if f not in self.lists:
                order = np.argsort(self.units[:, f], kind="stable")
                self.lists[f] = order, self.units[order, f]
            order, values = self.lists[f]
            a, b = np.searchsorted(values, low[f], "left"), np.searchsorted(values, high[f], "right")
            if best is None or b - a < len(best):
                best = order[a:b]
        own = self.units[best][:, focus]
        return best[((own >= low[focus]) & (own <= high[focus])).all(axis=1)]

    def best(
        self, rows: np.ndarray | slice, names: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best rows of each query that reach ``least``."""
        ids = self.ids[rows]
        products = queries.astype(self.vectors.dtype) @ self.vectors[rows].T
        products[ids == names[:, None]] = NONE
        floor = np.full(len(queries), NONE // 2, products.dtype)
        if products.dtype == float:  # else it would be rounded
            floor = np.maximum(floor, least)
        if len(ids) > k:
            floor = np.maximum(floor, np.partition(products, len(ids) - k, axis=1)[:, len(ids) - k])
        query, at = np.nonzero(products >= floor[:, None])
        score = products[query, at].astype(np.int64)
        order = np.lexsort((ids[at], -score, query))
        query, at, score = query[order], at[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        return query[place < k], ids[at[place < k]], score[place < k]

    def search(
        self, names: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int, top: float
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """:meth:`best` over all rows; ``least`` is -inf where unknown, ``top`` the bucket's length."""
        norms = np.sqrt(np.einsum("ij,ij->i", queries.astype(float), queries.astype(float)))
        bounded = (least > 0) & (norms > 0)
        needed = np.divide(least, norms, out=np.zeros(len(norms)), where=bounded)
        local = needed / top if top else np.where(bounded, math.inf, 0.0)
        by_coordinate = np.flatnonzero(bounded & (local >= COSINE) & (local <= 1 + ROOM))
        for q in by_coordinate.tolist():
            rows = self.near(queries[q] / norms[q], local[q])
            if len(rows):
                _, ids, scores = self.best(rows, names[q : q + 1], queries[q : q + 1], least[q : q + 1], k)
                yield np.full(len(ids), q), ids, scores
        by_length = np.flatnonzero(~bounded | (local < COSINE))
        heads = np.where(bounded[by_length], self.head(needed[by_length]), len(self.ids))
        order = np.argsort(heads, kind="stable")
        by_length, heads = by_length[order], heads[order]
        for at in range(0, len(by_length), TOGETHER):
            some = by_length[at : at + TOGETHER]
            rows = int(heads[at : at + TOGETHER][-1])
            if rows:
                query, ids, scores = self.best(slice(rows), names[some], queries[some], least[some], k)
                yield some[query], ids, scores


def top_products(
    rows: DataFrame, row_id: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = K, scale: int = SCALE
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query.

    Components are floor(scale * x), up to 2 ** 26. Queries are the rows whose
    id is divisible by ``every``; all rows but those with the query's id are
    candidates. Ties go to the smaller id. Rows without an id and vectors that
    are null or hold null or non-finite components take no part; of vectors of
    different sizes the shorter end in zeros. Repeated rows are candidates of
    their own and one query. An empty table gives no rows.
    """
    schema = "query_id long, rank int, vec_id long, score long"
    spark = rows.sparkSession
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    vectors = whole_vectors(rows, vector, scale, id=col(row_id).cast("long")).filter(F.col("id").isNotNull())
    vectors = stage(vectors.withColumn("square", square), "whole_vectors")
    n, size = longest(vectors)
    if not n:
        return spark.createDataFrame([], schema)
    block = max(64, COMPONENTS // max(size, 1))
    count = min(BUCKETS, math.ceil(n / block))
    shares = [i / count for i in range(1, count)]
    marks = vectors.agg(F.percentile_approx("square", shares or [0.5], 100_000).alias("m")).first()["m"]
    # Bucket 0 holds the longest; equal lengths share a bucket.
    edges = np.unique(np.array(marks if shares else [], np.int64))

    def to_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            own = len(edges) - np.searchsorted(edges, batch.column(2).to_numpy(), side="left")
            rows = np.arange(row, row + batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64()), pa.array(rows)], names)
            row += batch.num_rows

    names = ["id", "v", "square", "bucket", "row"]
    kind = "id long, v array<int>, square long, bucket long, row long"
    dealt = stage(vectors.select("id", "v", "square").mapInArrow(to_buckets, kind), "norm_buckets")
    # A row for each bucket.
    facts = {
        r["bucket"]: (r["n"], math.sqrt(r["top"]))
        for r in dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("top")).collect()
    }
    buckets = np.array(sorted(facts))
    tops = np.array([facts[b][1] for b in buckets.tolist()])
    largest = float(tops[0])

    asked = vectors.filter(F.col("id") % every == 0).select("id", "v", "square").distinct()
    queries = stage(asked.withColumn("name", F.monotonically_increasing_id()), "queries")

    def searched(visits: DataFrame, asked_by: dict[int, int]) -> DataFrame:
        plan = spark.createDataFrame(
            [
                (b, math.ceil(facts[b][0] / block), math.ceil(m / QUERIES), facts[b][1])
                for b, m in asked_by.items()
            ],
            "at long, parts int, rounds int, top double",
        )
        plan = F.broadcast(plan)
        keys = ["bucket", "part", "round"]
        blocks = (
            dealt.join(plan, F.col("bucket") == F.col("at"))
            .withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
            .withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
            .select(*keys, "id", "v", "top")
        )
        turns = (
            visits.join(plan, F.col("bucket") == F.col("at"))
            .withColumn("round", F.pmod(F.xxhash64("name"), F.col("rounds")).cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select(*keys, "name", "id", "v", "least")
        )

        def run(points: pa.Table, turns: pa.Table) -> pa.Table:
            out = []
            if points.num_rows and turns.num_rows:
                bucket = Bucket(points["id"].to_numpy(), matrix(points["v"], size), largest)
                names, ids = turns["name"].to_numpy(), turns["id"].to_numpy()
                least = turns["least"].to_numpy().astype(float)  # null: NaN
                least = np.where(np.isnan(least), -math.inf, least)
                own = matrix(turns["v"], size)
                top = points["top"][0].as_py()
                out = [(names[q], ids[q], found, score) for q, found, score in bucket.search(ids, own, least, k, top)]
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
            return pa.table(dict(zip(["name", "query_id", "vec_id", "score"], columns, strict=True)))

        both = blocks.groupBy(*keys).cogroup(turns.groupBy(*keys))
        return both.applyInArrow(run, "name long, query_id long, vec_id long, score long")

    by_query = Window.partitionBy("name").orderBy(F.desc("score"), "vec_id")
    best: DataFrame | None = None
    first, width = 0, 1
    while first < len(buckets):
        wave, wave_tops = buckets[first : first + width], tops[first : first + width]

        def visits(batches: Iterator[pa.RecordBatch], wave=wave, wave_tops=wave_tops) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                least = batch.column(3).to_numpy(zero_copy_only=False).astype(float)
                length = np.sqrt(batch.column(4).to_numpy().astype(float))
                # Lengths fall with the bucket, so the open buckets are the first ones.
                needed = np.divide(least, length, out=np.zeros(len(least)), where=(least > 0) & (length > 0))
                open_ = np.searchsorted(-wave_tops, -needed * (1 - ROOM), side="right")
                pick = np.repeat(np.arange(batch.num_rows), open_)
                to = wave[np.arange(len(pick)) - np.repeat(np.cumsum(open_) - open_, open_)]
                taken = batch.take(pa.array(pick, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns[:4], pa.array(to, pa.int64())], ["name", "id", "v", "least", "bucket"]
                )

        if best is None:
            known = queries.withColumn("least", F.lit(None).cast("long"))
        else:
            kth = best.filter(F.col("place") == k).select("name", F.col("score").alias("least"))
            known = queries.join(kth, "name", "left")
        turns = known.select("name", "id", "v", "least", "square").mapInArrow(
            visits, "name long, id long, v array<int>, least long, bucket long"
        )
        turns = stage(turns, "visits")
        # A row for each bucket.
        asked_by = {r["bucket"]: r["count"] for r in turns.groupBy("bucket").count().collect()}
        if not asked_by:
            break
        found = searched(turns, asked_by)
        if best is not None:
            found = found.unionByName(best.drop("place"))
        best = stage(
            found.withColumn("place", F.row_number().over(by_query)).filter(F.col("place") <= k), "best_products"
        )
        first, width = first + width, width * GROWTH
    if best is None:
        return spark.createDataFrame([], schema)
    return best.select("query_id", F.col("place").cast("int").alias("rank"), "vec_id", "score")
