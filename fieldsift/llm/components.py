"""Connected components by alternating large and small stars.

Each round links every node to the smallest of its neighbourhood; rounds grow
with the logarithm of the graph. Every round is written to the shared folder,
so a lost executor costs a re-read. No node gathers its neighbours in a task:
minima are combined before the shuffle, and joins can be split by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.shared import stage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a > b, relinked to the smallest neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("k"))
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("k").alias("a"), F.col("m").alias("b"))
        )
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); ids are BIGINT.

    The component is the smallest id in it. Loops, repeated and reversed edges
    and edges with a null end are allowed and change nothing.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    clean = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = stage(clean.select(a.alias("a"), b.alias("b")).distinct(), "links")
    seen = None
    while True:
        mark = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = stage(_stars(_stars(now, True), False), "links")
    # All edges now lead from a node to the smallest of its component.
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)
