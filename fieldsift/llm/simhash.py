"""Near duplicates by SimHash, searched in tables of pivot distances.

Every distinct fingerprint gets its Hamming distances to fixed reference
fingerprints (pivots). By the triangle inequality, a pair at distance r differs
by r at most in each coordinate, so a pair with a larger difference is discarded
before it is compared. That test alone has no key to shuffle by; so a distance
is kept as a sum of partial distances, one for each of GROUPS spans of bits. A
pair at distance 2 has at least GROUPS - 2 spans without a differing bit, and
there all partial distances agree: candidates are the rows that agree on the
partial distances of two spans. They are held against the coordinate test and
then compared.

A bucket with many fingerprints is not paired off. Two fingerprints at distance
2 or less have a common neighbour at distance 1 or less from both; so in such
buckets rows meet at those neighbours, at most BITS + 1 rows each, and no pair
is formed. This finds the same links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from fieldsift.llm.components import components
from fieldsift.llm.shared import col, fresh, splitmix, stage

SHINGLE = 3
SEED = 42
BITS = 64
# Spans of bits, pivots, and the largest number of differing bits of a link.
GROUPS = 4
PIVOTS = 12
RADIUS = 2
# Buckets with more fingerprints than this are searched by common neighbours.
BUCKET = 64
# Hashes whose bits are counted at a time.
_CHUNK = 1 << 15


def fingerprint(text: str) -> int:
    """SimHash of the shingles of SHINGLE words, repeats included; 0 without words.

    A-Z are lower-cased, words end at [\\x20\\x09-\\x0D]. A text of fewer words
    is one shingle.
    """
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    spans = [words[i:] for i in range(SHINGLE)] if len(words) >= SHINGLE else [words]
    shingles = list(map(b" ".join, zip(*spans, strict=False))) if len(spans) > 1 else [b" ".join(words)]
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["row_id", "fp"])


def fingerprints(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Staged (row_id, fp) with the fingerprint as a BIGINT."""
    rows = docs.select(col(row_id).cast("long").alias("row_id"), col(text).alias("text"))
    return stage(rows.mapInArrow(_fingerprints, "row_id long, fp long"), "simhash")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _span(g: int) -> range:
    return range(g * BITS // GROUPS, (g + 1) * BITS // GROUPS)


def _pivot_table(distinct: DataFrame) -> DataFrame:
    """Partial distances of each span, packed, and the full ones, 7 bits each."""
    pivots = [_signed(int(splitmix(i + 1))) for i in range(PIVOTS)]
    near: list[list[F.Column]] = []
    for g in range(GROUPS):
        mask = F.lit(_signed(sum(1 << b for b in _span(g))))
        near.append([F.bit_count(F.col("fp").bitwiseXOR(F.lit(p)).bitwiseAND(mask)).cast("long") for p in pivots])

    def packed(values: list[F.Column], width: int) -> F.Column:
        total = values[0]
        for i, value in enumerate(values[1:], 1):
            total = total + F.shiftleft(value, i * width)
        return total

    full = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long") for p in pivots]
    half = PIVOTS // 2
    return distinct.select(
        "fp",
        "rep",
        *(packed(d, 5).alias(f"g{g}") for g, d in enumerate(near)),
        packed(full[:half], 7).alias("d0"),
        packed(full[half:], 7).alias("d1"),
    )


def _coordinates_agree(a: str, b: str) -> F.Column:
    """No coordinate of the pair differs by more than RADIUS."""
    test = F.lit(True)
    for d in ("d0", "d1"):
        for i in range(PIVOTS // 2):
            x, y = (F.shiftright(F.col(f"{s}.{d}"), 7 * i).bitwiseAND(F.lit(127)) for s in (a, b))
            test = test & (F.abs(x - y) <= RADIUS)
    return test


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) of ``rep`` that join all of (fp, rep) within RADIUS bits.

    ``fp`` is distinct. The edges give the components of the links, not each
    link.
    """
    keys = [
        F.struct(F.lit(i).alias("k"), F.col(f"g{g}").alias("x"), F.col(f"g{h}").alias("y"))
        for i, (g, h) in enumerate(combinations(range(GROUPS), 2))
    ]
    rows = _pivot_table(distinct).select("fp", "rep", "d0", "d1", F.explode(F.array(*keys)).alias("key"))
    rows = rows.select("fp", "rep", "d0", "d1", "key.k", "key.x", "key.y")
    counts = rows.groupBy("k", "x", "y").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stage(rows.join(counts, ["k", "x", "y"]), "buckets")

    few = shared.filter(F.col("n") <= bucket)
    same = " and ".join(f"a.{c} = b.{c}" for c in ("k", "x", "y"))
    pairs = few.alias("a").join(few.alias("b"), F.expr(f"{same} and a.fp < b.fp"))
    pairs = pairs.filter(_coordinates_agree("a", "b")).filter(
        F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS
    )
    edges = pairs.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))

    # Common neighbours: the fingerprint itself, and one bit of the open spans changed.
    flips = [
        [_signed(1 << b) for g in range(GROUPS) if g not in pair for b in _span(g)]
        for pair in combinations(range(GROUPS), 2)
    ]
    by_key = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(f).cast("long") for f in fs)) for fs in flips))
    met = shared.filter(F.col("n") > bucket).select(
        "rep", F.explode(F.transform(F.element_at(by_key, F.col("k") + 1), lambda f: f.bitwiseXOR(F.col("fp")))).alias("z")
    )
    least = met.groupBy("z").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).filter("a != last")
    around = met.join(least.drop("last"), "z").select("a", F.col("rep").alias("b")).filter("a != b")
    return edges.unionByName(around)


def near_groups(docs: DataFrame, row_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    ``component_id`` is the smallest id reachable over links of RADIUS bits or
    fewer, the row's own included. Null texts are empty; texts without words
    have fingerprint 0 and link like any other. Rows with a null id take their
    fingerprint's component and name none; it is null where no row has an id.
    Repeated rows come out as often as they go in.
    """
    rows = fingerprints(docs, row_id, text)
    distinct = rows.filter(F.col("row_id").isNotNull()).groupBy("fp").agg(F.min("row_id").alias("rep"))
    distinct = stage(distinct, "fingerprints")
    # Fingerprints without an id can still join two that have one.
    bare = rows.filter(F.col("row_id").isNull()).select("fp").distinct()
    every = distinct.unionByName(
        bare.join(distinct, "fp", "left_anti").select("fp", F.lit(None).cast("long").alias("rep"))
    )
    # Nodes are fingerprints: their order does not matter, so ids may be null.
    nodes = every.withColumn("rep_id", F.col("rep")).withColumn("rep", F.col("fp"))
    found = components(links(nodes.select("fp", "rep"), bucket))
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "rep_id", F.coalesce("component", "fp").alias("part")
    )
    named = stage(named, "parts")
    least = named.filter("part != fp").groupBy("part").agg(F.min("rep_id").alias("m"))
    # Only fingerprints in larger components need the smallest id of others.
    ids = named.join(least, "part", "left")
    root = ids.filter("part = fp").select("part", F.least("rep_id", "m").alias("component_id"))
    label = named.select("fp", "part").join(root, "part").select("fp", "component_id")
    hex_ = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(label, "fp").select(
        F.col("row_id").alias("doc_id"), hex_.alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id, with its columns.

    Rows without an id stay. Rows with one id are one document; where their
    texts differ, they stay if one of them leads its group.
    """
    groups = near_groups(docs, row_id, text).filter(F.col("doc_id").isNotNull())
    leads = groups.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("leads"))
    gone = fresh(docs, "gone")
    dropped = leads.filter(~F.col("leads")).select(F.col("doc_id").alias(gone))
    return docs.join(dropped, col(row_id) == F.col(gone), "left_anti")
