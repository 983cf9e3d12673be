"""Vector codes: nearest codebook entries found in tries of distinct parts.

A vector is cut into parts, and a part is stored as the number of its nearest
codebook entry. In each block of vectors the distinct parts, sorted, are the
leaves of a lexicographic trie, with their multiplicity as weight. A traversal
in depth-first order keeps, for each node on the way, the squared distances of
its prefix to the same prefix of all entries; leaves with a common prefix share
them. A leaf takes the least of its distances and adds its weighted components
to that entry's sum. Leaves are visited in bounded blocks: within a block, the
new nodes of one depth are computed together, and the path of the last leaf is
carried over to the next block.

Blocks are made once and staged; a round reads them and shuffles one row per
entry and task. Codebooks are a few numbers, held by the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.shared import col, stage
from fieldsift.llm.vectors import longest, matrix, whole_vectors

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
# Leaves that are visited together.
LEAVES = 2048


@dataclass(frozen=True)
class Codebooks:
    """Whole-number entries by part, entry and component, and what made them whole."""

    entries: np.ndarray
    scale: int = SCALE

    def digest(self) -> str:
        """SHA-256 of all components, decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def leaves(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, each row's place, and their weights."""
    # Big-endian numbers from 0 on compare as bytes.
    keys = np.ascontiguousarray((parts + (1 << 31)).astype(">u4"))
    _, first, place, weight = np.unique(
        keys.view(f"V{4 * parts.shape[1]}").ravel(), return_index=True, return_inverse=True, return_counts=True
    )
    return parts[first], place.ravel(), weight


def traverse(parts: np.ndarray, entries: np.ndarray, block: int = LEAVES) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each leaf, the lowest of equally near ones, and its squared distance."""
    n, depth = parts.shape
    nearest, distance = np.empty(n, np.int64), np.empty(n, np.int64)
    path = np.zeros((depth + 1, len(entries)), np.int64)  # distances of the last leaf's prefixes
    for low in range(0, n, block):
        own = parts[low : low + block]
        differs = np.ones(own.shape, bool)
        before = parts[max(low - 1, 0) : low + len(own) - 1] if low else own[:-1]
        differs[0 if low else 1 :] = own[0 if low else 1 :] != before
        new = np.logical_or.accumulate(differs, axis=1)  # the leaf's prefix is another than before
        node, found = np.zeros(len(own), np.int64), path[:1]
        last = path.copy()
        for d in range(depth):
            at = np.flatnonzero(new[:, d])
            more = found[node[at]] + (own[at, d, None] - entries[:, d]) ** 2
            found, node = np.concatenate([path[d + 1 : d + 2], more]), np.cumsum(new[:, d])
            last[d + 1] = found[node[-1]]
        path = last
        of_leaf = found[node]
        nearest[low : low + len(own)] = best = of_leaf.argmin(axis=1)
        distance[low : low + len(own)] = of_leaf[np.arange(len(own)), best]
    return nearest, distance


def _cut(vectors: np.ndarray, parts: int) -> np.ndarray:
    """(part, row, component)"""
    return vectors.reshape(len(vectors), parts, -1).transpose(1, 0, 2)


def _tries(vectors: DataFrame, parts: int, width: int) -> DataFrame:
    """Staged (part, n, leaves, weights): a trie for each part of each batch."""
    names = ["part", "n", "leaves", "weights"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = [leaves(p) for p in _cut(matrix(batch.column(0), width), parts)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(parts), pa.int32()),
                    pa.array([len(m[0]) for m in made], pa.int64()),
                    pa.array([m[0].astype("<i4").tobytes() for m in made], pa.binary()),
                    pa.array([m[2].astype("<i8").tobytes() for m in made], pa.binary()),
                ],
                names,
            )

    return stage(vectors.select("v").mapInArrow(run, "part int, n long, leaves binary, weights binary"), "tries")


def _round(tries: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The entries after one round."""
    parts, count, size = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, count, size), np.int64), np.zeros((parts, count), np.int64)
        for batch in batches:
            for part, n, data, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(data, "<i4").reshape(n, size).astype(np.int64)
                weight = np.frombuffer(weights, "<i8")
                nearest, _ = traverse(own, entries[part])
                np.add.at(counts[part], nearest, weight)
                np.add.at(sums[part], nearest, own * weight[:, None])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part, pa.int32()),
                pa.array(entry, pa.int32()),
                pa.array(counts[part, entry], pa.int64()),
                pa.array(sums[part, entry].tolist(), pa.list_(pa.int64())),
            ],
            ["part", "entry", "n", "sums"],
        )

    found = tries.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    totals = found.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size))
    )
    out = entries.copy()
    for row in totals.collect():  # a row for each used entry
        out[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(size)]
    return out


def _vectors(rows: DataFrame, row_id: str, vector: str, label: str, scale: int) -> DataFrame:
    return stage(whole_vectors(rows, vector, scale, id=col(row_id).cast("long"), label=col(label)), "whole_vectors")


def _learn(vectors: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> Codebooks:
    n, size = longest(vectors)
    width = max(1, -(-size // parts)) * parts
    start = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    books = _cut(matrix(start["v"], width), parts) if n else np.zeros((parts, 0, width // parts), np.int64)
    if n:
        tries = _tries(vectors, parts, width)
        for _ in range(rounds):
            books = _round(tries, books)
    return Codebooks(books, scale)


def learn(
    rows: DataFrame,
    row_id: str = "vec_id",
    vector: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> Codebooks:
    """Codebooks of the vectors: ``rounds`` rounds from the ``entries`` smallest ids."""
    return _learn(_vectors(rows, row_id, vector, row_id, scale), parts, entries, rounds, scale)


def _encoded(vectors: DataFrame, books: Codebooks) -> DataFrame:
    parts, count, size = books.entries.shape
    if count > 256:
        raise ValueError("a code has one byte for each part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = np.zeros((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, np.int64)
            if batch.num_rows:
                for i, own in enumerate(_cut(matrix(batch.column(2), parts * size), parts)):
                    distinct, place, _ = leaves(own)
                    nearest, distance = traverse(distinct, books.entries[i])
                    codes[:, i] = nearest[place]
                    error += distance[place]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.int64())],
                ["id", "label", "codes", "error"],
            )

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("id", "label", "v").mapInArrow(run, f"id long, label {kind}, codes binary, error long")


def encode(
    rows: DataFrame, books: Codebooks, row_id: str = "vec_id", vector: str = "embedding", label: str | None = None
) -> DataFrame:
    """(id, label, codes, error) of the vectors that take part: a byte for each part."""
    named = whole_vectors(rows, vector, books.scale, id=col(row_id).cast("long"), label=col(label or row_id))
    return _encoded(named, books)


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """(id, vector) of (id, codes): the joined entries, scaled back."""
    parts = books.entries.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            back = books.entries[np.arange(parts), own].reshape(len(own), -1) / books.scale
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(back), pa.list_(pa.float64()))], ["id", "vector"])

    return codes.select("id", "codes").mapInArrow(run, "id long, vector array<double>")


def compress(
    rows: DataFrame,
    row_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the vectors that take part.

    ``code`` has two hex digits for each part, ``error`` is the squared distance
    to the coded vector in whole numbers, ``label_error`` its sum over the rows
    of one label, null labels together. Vectors that are null or hold null or
    non-finite components take no part; shorter ones end in zeros, up to a
    multiple of ``parts``; scaled components end at 2 ** 26. Repeated rows are
    rows of their own; null ids come last, rows with one id start in the order
    of their vectors. With fewer vectors than ``entries`` the codebooks are
    shorter; without any there are no rows.
    """
    vectors = _vectors(rows, row_id, vector, label, scale)
    books = _learn(vectors, parts, entries, rounds, scale)
    coded = stage(_encoded(vectors, books), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("vec_id"),
        F.lower(F.hex("codes")).alias("code"),
        "error",
        "label_error",
        F.lit(books.digest()).alias("codebooks_sha256"),
    )
