"""A filter of terms that two notes or more hold: two bits for each slot of a hash.

Each task counts its notes' terms by slot, up to two, in a fixed table of bits;
tables are added up to two, first in groups and then as a whole. A term whose
slot was met once is in one note only and needs no shuffle to be dropped. Slots
are shared, so a few other terms pass as well, which costs work but no result.
The table has SLOTS entries whatever the number of terms: beyond that many
distinct terms it drops fewer of them.

Slots of the sums that ``features`` keeps are made of the hashes of a gram's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

SLOTS = 1 << 24
# Slots of a row of the filter, and groups that tables are first added in.
CHUNK, GROUPS = 1 << 15, 64
# Slots that occurrences are summed by, and odd numbers that mix two words.
SUMS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
PARTS = "chunk int, part int, once binary, twice binary"


def slot(term: Column) -> Column:
    return F.xxhash64(term).bitwiseAND(SLOTS - 1).cast("int")


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table of one task, by chunk, from lists of slots."""
    seen = np.zeros(SLOTS, np.uint8)
    for batch in batches:
        found, times = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
        seen[found] = np.minimum(2, seen[found] + np.minimum(times, 2)).astype(np.uint8)
    rows = seen.reshape(-1, CHUNK)
    used = np.flatnonzero(rows.any(axis=1))
    part = TaskContext.get().partitionId() % GROUPS
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(used, pa.int32()),
            pa.array([part] * len(used), pa.int32()),
            *(pa.array([np.packbits(rows[i] >= n, bitorder="little").tobytes() for i in used], pa.binary()) for n in (1, 2)),
        ],
        ["chunk", "part", "once", "twice"],
    )


def _added(parts: pa.Table) -> pa.Table:
    """The sum of tables of one chunk."""
    once, twice = np.zeros(CHUNK // 8, np.uint8), np.zeros(CHUNK // 8, np.uint8)
    for a, b in zip(parts["once"].to_pylist(), parts["twice"].to_pylist(), strict=True):
        a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        twice |= b | (once & a)
        once |= a
    return pa.table(
        {
            "chunk": pa.array([parts["chunk"][0].as_py()], pa.int32()),
            "part": pa.array([0], pa.int32()),
            "once": [once.tobytes()],
            "twice": [twice.tobytes()],
        }
    )


def _words(parts: pa.Table) -> pa.Table:
    bits = np.frombuffer(_added(parts)["twice"][0].as_py(), np.int64)
    return pa.table({"chunk": pa.array([parts["chunk"][0].as_py()], pa.int32()), "words": [bits.tolist()]})


def met_twice(terms: DataFrame, column: str) -> DataFrame:
    """(chunk, words) of the slots of terms that occur in two rows or more.

    ``column`` holds the distinct terms of a row. At most SLOTS / CHUNK rows.
    """
    tables = terms.select(F.transform(column, slot).alias("slots")).mapInArrow(_tables, PARTS)
    grouped = tables.groupBy("chunk", "part").applyInArrow(_added, PARTS)
    return stage(grouped.groupBy("chunk").applyInArrow(_words, "chunk int, words array<long>"), "met_twice")


def keep_met_twice(rows: DataFrame, term: str, met: DataFrame) -> DataFrame:
    """The rows whose ``term`` passes the filter."""
    at = slot(F.col(term))
    # A bounded number of rows, see met_twice.
    bounded = F.broadcast(met.select(F.col("chunk").alias("_chunk"), "words"))
    word = F.get("words", F.shiftright(at.bitwiseAND(CHUNK - 1), 6))
    return (
        rows.join(bounded, F.shiftright(at, CHUNK.bit_length() - 1) == F.col("_chunk"))
        .where(F.getbit(word, at.bitwiseAND(63)) == 1)
        .drop("_chunk", "words")
    )


def pair_slots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Slots of grams by the 64-bit hashes of their two words, 0 for none."""
    mixed = first * _MIX[0] + second * _MIX[1]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[2]
    return (mixed >> np.uint64(64 - SUMS.bit_length() + 1)).astype(np.int32)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes, the same in all tasks."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def slots_of(terms: list[str]) -> np.ndarray:
    """A table of SUMS truth values: which slots hold one of the terms."""
    pairs = [(*t.split(" "), None)[:2] for t in terms]
    first, second = (pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1))
    after = np.where(second.is_null().to_numpy(zero_copy_only=False), np.uint64(0), word_hashes(second.fill_null("")))
    wanted = np.zeros(SUMS, bool)
    wanted[pair_slots(word_hashes(first), after)] = True
    return wanted


__all__ = ["keep_met_twice", "met_twice", "pair_slots", "slot", "slots_of", "word_hashes"]
