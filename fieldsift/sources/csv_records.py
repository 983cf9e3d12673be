"""Multi-line CSV in many tasks: records are cut by the parity of quotes.

A line break ends a record if the quotes before it are even in number. Files are
read as lines, block by block, so no task sees what lies before its block. A
first pass over the lines' parities alone gives for each block, for both states
that it may begin in, how many records begin there and in what state it ends; a
running sum over the blocks, one row each, then tells the state at the start of
every block and the number of records before it. The second pass cuts records
and numbers them. Only records that cross the end of a block are put together
by a shuffle. Numbers follow the order of paths and of records in a file,
whatever the size of the blocks.

Quotes inside a quoted cell are doubled, and cells that hold a quote are quoted;
records end with \\n or \\r\\n. Line breaks in cells stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Blocks whose facts are shipped to every task, some hundred bytes each. A larger
# spark.sql.files.maxPartitionBytes makes fewer.
MOST_BLOCKS = 1_000_000
# Column of the records' numbers.
NUMBER = "_record"
FACTS = "file string, block long, odd boolean, begins array<long>, closes array<boolean>"
BLOCK = "file string, block long, part long, inside boolean, base long, open long, headed boolean"
PIECES = "note_id long, part long, whole boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, odd, blank, line) in the order of each block."""
    lines = spark.read.option("lineSep", "\n").text(path)
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        (quotes % 2 == 1).alias("odd"),
        F.col("value").isin("", "\r").alias("blank"),
        F.col("value").alias("line"),
    )


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FACTS of each block from (file, block, odd, blank)."""
    found: dict[tuple[str, int], list] = {}
    for batch in batches:
        odd = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        blank = batch.column(3).to_numpy(zero_copy_only=False)
        for key, low, high in _stretches(batch.column(0), batch.column(1)):
            state = found.setdefault(key, [0, [0, 0], [False, False]])
            after = (np.cumsum(odd[low:high]) + state[0]) % 2
            before = np.concatenate([[state[0]], after[:-1]])
            for inside in (0, 1):
                state[1][inside] += int(((before == inside) & ~blank[low:high]).sum())
                state[2][inside] |= bool((after == inside).any())
            state[0] = int(after[-1])
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in found], pa.string()),
            pa.array([k[1] for k in found], pa.int64()),
            pa.array([bool(v[0]) for v in found.values()], pa.bool_()),
            pa.array([v[1] for v in found.values()], pa.list_(pa.int64())),
            pa.array([v[2] for v in found.values()], pa.list_(pa.bool_())),
        ],
        ["file", "block", "odd", "begins", "closes"],
    )


def _stretches(files: pa.Array, blocks: pa.Array) -> Iterator[tuple[tuple[str, int], int, int]]:
    """(key, first row, last row) of rows of one block next to each other."""
    n = len(files)
    if not n:
        return
    names = files.dictionary_encode()
    code, start = names.indices.to_numpy(), blocks.to_numpy()
    cuts = np.flatnonzero((code[1:] != code[:-1]) | (start[1:] != start[:-1])) + 1
    edges = [0, *cuts.tolist(), n]
    for low, high in zip(edges, edges[1:], strict=False):
        yield (names.dictionary[int(code[low])].as_py(), int(start[low])), low, high


def _plan(rows: list) -> list[tuple]:
    """BLOCK of every block from the facts of all blocks."""
    out, total, file = [], 0, None
    for part, row in enumerate(sorted(rows, key=lambda r: (r["file"], r["block"]))):
        if row["file"] != file:
            file, inside, headed, opened = row["file"], False, False, None
        begins = row["begins"][int(inside)]
        # The first record of a file is its header and has no number.
        header = not headed and begins > 0
        base = total - header
        out.append((row["file"], row["block"], part, inside, base, opened, header))
        total = base + begins
        headed |= header
        ends_inside = inside != row["odd"]
        if ends_inside and (row["closes"][1] or not inside):
            # Open at the end is the last record that begins here.
            opened = None if header and begins == 1 else total - 1
        inside = ends_inside
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PIECES from (part, inside, base, open, headed, odd, line): records, or their parts in a block."""
    held: list[str] = []
    part = None
    state = number = opened = 0
    headed = head = False

    def piece(whole: bool, text: str, own: int | None) -> None:
        if own is not None:
            out.append((own, part, whole, text))

    for batch in batches:
        out: list[tuple] = []
        parts, inside, base, opens, heads, odd = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:6])
        lines = batch.column(6).to_pylist()
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low == high:
                continue
            if parts[low] != part:
                if held:
                    piece(False, "\n".join(held), opened if head else None if headed else number)
                held, part, state = [], int(parts[low]), int(inside[low])
                number, headed, head = int(base[low]), bool(heads[low]), bool(inside[low])
                opened = None if np.isnan(float(opens[low])) else int(opens[low])
            after = (np.cumsum(odd[low:high].astype(np.int64)) + state) % 2
            state = int(after[-1])
            at = low
            for end in (np.flatnonzero(after == 0) + low + 1).tolist():
                text = lines[at] if end == at + 1 and not held else "\n".join([*held, *lines[at:end]])
                held, at = [], end
                if head:
                    piece(False, text, opened)
                    head = False
                elif text not in ("", "\r"):
                    piece(True, text, None if headed else number)
                    number, headed = number + 1, False
            held += lines[at:high]
        yield _pieces(out)
    if held:
        out = []
        piece(False, "\n".join(held), opened if head else None if headed else number)
        yield _pieces(out)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["note_id", "part", "whole", "record"]
    )


def read_csv_records(spark: SparkSession, path: str, options: dict[str, str]) -> DataFrame:
    """(NUMBER, columns...) of CSV files with a header, cells as text.

    ``options`` are Spark's; quotes and escapes are double quotes. Columns are
    those of the first file. Records are numbered from 0. Blank lines are
    skipped.
    """
    columns = spark.read.options(**options).csv(path).columns
    lines = _lines(spark, path)
    facts = lines.select("file", "block", "odd", "blank").mapInArrow(_facts, FACTS).collect()
    if len(facts) > MOST_BLOCKS:
        raise ValueError(f"{len(facts)} blocks: set spark.sql.files.maxPartitionBytes higher")
    # Broadcast, so that the lines of a block stay in order.
    plan = F.broadcast(spark.createDataFrame(_plan(facts), BLOCK))
    pieces = (
        lines.join(plan, ["file", "block"])
        .select("part", "inside", "base", "open", "headed", "odd", "line")
        .mapInArrow(_cut, PIECES)
    )
    crossing = pieces.where(~F.col("whole")).groupBy("note_id").agg(
        F.array_sort(F.collect_list(F.struct("part", "record"))).alias("parts")
    )
    records = pieces.where("whole").select("note_id", "record").unionByName(
        crossing.select("note_id", F.array_join(F.col("parts.record"), "\n").alias("record"))
    )
    schema = StructType([StructField(c, StringType()) for c in columns])
    cells = F.from_csv(F.regexp_replace("record", r"\r\z", ""), _ddl(schema), {**options, "header": "false"})
    return records.select(F.col("note_id").alias(NUMBER), cells.alias("cells")).select(NUMBER, "cells.*")


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)
