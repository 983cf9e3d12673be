"""Helpers of the pipeline operators: tables, column names, staging, files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsift import session
from fieldsift.session import stage
from fieldsift.sources.files import full_path, store

__all__ = ["col", "files", "fresh", "new_file", "shared_path", "splitmix", "stage", "store", "table"]

# The white space of the contracts: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use, whatever the case of its names."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def splitmix(n: int) -> np.uint64:
    """The n-th of a fixed sequence of 64-bit mixing constants."""
    mask = (1 << 64) - 1
    z = (n * 0x9E3779B97F4A7C15) & mask
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
    return np.uint64(z ^ (z >> 31))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, with its file system, as every task resolves it."""
    return full_path(spark, session.shared_path(spark, name))


@contextmanager
def new_file(uri: str) -> Iterator[pa.NativeFile]:
    """A file that appears under its name only when it is complete.

    A task that is run twice writes the same file twice; the last one stays.
    """
    fs, path = store(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as file:
        yield file
    fs.move(part, path)


def files(written: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The staged list of files that tasks have written, and their number."""
    listed = stage(written, name)
    return listed, listed.count()
