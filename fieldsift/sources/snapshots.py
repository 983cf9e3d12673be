"""A small table kept as numbered snapshots, each published when it is complete.

A snapshot belongs to a batch. A batch that is repeated starts from the last
snapshot before it, so it adds nothing twice.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import files

POINTERS = "_snapshots"


def _folder(spark: SparkSession, path: str, before: int | None) -> str | None:
    """Folder of the newest snapshot, or of the newest one before a batch."""
    known = files.newest(spark, f"{path}/{POINTERS}")
    batches = [int(b) for b in known if before is None or int(b) < before]
    if not batches:
        return None
    key = f"{max(batches):012d}"
    text = files.read_text(spark, files.version_path(f"{path}/{POINTERS}", key, known[key]))
    return f"{path}/{json.loads(text)['folder']}"


def read_snapshot(
    spark: SparkSession, path: str, schema: str, before: int | None = None
) -> DataFrame:
    """The newest snapshot, or the newest one before a batch; empty if there is none."""
    folder = _folder(spark, path, before)
    if folder is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def write_snapshot(table: DataFrame, path: str, batch_id: int) -> None:
    """Publish ``table`` as the state after a batch."""
    folder = f"batch-{batch_id:012d}-{uuid.uuid4().hex}"
    # A few rows: one file.
    table.coalesce(1).write.parquet(f"{path}/{folder}")
    files.publish(
        table.sparkSession, f"{path}/{POINTERS}", f"{batch_id:012d}", json.dumps({"folder": folder})
    )
