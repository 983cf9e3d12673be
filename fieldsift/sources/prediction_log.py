"""The prediction log: an append-only set of files in CSV and in JSON lines.

Files are laid out as ``<path>/log_date=<day>/batch_id=<id>/attempt=<id>``.
Readers take what a manifest names, one small file per batch that is written
after all of the batch's files, for both logs together. So a write that fails
half-way changes neither log, and a batch that is written again is replaced as a
whole, by a manifest with a larger number.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from . import files
from .notes import CSV_OPTIONS, path_missing

LOG_COLUMNS = ["timestamp", "input_note", "issue_category"]
LOG_SCHEMA = "timestamp timestamp_ntz, input_note string, issue_category string"
LAYOUT_SCHEMA = LOG_SCHEMA + ", batch_id string, log_date date"

# Folders of the manifests, and of notes where a log's manifests lie.
MANIFESTS, LINKS = "_manifests", "_linked"
MANIFEST_SCHEMA = "batch_id string, attempt string, days map<string, array<string>>"

_ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_ISO = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def log_rows(predictions: DataFrame, at: Column | None = None) -> DataFrame:
    """Log columns of predictions, stamped with the current time or ``at``."""
    stamp = F.localtimestamp() if at is None else at
    return predictions.select(
        stamp.cast("timestamp_ntz").alias("timestamp"), "input_note", "issue_category"
    )


def _write(rows: DataFrame, path: str, batch_id: str, attempt: str, file_format: str) -> None:
    """Write rows where no reader looks before they are published."""
    writer = (
        rows.select(
            *LOG_COLUMNS,
            F.to_date("timestamp").alias("log_date"),
            F.lit(batch_id).alias("batch_id"),
            F.lit(attempt).alias("attempt"),
        )
        .write.partitionBy("log_date", "batch_id", "attempt")
        .mode("append")
        .option("timestampNTZFormat", _ISO_MICROS)
    )
    if file_format == "csv":
        # A missing cell is left empty; empty text is quoted.
        writer = writer.options(**CSV_OPTIONS).option("emptyValue", '""')
    writer.format(file_format).save(path)


def _days(spark: SparkSession, path: str, batch_id: str, attempt: str) -> list[str]:
    """Names of the days that an attempt has written to."""
    fs, root = files.hadoop_path(spark, path)
    pattern = spark._jvm.org.apache.hadoop.fs.Path(root, f"log_date=*/batch_id={batch_id}/attempt={attempt}")
    found = fs.globStatus(pattern) or []
    return sorted(status.getPath().getParent().getParent().getName() for status in found)


def _save(
    rows: DataFrame, paths: dict[str, str], batch_id: str | None
) -> None:
    """Write rows in each format, then publish all of them by one manifest.

    The manifest lies in the last path; the others hold a note of that folder.
    """
    spark = rows.sparkSession
    if batch_id is None:
        batch_id = uuid.uuid4().hex
    elif not re.fullmatch(r"[A-Za-z0-9_-]+", batch_id):
        raise ValueError(f"a batch id has letters, digits, _ and - only: {batch_id!r}")
    attempt = uuid.uuid4().hex
    home = files.full_path(spark, list(paths.values())[-1])
    for path in paths.values():
        if files.full_path(spark, path) != home:
            name = hashlib.sha256(home.encode()).hexdigest()
            files.write_new(spark, f"{path}/{LINKS}", name, home)
    for file_format, path in paths.items():
        _write(rows, path, batch_id, attempt, file_format)
    days = {
        files.full_path(spark, path): _days(spark, path, batch_id, attempt) for path in paths.values()
    }
    manifest = {"batch_id": batch_id, "attempt": attempt, "days": days}
    files.publish(spark, f"{home}/{MANIFESTS}", batch_id, json.dumps(manifest))


def append_csv(rows: DataFrame, path: str, batch_id: str | None = None) -> None:
    """Add log rows to the CSV log."""
    _save(rows, {"csv": path}, batch_id)


def append_jsonl(rows: DataFrame, path: str, batch_id: str | None = None) -> None:
    """Add log rows to the JSON lines log."""
    _save(rows, {"json": path}, batch_id)


def save_predictions(
    rows: DataFrame, csv_path: str, jsonl_path: str, batch_id: str | None = None
) -> DataFrame:
    """Add log rows to both logs, to both or to none, and return them.

    The rows are staged first, so both logs hold the same time stamps and the
    predictions are computed once. One manifest publishes them in both.
    """
    rows = stage(rows.select(*LOG_COLUMNS), "log-rows")
    _save(rows, {"csv": csv_path, "json": jsonl_path}, batch_id)
    return rows


def _published(spark: SparkSession, path: str) -> list[tuple[str, str]] | None:
    """(day, folder) of what is published in a log; None for a log without manifests.

    A batch that has been published again counts in its newest version alone.
    """
    own = files.full_path(spark, path)
    homes = [own, *(files.read_text(spark, f"{own}/{LINKS}/{n}") for n in files.names(spark, f"{own}/{LINKS}"))]
    found: dict[tuple[str, str], int] = {}
    for home in homes:
        for batch, number in files.newest(spark, f"{home}/{MANIFESTS}").items():
            found[home, batch] = number
    if not found:
        return None
    paths = [files.version_path(f"{home}/{MANIFESTS}", batch, n) for (home, batch), n in found.items()]
    rows = spark.read.schema(MANIFEST_SCHEMA).json(paths).select("batch_id", "attempt", F.col("days")[own].alias("days"))
    return [
        (day, f"{own}/{day}/batch_id={r['batch_id']}/attempt={r['attempt']}")
        for r in rows.collect()
        for day in r["days"] or []
    ]


def _read(
    spark: SparkSession, path: str, file_format: str, folders: list[str] | None = None
) -> DataFrame:
    """The published rows of the log at ``path``, or only the ``folders`` below it."""
    if folders is None and (published := _published(spark, path)) is not None:
        folders = [folder for _, folder in published]
    if folders == []:
        return spark.createDataFrame([], LAYOUT_SCHEMA)
    reader = (
        spark.read.schema(LAYOUT_SCHEMA)
        .option("mode", "FAILFAST")
        .option("timestampNTZFormat", _ISO)
    )
    if file_format == "csv":
        # Stands for a cell left empty, so that quoted empty text stays text.
        reader = reader.options(**CSV_OPTIONS).option("nullValue", "\0")
    try:
        found = reader.format(file_format).option("basePath", path).load(folders or path)
    except AnalysisException as error:
        if path_missing(error):
            return spark.createDataFrame([], LAYOUT_SCHEMA)
        raise
    return found.select(*LOG_COLUMNS, "batch_id", "log_date")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The JSON lines log; empty if there is none, an error on a broken line."""
    return _read(spark, path, "json")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The CSV log; empty if there is none."""
    return _read(spark, path, "csv")


def read_newest(
    spark: SparkSession, path: str, rows: int, file_format: str = "json"
) -> DataFrame:
    """The newest days of a log that hold at least ``rows`` rows, or all of it.

    A log is ``json`` or ``csv``. Days are added in doubling numbers, and each
    trial counts no more than ``rows`` rows. Rows without a time stamp are the
    oldest.
    """
    published = _published(spark, path)
    if published is None:
        published = [(n, f"{path}/{n}") for n in files.names(spark, path) if n.startswith("log_date=")]
    by_day: dict[str, list[str]] = {}
    for day, folder in published:
        if re.fullmatch(r"log_date=\d+-\d\d-\d\d", day):
            by_day.setdefault(day, []).append(folder)
    newest_first = sorted(by_day, reverse=True)
    days = 1
    while days < len(newest_first):
        folders = [folder for day in newest_first[:days] for folder in by_day[day]]
        newest = _read(spark, path, file_format, folders)
        if newest.limit(rows).count() >= rows:
            return newest
        days *= 2
    return _read(spark, path, file_format)


def drop_unpublished(spark: SparkSession, path: str) -> int:
    """Delete what failed or replaced writes left in a log; the folders dropped.

    To be run while nobody writes to or reads from the log.
    """
    published = _published(spark, path)
    if published is None:
        return 0
    kept = {folder for _, folder in published}
    fs, root = files.hadoop_path(spark, path)
    pattern = spark._jvm.org.apache.hadoop.fs.Path(root, "log_date=*/batch_id=*/attempt=*")
    stale = [s.getPath().toString() for s in fs.globStatus(pattern) or []]
    stale = [folder for folder in stale if folder not in kept]
    for folder in stale:
        files.delete(spark, folder)
    return len(stale)
