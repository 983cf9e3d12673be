"""Streaming classification to the log, and live counts from a log stream.

A micro-batch that is repeated after a failure replaces itself everywhere, so a
restart adds nothing and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.labels import parse_category
from ..operators.history import category_counts
from ..plans.predict import predict_notes, predict_tiered, rejected_input
from ..session import scratch, stage
from ..sources import artifacts, files
from ..sources.prediction_log import log_rows, save_predictions
from ..sources.snapshots import read_snapshot, write_snapshot

COUNTS_SCHEMA = "issue_category string, n long"
RESULT_SCHEMA = (
    "note_id long, input_note string, status string, issue_category string, confidence double, "
    "method string, latency_seconds double, latency_text string, reasoning string, "
    "model_version long, batch_id string"
)


def _name(batch_id: int) -> str:
    return f"stream-{batch_id:012d}"


def _start(
    rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _write_rejects(batch: DataFrame, path: str, name: str) -> None:
    rejected_input(batch).write.mode("overwrite").json(f"{path}/batch_id={name}")


def classify_stream(
    notes: DataFrame,
    csv_path: str,
    jsonl_path: str,
    checkpoint: str,
    scorer: Callable[[Column], Column] = parse_category,
    rejects_path: str | None = None,
) -> StreamingQuery:
    """Predict every note available and add it to both logs.

    Notes that break the contract go to ``rejects_path`` as JSON lines of
    (note_id, input_note, status), by default ``<jsonl_path>-rejects``.
    """
    rejects = rejects_path or f"{jsonl_path}-rejects"

    def write(batch: DataFrame, batch_id: int) -> None:
        name = _name(batch_id)
        predicted = predict_notes(batch, scorer).where("status = 'ok'")
        with scratch(batch.sparkSession):
            save_predictions(log_rows(predicted), csv_path, jsonl_path, name)
        _write_rejects(batch, rejects, name)

    return _start(notes, write, checkpoint)


def _pinned_version(spark: SparkSession, model_path: str, checkpoint: str, name: str) -> int:
    """The model version of a batch: the current one when it is first tried."""
    folder = f"{checkpoint}-models"
    current = artifacts.current_version(spark, model_path)
    if current is None:
        raise artifacts.ArtifactNotFoundError(model_path)
    pin = f"{name}.000000001.json"
    if pin not in files.names(spark, folder):
        files.write_new(spark, folder, pin, str(current))
    return int(files.read_text(spark, f"{folder}/{pin}"))


def classify_stream_tiered(
    notes: DataFrame,
    model_path: str,
    csv_path: str,
    jsonl_path: str,
    results_path: str,
    checkpoint: str,
    outputs: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Predict notes by the primary method, else by the saved classifier.

    ``outputs`` makes the primary method's (note_id, raw_output,
    latency_seconds) for the notes of a micro-batch, by a model hook or from a
    table; without it the classifier answers alone. Each micro-batch takes the
    newest version of the classifier at ``model_path`` and keeps it when it is
    repeated, so no batch mixes versions. All notes go to ``results_path``
    (RESULT_SCHEMA, those that break the contract with their reason), the
    others to both logs as well.
    """
    loaded: dict[int, object] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        name, spark = _name(batch_id), batch.sparkSession
        version = _pinned_version(spark, model_path, checkpoint, name)
        if version not in loaded:
            loaded.clear()
            loaded[version] = artifacts.load_classifier(spark, model_path, version)
        with scratch(spark):
            # Read once: both the outputs and the answers come from these notes.
            rows = stage(batch.select("note_id", "rep_note"), "stream-notes")
            found = predict_tiered(rows, loaded[version], outputs(rows) if outputs else None)
            found = found.withColumn("model_version", F.lit(version).cast("bigint"))
            folder = f"{results_path}/batch_id={name}"
            found.write.mode("overwrite").parquet(folder)
            results = spark.read.schema(RESULT_SCHEMA).parquet(folder)
            save_predictions(log_rows(results.where("status = 'ok'")), csv_path, jsonl_path, name)

    return _start(notes, write, checkpoint)


def read_results(spark: SparkSession, results_path: str) -> DataFrame:
    """What :func:`classify_stream_tiered` has written."""
    return spark.read.schema(RESULT_SCHEMA).parquet(results_path)


def count_stream(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the log's counts per category in a table at ``path``.

    A micro-batch adds its counts to the snapshot before it and publishes the
    sum; see :func:`read_counts`. The table has one row per category.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        known = read_snapshot(batch.sparkSession, path, COUNTS_SCHEMA, batch_id)
        both = category_counts(batch).unionByName(known)
        write_snapshot(both.groupBy("issue_category").agg(F.sum("n").alias("n")), path, batch_id)

    return _start(log, write, checkpoint)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest counts: (issue_category, n); empty before the first batch."""
    return read_snapshot(spark, path, COUNTS_SCHEMA)
