"""From incoming notes to logged predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import FALLBACK_METHOD, PRIMARY_METHOD
from ..functions.labels import parse_category
from ..functions.text import clean_note
from ..operators.contracts import note_status
from ..operators.model import NoteClassifier
from ..operators.scoring import RESULT, explain_scores, parsed_results
from ..session import stage

KEYWORD_METHOD = "keyword"


def rejected_input(notes: DataFrame) -> DataFrame:
    """Notes that break the note contract: (note_id, input_note, status)."""
    return notes.select(
        "note_id",
        F.col("rep_note").alias("input_note"),
        note_status(F.col("rep_note")).alias("status"),
    ).where(F.col("status") != "ok")


def predict_notes(
    notes: DataFrame,
    scorer: Callable[[Column], Column] = parse_category,
    method: str = KEYWORD_METHOD,
) -> DataFrame:
    """Check, clean and score notes, each within its row; one row per note.

    ``scorer`` turns a cleaned note into a struct with category and confidence.
    The result keeps the note as it came: (note_id, input_note, status,
    cleaned_note, issue_category, confidence, method). A note that breaks the
    contract has its reason as status and NULLs after it.
    """
    note, ok = F.col("rep_note"), F.col("status") == "ok"
    return (
        notes.select("note_id", note.alias("input_note"), note_status(note).alias("status"))
        .withColumn("cleaned_note", F.when(ok, clean_note(F.col("input_note"))))
        .withColumn("result", F.when(ok, scorer(F.col("cleaned_note"))))
        .select(
            "note_id",
            "input_note",
            "status",
            "cleaned_note",
            F.col("result.category").alias("issue_category"),
            F.col("result.confidence").alias("confidence"),
            F.when(ok, method).alias("method"),
        )
    )


def predict_tiered(
    notes: DataFrame, classifier: NoteClassifier, outputs: DataFrame | None = None
) -> DataFrame:
    """Predict notes by the primary method's outputs, else by the fitted classifier.

    ``outputs`` has (note_id, raw_output, latency_seconds), one row per note at
    most; NULL output or no row leaves the note to the classifier. One row per
    note: (note_id, input_note, status, issue_category, confidence, method,
    latency_seconds, latency_text, reasoning). A note that breaks the contract
    has its reason as status and NULLs after it. The classifier scores within
    the scan, so its notes have no latency of their own.
    """
    note = F.col("rep_note")
    checked = notes.select(
        "note_id", note.alias("input_note"), note_status(note).alias("status")
    )
    if outputs is None:
        schema = "note_id long, issue_category string, confidence double, latency_seconds double"
        primary = notes.sparkSession.createDataFrame([], schema)
    else:
        primary = parsed_results(outputs)
    answer = F.struct(F.lit(PRIMARY_METHOD).alias("method"), *RESULT).alias("first")
    joined = checked.join(primary.select("note_id", answer), "note_id", "left")
    # Notes that need no classifier go through it without their text.
    needed = (F.col("status") == "ok") & F.col("first").isNull()
    scored = classifier.predict(
        joined.withColumn("input", F.when(needed, F.col("input_note")).otherwise(""))
    )
    fallback = F.struct(
        F.lit(FALLBACK_METHOD).alias("method"),
        "issue_category",
        "confidence",
        F.lit(None).cast("double").alias("latency_seconds"),
    )
    best = F.when(F.col("status") == "ok", F.coalesce("first", fallback))
    rows = stage(scored.select("note_id", "input_note", "status", best.alias("best")), "tiers")
    return explain_scores(rows.select("note_id", "input_note", "status", "best.*")).select(
        "note_id", "input_note", "status", *RESULT[:2], "method", RESULT[2],
        "latency_text", "reasoning",
    )
