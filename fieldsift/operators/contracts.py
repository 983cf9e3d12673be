"""Checks on notes, batches and predictions; bad rows are flagged, not raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import MAX_BATCH_SIZE, MAX_NOTE_LENGTH, MIN_NOTE_LENGTH
from ..functions.text import is_blank


def note_status(
    note: Column, shortest: int = MIN_NOTE_LENGTH, longest: int = MAX_NOTE_LENGTH
) -> Column:
    """'ok', or the first rule the note breaks; length is judged before blankness."""
    n_chars = F.char_length(note)
    return (
        F.when(note.isNull(), "missing")
        .when(n_chars < shortest, "too_short")
        .when(n_chars > longest, "too_long")
        .when(is_blank(note), "blank")
        .otherwise("ok")
    )


def note_contract(
    df: DataFrame,
    note: str = "rep_note",
    shortest: int = MIN_NOTE_LENGTH,
    longest: int = MAX_NOTE_LENGTH,
) -> DataFrame:
    """Add ``n_chars``, ``within_length``, ``blank`` and ``status``."""
    text = F.col(note)
    n_chars = F.char_length(text).cast("bigint")
    return df.withColumns(
        {
            "n_chars": n_chars,
            "within_length": F.coalesce(n_chars.between(shortest, longest), F.lit(False)),
            "blank": is_blank(text),
            "status": note_status(text, shortest, longest),
        }
    )


def batch_contract(
    df: DataFrame,
    longest: int = MAX_NOTE_LENGTH,
    largest_batch: int = MAX_BATCH_SIZE,
) -> DataFrame:
    """One row per batch: size, first bad index and reason, ``accepted``.

    Expects (batch_id, idx, rep_note) with 0-based idx. The size is judged
    before the notes, and each note's length before its blankness.
    """
    note = F.col("rep_note")
    too_long = F.coalesce(F.char_length(note) > longest, F.lit(False))
    first_long = F.min(F.when(too_long, F.col("idx")))
    first_blank = F.min(F.when(~too_long & is_blank(note), F.col("idx")))
    return (
        df.groupBy("batch_id")
        .agg(
            F.count("*").alias("n_notes"),
            first_long.alias("first_long"),
            first_blank.alias("first_blank"),
        )
        .withColumn("fits", F.col("n_notes") <= largest_batch)
        .select(
            "batch_id",
            "n_notes",
            F.when(F.col("fits"), F.least("first_long", "first_blank")).alias(
                "first_bad_index"
            ),
            F.when(~F.col("fits"), "too_many_notes")
            .when(F.least("first_long", "first_blank") == F.col("first_long"), "too_long")
            .when(F.col("first_blank").isNotNull(), "blank")
            .alias("reason"),
            (
                F.col("fits")
                & F.col("first_long").isNull()
                & F.col("first_blank").isNull()
            ).alias("accepted"),
        )
    )


def batch_totals(df: DataFrame, latency: str = "latency_seconds") -> DataFrame:
    """Notes and summed latency per batch."""
    return df.groupBy("batch_id").agg(
        F.count("*").alias("total_notes"),
        F.sum(latency).alias("total_latency_seconds"),
    )


def prediction_contract(df: DataFrame) -> DataFrame:
    """Add ``in_range`` (confidence from 0 to 1) and ``valid`` (also complete)."""
    in_range = F.coalesce(
        F.col("confidence").between(0.0, 1.0) & ~F.isnan("confidence"), F.lit(False)
    )
    return df.withColumns(
        {
            "in_range": in_range,
            "valid": in_range
            & F.col("issue_category").isNotNull()
            & F.col("method").isNotNull(),
        }
    )
