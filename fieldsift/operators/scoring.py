"""Choosing one result per note from several scoring methods."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import FALLBACK_METHOD, PRIMARY_METHOD
from ..functions.labels import parse_category
from ..functions.prompts import latency_text, reasoning

OUTPUT_SCHEMA = "note_id long, raw_output string, latency_seconds double, error string"
# Faults of the caller's code: these fail the job.
PROGRAMMING_ERRORS = (TypeError, NameError, AttributeError, ImportError, LookupError, AssertionError)
RESULT = ["issue_category", "confidence", "latency_seconds"]


def generate_outputs(
    prompts: DataFrame, generate: Callable[[list[str]], list[str]]
) -> DataFrame:
    """Raw outputs of a model for (note_id, prompt): OUTPUT_SCHEMA.

    ``generate`` answers a list of prompts; it runs in the tasks, on one Arrow
    batch after the other. A batch that it fails on gets NULL outputs and the
    ``error``, which leaves its notes to the next method; PROGRAMMING_ERRORS and
    a wrong number of answers fail the job. The latency of a note is its share
    of the batch's time.
    """

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            start = time.perf_counter()
            error = None
            try:
                outputs = list(generate(batch["prompt"].tolist()))
            except PROGRAMMING_ERRORS:
                raise
            except Exception as failure:
                outputs = [None] * len(batch)
                error = f"{type(failure).__name__}: {failure}"
            if len(outputs) != len(batch):
                raise AssertionError(f"{len(outputs)} answers to {len(batch)} prompts")
            share = (time.perf_counter() - start) / max(len(batch), 1)
            yield pd.DataFrame(
                {
                    "note_id": batch["note_id"],
                    "raw_output": outputs,
                    "latency_seconds": share,
                    "error": pd.Series([error] * len(batch), dtype=object),
                }
            )

    return prompts.select("note_id", "prompt").mapInPandas(answer, OUTPUT_SCHEMA)


def parsed_results(outputs: DataFrame) -> DataFrame:
    """Results from raw outputs (note_id, raw_output, latency_seconds).

    Output of NULL means that the method failed on the note; it gives no row.
    """
    return (
        outputs.where(F.col("raw_output").isNotNull())
        .withColumn("parsed", parse_category(F.col("raw_output")))
        .select(
            "note_id",
            F.col("parsed.category").alias("issue_category"),
            F.col("parsed.confidence").alias("confidence"),
            "latency_seconds",
        )
    )


def tiered_scores(notes: DataFrame, tiers: dict[str, DataFrame]) -> DataFrame:
    """The first method's result for each note, else the next one's, and so on.

    ``tiers`` maps method names, best first, to (note_id, issue_category,
    confidence, latency_seconds) with one row per note at most. A note without
    any result stays, with NULLs and ``scored`` false.
    """
    # Texts stay behind: only ids and results are joined.
    joined = notes.select("note_id")
    for i, (method, results) in enumerate(tiers.items()):
        joined = joined.join(
            results.select(
                "note_id", F.struct(F.lit(method).alias("method"), *RESULT).alias(f"tier{i}")
            ),
            "note_id",
            "left",
        )
    best = F.coalesce(*[F.col(f"tier{i}") for i in range(len(tiers))])
    return joined.select("note_id", best.alias("best")).select(
        "note_id", "best.*", F.col("best").isNotNull().alias("scored")
    )


def primary_then_fallback(
    notes: DataFrame, primary: DataFrame, fallback: DataFrame
) -> DataFrame:
    """:func:`tiered_scores` of the two usual methods."""
    return tiered_scores(notes, {PRIMARY_METHOD: primary, FALLBACK_METHOD: fallback})


def explain_scores(scores: DataFrame) -> DataFrame:
    """Add ``latency_text`` and ``reasoning`` to scores."""
    method, latency = F.col("method"), F.col("latency_seconds")
    return scores.withColumns(
        {
            "latency_text": latency_text(method, latency),
            "reasoning": reasoning(
                method, F.col("issue_category"), F.col("confidence"), latency
            ),
        }
    )
