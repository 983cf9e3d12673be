"""Labelled notes: validity, mapping, duplicates, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import CATEGORY_MAP, MIN_VALID_RECORDS
from ..functions.labels import lookup, map_category, raw_label_key
from ..functions.text import is_blank, py_strip


def reject_reason(
    note: Column, label: Column, mapping: dict[str, str] = CATEGORY_MAP
) -> Column:
    """Why a record is rejected, NULL if it is valid; the note is judged first."""
    known = F.coalesce(raw_label_key(label).isin(*mapping), F.lit(False))
    return F.when(is_blank(note), "missing_note").when(~known, "unknown_category")


def valid_notes(df: DataFrame, mapping: dict[str, str] = CATEGORY_MAP) -> DataFrame:
    """Records with a note and a known label: (note_id, input, output)."""
    # The first two tests say nothing new, but can be pushed down to the files.
    return df.where(
        F.col("rep_note").isNotNull()
        & F.col("issue_category").isNotNull()
        & reject_reason(F.col("rep_note"), F.col("issue_category"), mapping).isNull()
    ).select(
        "note_id",
        py_strip(F.col("rep_note")).alias("input"),
        map_category(F.col("issue_category"), mapping).alias("output"),
    )


def rejected_notes(df: DataFrame, mapping: dict[str, str] = CATEGORY_MAP) -> DataFrame:
    """The other records, with ``reject_reason``."""
    reason = reject_reason(F.col("rep_note"), F.col("issue_category"), mapping)
    return df.withColumn("reject_reason", reason).where(
        F.col("reject_reason").isNotNull()
    )


def strict_notes(df: DataFrame, mapping: dict[str, str] = CATEGORY_MAP) -> DataFrame:
    """Records whose label matches to the letter: (note_id, input, output).

    Unlike :func:`valid_notes`, a padded or lower-case label is dropped and a
    blank note is kept.
    """
    # Both tests are plain enough to be pushed down to the files.
    return df.where(
        F.col("rep_note").isNotNull() & F.col("issue_category").isin(*mapping)
    ).select(
        "note_id",
        py_strip(F.col("rep_note")).alias("input"),
        lookup(F.col("issue_category"), mapping).alias("output"),
    )


def load_stats(df: DataFrame, mapping: dict[str, str] = CATEGORY_MAP) -> DataFrame:
    """One row: total, valid and skipped records."""
    reason = reject_reason(F.col("rep_note"), F.col("issue_category"), mapping)
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(reason.isNull()).alias("valid"),
        F.count_if(reason.isNotNull()).alias("skipped"),
    )


def require_records(df: DataFrame, minimum: int = MIN_VALID_RECORDS) -> DataFrame:
    """``df`` itself; fails if it has fewer rows than needed for a split."""
    found = df.limit(minimum).count()
    if found < minimum:
        raise ValueError(f"too few valid records ({found}) to split")
    return df


def distribution(df: DataFrame, by: str = "output") -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def split_counts(df: DataFrame) -> DataFrame:
    """Rows per split and category."""
    return df.groupBy("split", "output").agg(F.count("*").alias("n"))


def _digest(text: Column) -> Column:
    # 32 bytes stand in for the text in shuffles.
    return F.unhex(F.sha2(text, 256))


def duplicate_count(df: DataFrame, key: str = "input") -> DataFrame:
    """One row: ``duplicates``, the occurrences beyond the first of each text."""
    return (
        df.groupBy(_digest(F.col(key)).alias("digest"))
        .agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
        .withColumn("leakage_risk", F.col("duplicates") > 0)
    )


def dedup_first(df: DataFrame, key: str = "input") -> DataFrame:
    """Keep the row with the lowest note id of each text.

    The keepers are found on (digest, id) alone, combined on the map side, so
    copies of one text that make up a third of the rows do not pile up. The
    texts then move once, hashed by their unique id.
    """
    keepers = df.groupBy(_digest(F.col(key)).alias("digest")).agg(
        F.min("note_id").alias("note_id")
    )
    return df.join(keepers.select("note_id"), "note_id", "left_semi")


def class_weights(df: DataFrame, label: str = "output") -> DataFrame:
    """Balanced weight per class: total / (classes * rows of the class)."""
    # One row per class reaches these unpartitioned windows.
    every_class = Window.partitionBy(F.lit(0))
    return (
        df.groupBy(label)
        .agg(F.count("*").alias("n"))
        .withColumn("total", F.sum("n").over(every_class))
        .withColumn("classes", F.count("*").over(every_class))
        .select(
            label, "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight")
        )
    )
