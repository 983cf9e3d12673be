"""Evaluation from one count per (true, predicted) pair.

Every measure below needs only that small table, so the predictions are scanned
and shuffled once, combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import LEAKAGE_F1, NOTE_PREVIEW
from ..functions.numbers import round_half_even


# A set of labels is small; more than this is not one.
MAX_LABELS = 1000


def pair_outcomes(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Join truth and predictions by note: (note_id, true, predicted)."""
    return truth.select("note_id", "true").join(
        predicted.select("note_id", "predicted"), "note_id"
    )


def unmatched_count(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: notes that only one of the sides has."""
    sides = truth.select("note_id", F.lit(1).alias("side")).unionByName(
        predicted.select("note_id", F.lit(2).alias("side"))
    )
    seen = sides.groupBy("note_id").agg(F.bit_or("side").alias("sides"))
    return seen.agg(
        F.count_if(F.col("sides") == 1).alias("without_prediction"),
        F.count_if(F.col("sides") == 2).alias("without_truth"),
    )


def outcome_counts(df: DataFrame, *by: str) -> DataFrame:
    """Rows per (true, predicted) and optional further columns."""
    return df.groupBy(*by, "true", "predicted").agg(F.count("*").alias("n"))


def accuracy(df: DataFrame) -> DataFrame:
    """One row: accuracy (0 on no rows), correct, total."""
    hit = F.col("true") == F.col("predicted")
    return df.agg(F.count_if(hit).alias("correct"), F.count("*").alias("total")).select(
        F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)).alias("accuracy"),
        "correct",
        "total",
    )


def _label_array(labels: list[str | None]) -> Column:
    return F.array(*[F.lit(x).cast("string") for x in sorted(labels, key=lambda x: (x is None, x))])


def found_labels(df: DataFrame) -> list[str | None]:
    """All labels of truth and predictions, NULL included; at most MAX_LABELS."""
    both = outcome_counts(df).select(F.explode(F.array("true", "predicted")).alias("label"))
    found = [r["label"] for r in both.distinct().limit(MAX_LABELS + 1).collect()]
    if len(found) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    return found


def confusion_matrix(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Dense matrix in long form: (true, predicted, n) for every pair of labels.

    Without ``labels`` these are all that occur, NULL as one of them. With
    ``labels``, pairs outside the list are left out; :func:`outside_count` tells
    how many.
    """
    if labels is None:
        labels = found_labels(df)
        known = F.lit(True)
    else:
        known = F.col("true").isin(*labels) & F.col("predicted").isin(*labels)
    # Tested as an aggregate: a filter on the pair itself would be moved below
    # the scoring expressions and compute them twice.
    counts = (
        df.groupBy("true", "predicted")
        .agg(F.count("*").alias("n"), F.bool_and(known).alias("known"))
        .where("known")
        .drop("known")
    )
    empty = df.sparkSession.range(1).select(
        F.explode(_label_array(labels)).alias("true")
    ).select("true", F.explode(_label_array(labels)).alias("predicted"))
    return (
        counts.unionByName(empty.withColumn("n", F.lit(0).cast("bigint")))
        .groupBy("true", "predicted")
        .agg(F.sum("n").alias("n"))
    )


def outside_count(df: DataFrame, labels: list[str]) -> DataFrame:
    """One row: ``outside``, the rows that a matrix over ``labels`` leaves out."""
    known = F.col("true").isin(*labels) & F.col("predicted").isin(*labels)
    counts = outcome_counts(df).withColumn("known", F.coalesce(known, F.lit(False)))
    return counts.agg(
        F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("outside")
    )


def matrix_rows(matrix: DataFrame) -> DataFrame:
    """The matrix as one array per true label, columns in label order."""
    missing = F.col("predicted").isNull().alias("missing")
    cells = F.array_sort(F.collect_list(F.struct(missing, "predicted", "n")))
    return matrix.groupBy("true").agg(
        F.transform(cells, lambda cell: cell["n"]).alias("counts")
    )


def classification_report(
    df: DataFrame, labels: list[str] | None = None
) -> DataFrame:
    """Precision, recall, F1 and support per label; 0 where undefined.

    Support and predictions are counted over all rows, also those whose other
    label is NULL or not in ``labels``. Without ``labels``, all that occur.
    """
    if labels is None:
        labels = found_labels(df)
    hit = F.coalesce(F.col("true") == F.col("predicted"), F.lit(False))
    empty = df.sparkSession.range(1).select(F.explode(_label_array(labels)).alias("label"))
    for name in ("support", "chosen", "tp"):
        empty = empty.withColumn(name, F.lit(0).cast("bigint"))
    listed = F.col("label").isin(*[x for x in labels if x is not None])
    if None in labels:
        listed = F.col("label").isNull() | listed
    # Each pair counts towards its true and towards its predicted label.
    sides = outcome_counts(df).select(
        F.explode(
            F.array(
                F.struct(
                    F.col("true").alias("label"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("chosen"),
                    F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                ),
                F.struct(
                    F.col("predicted").alias("label"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("chosen"),
                    F.lit(0).cast("bigint").alias("tp"),
                ),
            )
        ).alias("side")
    ).select("side.*").where(listed).unionByName(empty)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return (
        sides.groupBy("label")
        .agg(
            F.sum("tp").alias("tp"),
            F.sum("chosen").alias("chosen"),
            F.sum("support").alias("support"),
        )
        .select(
            "label",
            ratio(F.col("tp"), F.col("chosen")).alias("precision"),
            ratio(F.col("tp"), F.col("support")).alias("recall"),
            ratio(2.0 * F.col("tp"), F.col("chosen") + F.col("support")).alias("f1"),
            "support",
        )
    )


def average_metrics(report: DataFrame) -> DataFrame:
    """Macro and support-weighted averages of a report: one row each."""
    names = ["precision", "recall", "f1"]
    macro = [F.avg(m).alias(f"macro_{m}") for m in names]
    weighted = [
        F.coalesce(
            F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")), F.lit(0.0)
        ).alias(f"weighted_{m}")
        for m in names
    ]
    row = report.agg(*macro, *weighted, F.sum("support").alias("support"))
    averages = F.array(
        *[
            F.struct(
                F.lit(kind).alias("average"),
                *[F.col(f"{kind}_{m}").alias(m) for m in names],
                F.col("support"),
            )
            for kind in ("macro", "weighted")
        ]
    )
    return row.select(F.explode(averages).alias("row")).select("row.*")


def all_metrics(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Per-label rows and both averages in one table keyed by ``label``."""
    report = classification_report(df, labels)
    averages = average_metrics(report).withColumnRenamed("average", "label")
    return report.unionByName(
        averages.withColumn("label", F.concat("label", F.lit(" avg")))
    )


def eval_predictions(df: DataFrame, preview: int = NOTE_PREVIEW) -> DataFrame:
    """Scored notes: (note_id, note, true, predicted, correct), the note cut short."""
    return df.select(
        "note_id",
        F.substring("note", 1, preview).alias("note"),
        "true",
        "predicted",
        (F.col("true") == F.col("predicted")).alias("correct"),
    )


def union_methods(results: dict[str, DataFrame]) -> DataFrame:
    """Predictions of several methods in one table with a ``method`` column."""
    parts = [df.withColumn("method", F.lit(name)) for name, df in results.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def method_comparison(df: DataFrame) -> DataFrame:
    """Accuracy, counts and average latency per method."""
    hit = F.col("true") == F.col("predicted")
    return (
        df.groupBy("method")
        .agg(
            F.count_if(hit).alias("correct"),
            F.count("*").alias("total"),
            F.avg("latency_seconds").alias("latency"),
        )
        .select(
            "method",
            (F.col("correct") / F.col("total")).alias("accuracy"),
            "correct",
            "total",
            F.coalesce(round_half_even(F.col("latency"), 3), F.lit(0.0)).alias(
                "avg_latency_seconds"
            ),
        )
    )


def weighted_f1_by(df: DataFrame, by: str) -> DataFrame:
    """Support-weighted F1 per group, such as a fold: (by, f1_weighted).

    A label takes part in every group in which it is true or predicted.
    """
    counts = outcome_counts(df, by)
    hit = F.col("true") == F.col("predicted")
    sides = counts.select(
        by,
        F.explode(
            F.array(
                F.struct(
                    F.col("true").alias("label"),
                    F.col("n").alias("support"),
                    F.col("n").alias("marks"),
                    F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                ),
                F.struct(
                    F.col("predicted").alias("label"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("marks"),
                    F.lit(0).cast("bigint").alias("tp"),
                ),
            )
        ).alias("side"),
    ).select(by, "side.*")
    per_label = sides.groupBy(by, "label").agg(
        F.sum("support").alias("support"),
        (2.0 * F.sum("tp") / F.sum("marks")).alias("f1"),
    )
    return per_label.groupBy(by).agg(
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted")
    )


def cv_summary(scores: DataFrame, threshold: float = LEAKAGE_F1) -> DataFrame:
    """One row: mean and population deviation of the fold scores, leakage flag."""
    return scores.agg(
        F.avg("f1_weighted").alias("cv_f1_mean"),
        F.stddev_pop("f1_weighted").alias("cv_f1_std"),
    ).withColumn("leakage_risk", F.col("cv_f1_mean") > threshold)
