"""Evaluation results as files; each has a few rows per label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import CATEGORIES
from ..functions.numbers import fixed_point
from ..operators.metrics import (
    accuracy,
    average_metrics,
    classification_report,
    confusion_matrix,
    matrix_rows,
)


def report_lines(scored: DataFrame, labels: list[str] = CATEGORIES) -> DataFrame:
    """The report as text lines: (line_no, line).

    One line per label, then accuracy and both averages, in columns of 9.
    """
    width = max(len(name) for name in [*labels, "weighted avg"])

    def cell(text: Column) -> Column:
        return F.concat(F.lit(" "), F.lpad(text, 9, " "))

    def line(name: Column, *cells: Column) -> Column:
        return F.concat(F.lpad(name, width, " "), F.lit(" "), *map(cell, cells))

    names = F.array(*[F.lit(x) for x in sorted(labels)])
    report = classification_report(scored, labels)
    total = F.col("support").cast("string")
    measures = [fixed_point(F.col(m), 2) for m in ("precision", "recall", "f1")]
    rows = report.select(
        (F.array_position(names, F.col("label")) + 1).alias("line_no"),
        line(F.col("label"), *measures, total).alias("line"),
    )
    first_average = len(labels) + 3
    averages = average_metrics(report).select(
        F.when(F.col("average") == "macro", first_average + 1)
        .otherwise(first_average + 2)
        .alias("line_no"),
        line(F.concat("average", F.lit(" avg")), *measures, total).alias("line"),
    )
    overall = accuracy(scored).select(
        F.lit(first_average).alias("line_no"),
        line(
            F.lit("accuracy"), F.lit(""), F.lit(""), fixed_point(F.col("accuracy"), 2),
            F.col("total").cast("string"),
        ).alias("line"),
    )
    heads = [F.lit(h) for h in ("precision", "recall", "f1-score", "support")]
    fixed = scored.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(i) for i in (0, 1, first_average - 1)])).alias("line_no"),
    ).withColumn("line", F.when(F.col("line_no") == 0, line(F.lit(""), *heads)).otherwise(""))
    union = fixed.unionByName(rows).unionByName(averages).unionByName(overall)
    return union.select(F.col("line_no").cast("int"), "line")


def metrics_json(scored: DataFrame, labels: list[str] = CATEGORIES) -> DataFrame:
    """One JSON line: accuracy, averages, report per label and matrix."""
    report = classification_report(scored, labels)
    per_label = report.agg(
        F.map_from_entries(
            F.array_sort(
                F.collect_list(
                    F.struct("label", F.struct("precision", "recall", "f1", "support"))
                )
            )
        ).alias("classification_report")
    )
    weighted = average_metrics(report).where(F.col("average") == "weighted")
    rows = matrix_rows(confusion_matrix(scored, labels))
    matrix = rows.agg(F.array_sort(F.collect_list(F.struct("true", "counts"))).alias("m"))
    value = F.struct(
        accuracy(scored).select("accuracy").scalar().alias("accuracy"),
        *[
            weighted.select(m).scalar().alias(f"{m}_weighted")
            for m in ("precision", "recall", "f1")
        ],
        F.col("classification_report"),
        matrix.select(F.transform("m", lambda r: r["counts"])).scalar().alias(
            "confusion_matrix"
        ),
    )
    return per_label.select(F.to_json(value).alias("value"))


METRICS_SCHEMA = (
    "accuracy double, precision_weighted double, recall_weighted double, f1_weighted double, "
    "classification_report map<string, "
    "struct<precision: double, recall: double, f1: double, support: bigint>>, "
    "confusion_matrix array<array<bigint>>"
)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics that :func:`write_report` has written, one row."""
    return spark.read.schema(METRICS_SCHEMA).option("mode", "FAILFAST").json(f"{path}/metrics")


def write_report(scored: DataFrame, path: str, labels: list[str] = CATEGORIES) -> str:
    """Write the metrics as JSON and the report as text below ``path``."""
    metrics_json(scored, labels).coalesce(1).write.mode("overwrite").text(f"{path}/metrics")
    report_lines(scored, labels).coalesce(1).sortWithinPartitions("line_no").select(
        "line"
    ).write.mode("overwrite").text(f"{path}/report")
    return path


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a written text report."""
    return spark.read.text(f"{path}/report")
