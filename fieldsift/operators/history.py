"""Reports on the prediction log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import RECENT_ROWS, UNKNOWN_CATEGORY


def category_counts(log: DataFrame) -> DataFrame:
    """Predictions per category; a missing category counts as 'unknown'."""
    category = F.coalesce("issue_category", F.lit(UNKNOWN_CATEGORY))
    return log.groupBy(category.alias("issue_category")).agg(F.count("*").alias("n"))


def history(
    log: DataFrame, limit: int | None = None, tie_break: str | None = None
) -> DataFrame:
    """The log, newest first, optionally only the first ``limit`` rows."""
    order = [F.desc("timestamp")] + ([F.desc(tie_break)] if tie_break else [])
    newest = log.orderBy(*order)
    return newest if limit is None else newest.limit(limit)


def recent_predictions(
    log: DataFrame, rows: int = RECENT_ROWS, tie_break: str | None = None
) -> DataFrame:
    """The last rows, oldest first, with the time and category columns it has."""
    order = [F.asc("timestamp")] + ([F.asc(tie_break)] if tie_break else [])
    columns = [c for c in ("timestamp", "issue_category") if c in log.columns]
    return history(log, rows, tie_break).orderBy(*order).select(*(columns or ["*"]))
