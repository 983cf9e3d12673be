"""From a prepared data set to a saved, evaluated classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import cv_summary
from ..operators.model import NoteClassifier, cross_validate, evaluate
from ..operators.sampling import stratified_folds
from ..sources.artifacts import load_classifier, save_classifier
from ..sources.reports import write_report


def train_and_evaluate(
    prepared: DataFrame, output_path: str, **fit_options
) -> DataFrame:
    """Fit on the train rows, save the model, score the test rows.

    ``prepared`` has a ``split`` column. Returns the scored test rows and writes
    the report next to the model.
    """
    train = prepared.where(F.col("split") == "train").drop("split")
    model = NoteClassifier.fit(train, **fit_options)
    save_classifier(prepared.sparkSession, model, output_path)
    return evaluate_saved(prepared, output_path)


def evaluate_saved(prepared: DataFrame, model_path: str) -> DataFrame:
    """Score the test rows with a saved model and write the report."""
    model = load_classifier(prepared.sparkSession, model_path)
    test = prepared.where(F.col("split") == "test").drop("split")
    scored = evaluate(model, test)
    write_report(scored, f"{model_path}/evaluation", model.classes)
    return scored


def cross_validation(train: DataFrame, **fit_options) -> DataFrame:
    """Mean and deviation of the fold scores, with the leakage flag."""
    return cv_summary(cross_validate(stratified_folds(train), **fit_options))
