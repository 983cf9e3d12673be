"""Saved classifiers: complete versions, and a pointer to the current one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from ..operators.features import TfidfModel
from ..operators.model import NoteClassifier
from ..operators.trees import Forest
from . import files

PIPELINE_STEPS = ["tfidf", "clf"]
# Files that each part of a version must have.
PARTS = {"vocabulary": "_SUCCESS", "metadata": "_SUCCESS", "forest": "metadata"}
POINTERS, KEY = "_current", "model"


class ArtifactNotFoundError(FileNotFoundError):
    """A part of a saved classifier is missing."""


def save_classifier(spark: SparkSession, model: NoteClassifier, path: str) -> str:
    """Write vocabulary, forest and metadata below ``path``; returns the path.

    The parts are written to a folder of their own, and the pointer to it comes
    last: a save that fails leaves the version before it in place.
    """
    version = f"versions/{uuid.uuid4().hex}"
    folder = f"{path}/{version}"
    model.tfidf.to_table(spark).write.parquet(f"{folder}/vocabulary")
    model.forest.write().save(f"{folder}/forest")
    spark.createDataFrame(
        [(model.classes, PIPELINE_STEPS, model.clean)],
        "classes array<string>, pipeline_steps array<string>, clean boolean",
    ).write.json(f"{folder}/metadata")
    files.publish(spark, f"{path}/{POINTERS}", KEY, json.dumps({"folder": version}))
    return path


def current_version(spark: SparkSession, path: str) -> int | None:
    """Number of the newest complete version; None if there is none."""
    return files.newest(spark, f"{path}/{POINTERS}").get(KEY)


def load_classifier(spark: SparkSession, path: str, version: int | None = None) -> NoteClassifier:
    """Read back what :func:`save_classifier` wrote, the newest or a given version."""
    if version is None:
        version = current_version(spark, path)
    pointers = f"{path}/{POINTERS}"
    pointer = files.version_path(pointers, KEY, version or 0)
    if version is None or pointer.rpartition("/")[2] not in files.names(spark, pointers):
        raise ArtifactNotFoundError(path)
    folder = f"{path}/{json.loads(files.read_text(spark, pointer))['folder']}"
    for part, mark in PARTS.items():
        if mark not in files.names(spark, f"{folder}/{part}"):
            raise ArtifactNotFoundError(f"{folder}/{part}")
    vocabulary = spark.read.schema("term_id int, term string, idf double").parquet(
        f"{folder}/vocabulary"
    )
    metadata = spark.read.schema(
        "classes array<string>, pipeline_steps array<string>, clean boolean"
    ).json(f"{folder}/metadata")
    about = metadata.first()
    forest = Forest(spark, f"{folder}/forest")
    return NoteClassifier(
        TfidfModel.from_table(vocabulary), forest, list(about["classes"]), about["clean"]
    )
