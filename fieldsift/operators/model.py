"""Random forest on TF-IDF features: training, scoring, cross-validation."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import MIN_LEAF, MIN_SPLIT, N_TREES, SEED
from ..functions.text import clean_note
from ..session import scratch, stage
from .dataset import class_weights
from .features import (
    TfidfModel,
    decode_label,
    encode_label,
    fold_vocabularies,
    gram_table,
    joint_vocabulary,
    label_classes,
)
from .metrics import weighted_f1_by
from .trees import Forest, grow_forest

# The greatest depth that Spark allows; leaves end at MIN_LEAF notes anyway.
TREE_DEPTH = 30
# Forests of a cross-validation that are fitted at a time; each keeps all cores busy.
PARALLEL_FITS = 2
# A note counts as 4 bytes for each term of the vocabulary, a part of the notes
# has so many; with fewer terms in its notes it takes less.
TASK_BYTES = 512 << 20
# Trees that are worth a share of their own.
LEAST_TREES = 10


def _model_text(column: str, clean: bool) -> Column:
    return clean_note(F.col(column)) if clean else F.col(column)


def labelled_features(weighted: DataFrame, classes: list[str]) -> DataFrame:
    """(note_id, label, weight, term_ids, weights) of weighted notes with their ``output``."""
    # One row per class is broadcast; the number of classes is checked.
    weights = F.broadcast(class_weights(weighted).select("output", "weight"))
    return weighted.join(weights, "output").select(
        "note_id",
        encode_label(F.col("output"), classes).cast("double").alias("label"),
        "weight",
        "term_ids",
        "weights",
    )


def fit_shape(n_notes: int, n_terms: int, n_trees: int, cores: int) -> tuple[int, int]:
    """(parts, fits): partitions of the notes, and shares of the trees.

    Partitions grow with the notes, to TASK_BYTES each. As long as they are
    fewer than the cores, the trees are shared out too.
    """
    parts = max(1, math.ceil(n_notes * n_terms * 4 / TASK_BYTES))
    fits = max(1, min(cores // parts, math.ceil(n_trees / LEAST_TREES)))
    return max(parts, cores // fits) if fits == 1 else parts, fits


def fit_forest(
    features: DataFrame, n_terms: int, n_trees: int = N_TREES, tree_depth: int = TREE_DEPTH, seed: int = SEED
) -> Forest:
    """Train on staged :func:`labelled_features`, on all cores.

    Trees do not depend on each other, so each task grows some of them, over
    the notes of all parts, see :mod:`trees`.
    """
    cores = features.sparkSession.sparkContext.defaultParallelism
    parts, _ = fit_shape(features.count(), n_terms, n_trees, cores)
    return grow_forest(features, n_terms, parts, n_trees, tree_depth, MIN_LEAF, MIN_SPLIT, seed)


def answers(
    forest: Forest, rows: DataFrame, classes: list[str], *keep: str
) -> DataFrame:
    """(keep..., issue_category, confidence) of rows with ``term_ids`` and ``weights``."""
    scored = forest.score(rows.select(*keep, "term_ids", "weights"))
    return scored.select(*keep, decode_label(F.col("class"), classes).alias("issue_category"), "confidence")


@dataclass(frozen=True)
class NoteClassifier:
    """A fitted vocabulary and forest; ``clean`` says whether notes are cleaned first."""

    tfidf: TfidfModel
    forest: Forest
    classes: list[str]
    clean: bool = True

    @classmethod
    def fit(
        cls,
        train: DataFrame,
        clean: bool = True,
        n_trees: int = N_TREES,
        tree_depth: int = TREE_DEPTH,
        seed: int = SEED,
        **vocabulary_options,
    ) -> "NoteClassifier":
        """Train on (note_id, input, output)."""
        notes = train.select(
            "note_id", "output", _model_text("input", clean).alias("text")
        )
        classes = label_classes(train)
        with scratch(train.sparkSession):
            # Notes are cleaned and cut into terms once, for both steps.
            grams = gram_table(notes, "text", "note_id", "output")
            tfidf = TfidfModel.fit_grams(grams, **vocabulary_options)
            features = labelled_features(tfidf.transform_grams(grams), classes)
            forest = fit_forest(stage(features, "features"), len(tfidf.terms), n_trees, tree_depth, seed)
        return cls(tfidf, forest, classes, clean)

    def predict(self, notes: DataFrame, text: str = "input") -> DataFrame:
        """Add ``issue_category`` and ``confidence``, the highest class probability."""
        prepared = self.tfidf.transform(
            notes.withColumn("_text", _model_text(text, self.clean)), "_text"
        )
        return answers(self.forest, prepared, self.classes, *notes.columns)


def evaluate(model: NoteClassifier, test: DataFrame) -> DataFrame:
    """Scored test notes, staged: (note_id, true, predicted, confidence)."""
    scored = model.predict(test.select("note_id", "output", "input")).select(
        "note_id",
        F.col("output").alias("true"),
        F.col("issue_category").alias("predicted"),
        "confidence",
    )
    return stage(scored, "answers")


def cross_validate(
    folded: DataFrame,
    clean: bool = True,
    n_trees: int = N_TREES,
    tree_depth: int = TREE_DEPTH,
    seed: int = SEED,
    **vocabulary_options,
) -> DataFrame:
    """Weighted F1 per fold: (fold, f1_weighted).

    ``folded`` has (note_id, input, output, fold), folds numbered from 0; notes
    without a fold take no part. Each fold is scored by a vocabulary and a
    forest of all others. Notes are cleaned and cut into terms once: the
    vocabularies come from one count by fold, and each note is then kept as its
    counts of all their terms. The forests are fitted side by side.
    """
    notes = folded.where(F.col("fold").isNotNull()).select(
        "note_id", "output", "fold", _model_text("input", clean).alias("text")
    )
    with scratch(folded.sparkSession):
        grams = gram_table(notes, "text", "note_id", "output", "fold")
        models = {
            fold: TfidfModel.from_table(table)
            for fold, table in fold_vocabularies(grams, "fold", **vocabulary_options).items()
        }
        classes = label_classes(grams)
        joint = joint_vocabulary(list(models.values()))
        counted = joint.count_runs(grams)
        # The scores are made of it when they are read.
        counted = stage(counted, "fold_counts", keep=True)

    def weighted(fold: int, rows: DataFrame) -> DataFrame:
        return models[fold].weigh(models[fold].narrow(rows, joint))

    def fit(fold: int) -> Forest:
        train = weighted(fold, counted.where(F.col("fold") != fold))
        with scratch(folded.sparkSession):
            features = stage(labelled_features(train, classes), "features")
            return fit_forest(features, len(models[fold].terms), n_trees, tree_depth, seed)

    target = inheritable_thread_target(folded.sparkSession)(fit)
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        forests = dict(zip(models, pool.map(target, models), strict=True))
    scored = None
    for fold, forest in forests.items():
        rows = weighted(fold, counted.where(F.col("fold") == fold))
        part = answers(forest, rows, classes, "fold", "output").select("fold", F.col("output").alias("true"), F.col("issue_category").alias("predicted"))
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        return folded.sparkSession.createDataFrame([], "fold int, f1_weighted double")
    return weighted_f1_by(scored, "fold")
