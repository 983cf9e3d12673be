"""Forests whose trees are shared out to several fits."""

from pyspark.sql import functions as F

from fieldsift.operators import model


def test_fit_shape_follows_the_notes():
    # A small set is not cut into a part for each core, trees go side by side.
    assert model.fit_shape(28_722, 5_000, 200, 12) == (2, 6)
    assert model.fit_shape(300, 100, 5, 8) == (8, 1)
    # A task passes over a bounded number of bytes, whatever the input.
    for n_notes in (10**5, 10**6, 10**7):
        parts, fits = model.fit_shape(n_notes, 5_000, 30, 12)
        assert n_notes * 5_000 * 4 / parts <= model.TASK_BYTES and parts * fits <= max(12, parts)


def test_forest_of_several_fits(spark):
    words = ("late truck", "price margin")
    rows = [(i, f"{words[i % 2]} w{i % 7} n{i % 5}", "AB"[i % 2]) for i in range(200)]
    notes = spark.createDataFrame(rows, "note_id long, input string, output string")
    assert model.fit_shape(200, 20, 25, spark.sparkContext.defaultParallelism)[1] == 3
    fitted = model.NoteClassifier.fit(notes, n_trees=25, tree_depth=4)
    assert fitted.forest.getNumTrees == len(fitted.forest.trees) == 25
    assert len({t.toDebugString.partition("\n")[2] for t in fitted.forest.trees}) > 3
    found = fitted.predict(notes)
    assert found.where(F.col("issue_category") != F.col("output")).count() == 0
    assert found.where("confidence <= 0.5 or confidence > 1").count() == 0
