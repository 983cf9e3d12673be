"""Grown trees against a plain search on a dense table."""

import os

import numpy as np
import pyarrow as pa
import pytest

from fieldsift.operators import model, trees


def _sparse(table, labels):
    lists = [np.flatnonzero(row) for row in table]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(labels.astype(float)),
            pa.array(lists, pa.list_(pa.int32())),
            pa.array([row[at] for row, at in zip(table, lists, strict=True)], pa.list_(pa.float64())),
        ],
        ["label", "term_ids", "weights"],
    )


def _files(tmp_path, table, labels, edges):
    written = trees._write(str(tmp_path / "chunks"), edges)(iter([_sparse(table, labels)]))
    return [file for batch in written for file in batch.column(0).to_pylist()]


def _edges(table):
    note, term = np.nonzero(table)
    return trees.thresholds(term, table[note, term], *table.shape)


def _gini(counts, weights):
    share = counts * weights / (counts * weights).sum()
    return 1 - (share**2).sum()


@pytest.mark.parametrize("large_bytes", [0, 1 << 23])
def test_splits_are_the_best_of_the_drawn_terms(tmp_path, monkeypatch, large_bytes):
    rng = np.random.default_rng(3)
    table = np.where(rng.random((400, 30)) < rng.random(30) * 0.6, rng.random((400, 30)).round(2) + 0.01, 0)
    table[:5] = 0
    labels = rng.integers(0, 3, 400)
    labels[table[:, 4] > 0.5] = 2
    monkeypatch.setattr(trees, "CHUNK_NOTES", 150)
    monkeypatch.setattr(trees, "LARGE_BYTES", large_bytes)
    monkeypatch.setattr(trees, "WALK", 64)
    edges = _edges(table)
    files = _files(tmp_path, table, labels, edges)
    assert len(files) == 3
    rules = trees.Rules(30, np.array([1.0, 0.5, 2.0]), 8, 2, 5, 7)
    levels = []

    class Seen(trees.Tree):
        def split(self):
            large = len(self.large)
            super().split()
            levels.append((self.open, self.terms, large))

    monkeypatch.setattr(trees, "Tree", Seen)
    grown = []
    monkeypatch.setattr(Seen, "nodes", lambda self, _: grown.append(self) or pa.RecordBatch.from_arrays([], []))
    list(trees._grown(files, edges, rules)(iter([pa.RecordBatch.from_arrays([pa.array([0])], ["id"])])))
    tree = grown[0]
    times = np.concatenate(tree.times)
    assert any(large for _, _, large in levels) == (large_bytes > 0)
    where, base, checked = np.zeros(400, int), 0, 0
    for (opened, terms, _), (gain, term, bin_, left), counts in zip(levels, tree.splits, tree.counts, strict=False):
        for i in range(len(counts)):
            own = (where == base + i) & (times > 0)
            assert np.bincount(labels[own], times[own], 3).tolist() == counts[i].tolist()
            if i not in opened:
                assert left[i] < 0 and (counts[i].sum() < 5 or counts[i].max() == counts[i].sum())
                continue
            best = 0.0
            for t in terms[opened.tolist().index(i)]:
                for cut in edges[t]:
                    over = own & (table[:, t] > cut)
                    right = np.bincount(labels[over], times[over], 3)
                    rest = counts[i] - right
                    if min(right.sum(), rest.sum()) < 2:
                        continue
                    share = (right * rules.weights).sum() / (counts[i] * rules.weights).sum()
                    found = _gini(counts[i], rules.weights) - share * _gini(right, rules.weights)
                    best = max(best, found - (1 - share) * _gini(rest, rules.weights))
            assert gain[i] == pytest.approx(best, abs=1e-9) if left[i] >= 0 else best < 1e-9
            checked += 1
            if left[i] >= 0:
                where[where == base + i] = left[i] + (table[where == base + i, term[i]] > edges[term[i]][bin_[i]])
        base += len(counts)
    assert checked > 30 and len(levels) > 4


def test_thresholds_part_the_weights():
    weights = np.arange(1, 101) / 100
    found = trees.thresholds(np.array([0] * 100 + [1, 1, 3, 3]), np.append(weights, [0.5, 0.7, 0.2, 0.2]), 100, 5)
    assert [len(f) for f in found] == [trees.BINS - 2, 2, 0, 1, 0]
    assert found[1].tolist() == [0.25, 0.6] and found[3].tolist() == [0.1]
    assert np.diff(np.searchsorted(weights, found[0])).max() <= 4


def test_draws_are_different_and_even():
    found = trees.draw(np.random.default_rng(1), 2000, 10, 4)
    assert (np.diff(found, axis=1) > 0).all()
    assert np.abs(np.bincount(found.ravel()) - 800).max() < 120
    assert trees.draw(np.random.default_rng(1), 3, 2, 2).tolist() == [[0, 1]] * 3


def test_a_note_takes_room_for_its_own_terms_only(tmp_path):
    rng = np.random.default_rng(2)
    table = np.zeros((500, 5000))
    for row in table:
        row[rng.choice(5000, 20, replace=False)] = rng.random(20) + 0.1
    files = _files(tmp_path, table, rng.integers(0, 2, 500), _edges(table))
    assert len(files) == 1 and os.path.getsize(files[0]) < 500 * 200 + 5001 * 8 + 4096


def test_leaves_that_predict_the_same_are_joined(tmp_path):
    rng = np.random.default_rng(5)
    table = np.where(rng.random((300, 20)) < 0.3, 1.0, 0)
    labels = rng.integers(0, 2, 300)
    edges = _edges(table)
    rules = trees.Rules(20, np.ones(2), 30, 2, 5, 1)
    files = _files(tmp_path, table, labels, edges)
    for batch in trees._grown(files, edges, rules)(iter([pa.RecordBatch.from_arrays([pa.array([0, 1])], ["id"])])):
        nodes = [r["nodeData"] for r in batch.to_pylist()]
        inner = [n for n in nodes if n["leftChild"] >= 0]
        assert inner and nodes[0]["rawCount"] == sum(n["rawCount"] for n in nodes if n["leftChild"] < 0)
        for n in inner:
            pair = nodes[n["leftChild"]], nodes[n["rightChild"]]
            assert n["id"] < pair[0]["id"] and sum(p["rawCount"] for p in pair) == n["rawCount"] >= 5
            assert any(p["leftChild"] >= 0 for p in pair) or pair[0]["prediction"] != pair[1]["prediction"]
            assert len(n["split"]["leftCategoriesOrThreshold"]) == 1


def test_scores_equal_those_of_spark_and_no_forest_is_loaded(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{w}" for w in rng.integers(0, 40, 1 + i % 9)), "abc"[rng.integers(3)]) for i in range(300)]
    notes = spark.createDataFrame(rows, "note_id long, input string, output string")
    with monkeypatch.context() as patch:
        patch.setattr(trees.RandomForestClassificationModel, "load", lambda path: 1 / 0)
        patch.setattr(trees, "SCORED_BYTES", 3000)
        fitted = model.NoteClassifier.fit(notes, n_trees=6, tree_depth=8)
        fitted.forest.write().save(str(tmp_path / "forest"))
        found = {r.note_id: (r.issue_category, r.confidence) for r in fitted.predict(notes).collect()}
    vectors = fitted.tfidf.transform(notes, "input").withColumn("_features", fitted.tfidf.vector())
    wide = trees.RandomForestClassificationModel.load(str(tmp_path / "forest")).setFeaturesCol("_features")
    for row in wide.transform(vectors).collect():
        assert found[row.note_id] == (fitted.classes[int(row.prediction)], max(row.probability))
    # A forest that Spark has written, with the nodes of a tree in several files.
    wide.write().save(str(tmp_path / "again"))
    saved = spark.read.parquet(str(tmp_path / "again" / "data"))
    saved.repartition(3, "nodeData.id").write.mode("append").parquet(str(tmp_path / "dealt" / "data"))
    for part in ("metadata", "treesMetadata"):
        os.symlink(tmp_path / "again" / part, tmp_path / "dealt" / part)
    dealt = model.NoteClassifier(fitted.tfidf, trees.Forest(spark, str(tmp_path / "dealt")), fitted.classes)
    assert {r.note_id: (r.issue_category, r.confidence) for r in dealt.predict(notes).collect()} == found
