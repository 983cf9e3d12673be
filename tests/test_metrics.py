import pytest

from fieldsift.operators import metrics as M
from fieldsift.sources import reports

PAIRS = (
    [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("b", "a")] * 2 + [("c", "a")]
)


@pytest.fixture
def scored(spark):
    return spark.createDataFrame(
        [(i, t, p) for i, (t, p) in enumerate(PAIRS)], "note_id long, true string, predicted string"
    )


LABELS = ["a", "b", "c", "d"]


def test_accuracy(scored):
    assert tuple(M.accuracy(scored).first()) == (5 / 9, 5, 9)
    assert tuple(M.accuracy(scored.limit(0)).first()) == (0.0, 0, 0)


def test_matrix_is_dense(scored):
    cells = {(r.true, r.predicted): r.n for r in M.confusion_matrix(scored, LABELS).collect()}
    assert len(cells) == 16
    assert {k: n for k, n in cells.items() if n} == {
        ("a", "a"): 3, ("a", "b"): 1, ("b", "b"): 2, ("b", "a"): 2, ("c", "a"): 1,
    }
    rows = M.matrix_rows(M.confusion_matrix(scored, LABELS)).orderBy("true").collect()
    assert [r.counts for r in rows] == [[3, 1, 0, 0], [2, 2, 0, 0], [1, 0, 0, 0], [0] * 4]


def test_report(scored):
    report = {r.label: r for r in M.classification_report(scored, LABELS).collect()}
    assert (report["a"].precision, report["a"].recall, report["a"].support) == (0.5, 0.75, 4)
    assert report["a"].f1 == 2 * 3 / (6 + 4)
    assert (report["b"].precision, report["b"].recall) == (2 / 3, 0.5)
    # Never predicted, and neither true nor predicted.
    assert (report["c"].precision, report["c"].recall, report["c"].f1) == (0, 0, 0)
    assert tuple(report["d"]) == ("d", 0, 0, 0, 0)


def test_averages(scored):
    report = M.classification_report(scored, LABELS)
    f1 = {r.label: r.f1 for r in report.collect()}
    found = {r.average: r for r in M.average_metrics(report).collect()}
    assert found["macro"].f1 == pytest.approx(sum(f1.values()) / 4)
    assert found["weighted"].f1 == pytest.approx((4 * f1["a"] + 4 * f1["b"]) / 9)
    assert found["weighted"].recall == pytest.approx(5 / 9)
    assert {r.label for r in M.all_metrics(scored, LABELS).collect()} == {
        *LABELS, "macro avg", "weighted avg",
    }


def test_fold_scores(scored, spark):
    one = M.weighted_f1_by(scored.selectExpr("*", "0 AS fold"), "fold").first()
    report = M.classification_report(scored, LABELS)
    weighted = M.average_metrics(report).where("average = 'weighted'").first()
    assert one.f1_weighted == pytest.approx(weighted.f1)
    scores = spark.createDataFrame([(1.0,), (0.995,)], "f1_weighted double")
    summary = M.cv_summary(scores).first()
    assert summary.cv_f1_std == pytest.approx(0.0025) and summary.leakage_risk


def test_methods(spark):
    rows = spark.createDataFrame(
        [("a", "a", 0.0005), ("a", "b", 0.0005)], "true string, predicted string, latency_seconds double"
    )
    union = M.union_methods({"one": rows, "two": rows.limit(1)})
    found = {r.method: r for r in M.method_comparison(union).collect()}
    assert (found["one"].accuracy, found["two"].accuracy) == (0.5, 1.0)
    assert found["one"].avg_latency_seconds == round(0.0005, 3)


def test_pairing_counts_what_is_missing(spark):
    truth = spark.createDataFrame([(1, "a"), (2, "b")], "note_id long, true string")
    predicted = spark.createDataFrame([(2, "b"), (3, "b"), (4, "b")], "note_id long, predicted string")
    assert [tuple(r) for r in M.pair_outcomes(truth, predicted).collect()] == [(2, "b", "b")]
    assert tuple(M.unmatched_count(truth, predicted).first()) == (1, 2)


def test_written_report(scored, spark, tmp_path):
    reports.write_report(scored, str(tmp_path), LABELS)
    lines = [r.value for r in reports.read_report(spark, str(tmp_path)).collect()]
    assert len(lines) == 10
    assert lines[0].split() == ["precision", "recall", "f1-score", "support"]
    assert lines[2].split() == ["a", "0.50", "0.75", "0.60", "4"]
    assert lines[7].split() == ["accuracy", "0.56", "9"]
    assert lines[9].split()[:2] == ["weighted", "avg"]
    assert len({len(line) for line in lines if line}) == 1
    metrics = spark.read.json(f"{tmp_path}/metrics").first()
    assert metrics.confusion_matrix == [[3, 1, 0, 0], [2, 2, 0, 0], [1, 0, 0, 0], [0] * 4]
    assert metrics.accuracy == pytest.approx(5 / 9)
    assert metrics.classification_report.a.support == 4


def test_labels_outside_the_list_count(spark):
    rows = [("a", "a")] * 5 + [("a", "x")] * 3 + [("a", None)] * 2
    scored = spark.createDataFrame(rows, "true string, predicted string")
    report = {r.label: r for r in M.classification_report(scored, ["a", "b"]).collect()}
    assert report["a"].support == 10 and report["a"].recall == 0.5 and set(report) == {"a", "b"}
    assert M.outside_count(scored, ["a", "b"]).first().outside == 5
    every = M.classification_report(scored)
    assert {r.label for r in every.collect()} == {"a", "x", None}
    weighted = M.average_metrics(every).where("average = 'weighted'").first()
    assert weighted.recall == M.accuracy(scored).first().accuracy == 0.5
    cells = {(r.true, r.predicted): r.n for r in M.confusion_matrix(scored).collect()}
    assert len(cells) == 9 and cells["a", None] == 2 and cells["a", "x"] == 3 and cells["x", "a"] == 0
