"""Physical plans: what must not move, and what must reach the scan."""

import pytest
from pyspark.sql import functions as F

from fieldsift.functions import labels, text
from fieldsift.operators import chat, dataset, features, history, sampling
from fieldsift.plans.predict import predict_notes
from fieldsift.plans.queries import QUERIES
from fieldsift.session import stage

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def notes(spark):
    rows = [(i, f"stk low {i}", "DEMAND_SURGE" if i % 2 else "SUPPLY_CHAIN_ISSUE", i) for i in range(60)]
    return stage(
        spark.createDataFrame(rows, "note_id long, rep_note string, issue_category string, extra long"),
        "plan-notes",
    )


@pytest.fixture(scope="module")
def valid(notes):
    return stage(dataset.valid_notes(notes), "plan-valid")


def test_row_local_work_is_not_shuffled(notes, valid):
    note = F.col("rep_note")
    model = features.TfidfModel.fit(valid, min_df=1)
    for df in (
        notes.select(text.clean_note(note), text.redact_secrets(note), text.strip_accents(note)),
        notes.select(labels.parse_category(note), labels.extract_category(note)),
        dataset.rejected_notes(notes),
        predict_notes(notes),
        features.weight_rows(model.transform(valid)),
        model.transform(valid).select(model.vector()),
    ):
        assert "Exchange" not in plan(df)
        assert "Python" not in plan(df)


def test_split_moves_no_texts(valid):
    found = plan(sampling.stratified_split(valid))
    texts = [line for line in found.splitlines() if "input#" in line]
    assert texts and not any("Exchange" in line for line in texts)
    assert "BroadcastHashJoin" in found and "SortMergeJoin" not in found


def test_duplicates_shuffle_digests_only(valid):
    found = plan(dataset.duplicate_count(valid))
    assert found.count("Exchange hashpartitioning") == 1
    assert "partial_count" in found


def test_columns_and_filters_reach_the_scan(notes):
    found = plan(dataset.load_stats(notes))
    assert "extra" not in found.split("ReadSchema")[1]
    found = plan(dataset.strict_notes(notes))
    assert "IsNotNull(rep_note)" in found and "In(issue_category" in found


def test_limited_history_is_a_top_k(notes):
    log = notes.withColumn("timestamp", F.col("note_id"))
    assert "TakeOrderedAndProject" in plan(history.history(log, 3, "note_id"))


def test_chat_checks_roles_without_texts(spark):
    turns = stage(
        spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string"),
        "plan-turns",
    )
    found = plan(chat.render_conversations(turns))
    scans = [line for line in found.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and sum("text" in line.split("ReadSchema")[1] for line in scans) == 1


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"cv_train", "model_roundtrip"}))
def test_no_cross_join_and_no_python(spark, name):
    found = plan(QUERIES[name](spark, SF_DIR))
    for node in ("CartesianProduct", "NestedLoop", "EvalPython", "InPandas", "MapInArrow", "REPARTITION_BY_NUM"):
        assert node not in found
