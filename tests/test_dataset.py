import pytest

from fieldsift.operators import contracts as C
from fieldsift.operators import dataset as D
from fieldsift.plans.prepare import prepare_dataset

RAW = "note_id long, rep_note string, issue_category string"


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(
        [
            (1, " low stock ", "SUPPLY_CHAIN_ISSUE"),
            (2, "low stock", " demand_surge "),
            (3, "   ", "DEMAND_SURGE"),
            (4, None, "OTHER"),
            (5, "rival", "OTHER"),
            (6, "rival", None),
            (7, "low stock", "DEMAND_SURGE"),
        ],
        RAW,
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_valid_and_rejected_cover_all(raw):
    assert rows(D.valid_notes(raw)) == [
        (1, "low stock", "supply_chain_delay"),
        (2, "low stock", "demand_spike"),
        (7, "low stock", "demand_spike"),
    ]
    assert rows(D.rejected_notes(raw).select("note_id", "reject_reason")) == [
        (3, "missing_note"), (4, "missing_note"),
        (5, "unknown_category"), (6, "unknown_category"),
    ]
    assert rows(D.load_stats(raw)) == [(7, 3, 4)]


def test_strict_differs(raw):
    assert rows(D.strict_notes(raw)) == [
        (1, "low stock", "supply_chain_delay"), (3, "", "demand_spike"),
        (7, "low stock", "demand_spike"),
    ]


def test_duplicates(raw):
    valid = D.valid_notes(raw)
    assert rows(D.duplicate_count(valid)) == [(2, True)]
    assert rows(D.dedup_first(valid)) == [(1, "low stock", "supply_chain_delay")]
    assert rows(D.duplicate_count(valid.limit(0))) == [(0, False)]


def test_too_few_records(raw):
    with pytest.raises(ValueError, match="too few"):
        prepare_dataset(raw)


def test_prepare_has_no_leakage(spark):
    notes = spark.createDataFrame(
        [(i, f"note {i % 40}", "DEMAND_SURGE" if i % 3 else "SUPPLY_CHAIN_ISSUE") for i in range(100)],
        RAW,
    )
    prepared = prepare_dataset(notes)
    found = prepared.collect()
    assert sorted(r.note_id for r in found) == list(range(40))
    assert sum(r.split == "test" for r in found) == 8
    train = {r.input for r in found if r.split == "train"}
    assert not train & {r.input for r in found if r.split == "test"}


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "output string")
    assert rows(D.class_weights(df)) == [("a", 3, 4 / 6), ("b", 1, 2.0)]


@pytest.mark.parametrize(
    "note, status",
    [(None, "missing"), ("", "too_short"), ("a", "ok"), ("a" * 1000, "ok"),
     ("a" * 1001, "too_long"), (" \u00a0", "blank"), ("\U0001f600" * 1000, "ok")],
)
def test_note_contract(spark, note, status):
    df = spark.createDataFrame([(note,)], "rep_note string")
    assert C.note_contract(df).first().status == status


def test_batch_contract(spark):
    batches = {
        0: ["a"],
        1: ["a"] * 50,
        2: ["a"] * 51 + [" "],
        3: ["a", " ", "b" * 1001],
        4: ["a", "b" * 1001, " "],
        5: [" " * 1001],
    }
    df = spark.createDataFrame(
        [(b, i, n) for b, notes in batches.items() for i, n in enumerate(notes)],
        "batch_id long, idx long, rep_note string",
    )
    by_id = {r.batch_id: r for r in C.batch_contract(df).collect()}
    assert [by_id[b].accepted for b in range(6)] == [True, True, False, False, False, False]
    assert (by_id[3].first_bad_index, by_id[3].reason) == (1, "blank")
    assert (by_id[4].first_bad_index, by_id[4].reason) == (1, "too_long")
    assert (by_id[5].first_bad_index, by_id[5].reason) == (0, "too_long")
    assert (by_id[2].first_bad_index, by_id[2].reason) == (None, "too_many_notes")


def test_prediction_contract(spark):
    df = spark.createDataFrame(
        [("a", 0.0, "m"), ("a", 1.0, "m"), ("a", 1.1, "m"), ("a", -0.1, "m"),
         ("a", float("nan"), "m"), ("a", None, "m"), (None, 0.5, "m")],
        "issue_category string, confidence double, method string",
    )
    found = C.prediction_contract(df).collect()
    assert [r.in_range for r in found] == [True, True, False, False, False, False, True]
    assert [r.valid for r in found] == [True, True] + [False] * 5
