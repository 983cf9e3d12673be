import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldsift.fixed_values import FALLBACK_METHOD, PRIMARY_METHOD
from fieldsift.operators import history as H
from fieldsift.operators.model import NoteClassifier
from fieldsift.plans.predict import predict_notes, rejected_input
from fieldsift.sources import files
from fieldsift.sources import notes as N
from fieldsift.sources import prediction_log as L
from fieldsift.sources.artifacts import current_version, save_classifier
from fieldsift.streaming.classify import (
    classify_stream,
    classify_stream_tiered,
    count_stream,
    read_counts,
    read_results,
)

NASTY = ['a "quoted", note', " padded ", "line\nbreak", "cr\r\nlf", "back\\slash", "tab\t", "100% é \U0001f600", ""]


@pytest.fixture
def log(spark):
    start = dt.datetime(2024, 1, 1, 23, 59, 59, 999990)
    rows = [
        (start + dt.timedelta(microseconds=i * 3), note, None if i == 3 else "demand_spike")
        for i, note in enumerate(NASTY)
    ]
    return spark.createDataFrame(rows, L.LOG_SCHEMA)


def as_set(df):
    return {tuple(r) for r in df.select(*L.LOG_COLUMNS).collect()}


def test_both_logs_hold_every_character(log, spark, tmp_path):
    csv, jsonl = str(tmp_path / "csv"), str(tmp_path / "jsonl")
    L.save_predictions(log, csv, jsonl)
    assert as_set(L.read_jsonl(spark, jsonl)) == as_set(log)
    assert as_set(L.read_csv(spark, csv)) == as_set(log)
    days = {r.log_date for r in L.read_csv(spark, csv).select("log_date").collect()}
    assert days == {dt.date(2024, 1, 1), dt.date(2024, 1, 2)}


def test_batch_written_again_on_another_day(log, spark, tmp_path):
    path = str(tmp_path / "csv")
    L.append_csv(log, path, "kept")
    L.append_csv(log, path, "again")
    later = log.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 5 DAYS"))
    L.append_csv(later, path, "again")
    found = L.read_csv(spark, path)
    assert as_set(found.filter("batch_id = 'again'")) == as_set(later)
    assert as_set(found.filter("batch_id = 'kept'")) == as_set(log)
    with pytest.raises(ValueError, match="batch id"):
        L.append_csv(log, path, "a/b")


@pytest.mark.parametrize("file_format", ["json", "csv"])
def test_newest_days_only(spark, tmp_path, file_format):
    path = str(tmp_path / "log")
    assert L.read_newest(spark, path, 3, file_format).count() == 0
    start = dt.datetime(2024, 1, 1)
    times = [None] + [start + dt.timedelta(days=d // 2) for d in range(20)]
    rows = spark.createDataFrame([(t, f"n{i}", "c") for i, t in enumerate(times)], L.LOG_SCHEMA)
    (L.append_csv if file_format == "csv" else L.append_jsonl)(rows, path)
    whole = L._read(spark, path, file_format)
    for limit in (1, 3, 5, 20, 21, 30):
        newest = L.read_newest(spark, path, limit, file_format)
        wanted = [r.input_note for r in H.history(whole, limit, "input_note").collect()]
        assert [r.input_note for r in H.history(newest, limit, "input_note").collect()] == wanted
        if limit <= 5:
            read = {f.split("log_date=")[1][:10] for f in newest.inputFiles()}
            assert len(read) == {1: 1, 3: 2, 5: 4}[limit] and max(read) == "2024-01-10"


def test_append_and_replace(log, spark, tmp_path):
    path = str(tmp_path / "jsonl")
    L.append_jsonl(log, path)
    L.append_jsonl(log, path, "batch")
    L.append_jsonl(log, path, "batch")
    assert L.read_jsonl(spark, path).count() == 2 * len(NASTY)


def test_missing_log_is_empty(spark, tmp_path):
    for read in (L.read_csv, L.read_jsonl):
        empty = read(spark, str(tmp_path / "none"))
        assert empty.count() == 0 and set(L.LOG_COLUMNS) <= set(empty.columns)


def test_blank_lines_are_skipped_and_broken_ones_fail(spark, tmp_path):
    day = tmp_path / "batch_id=x" / "log_date=2024-01-01"
    day.mkdir(parents=True)
    good = '{"timestamp": "2024-01-01T10:00:00", "input_note": "a", "issue_category": "b"}'
    (day / "part.json").write_text(f"{good}\n\n{good}\n")
    assert len(L.read_jsonl(spark, str(tmp_path)).collect()) == 2
    (day / "part.json").write_text(f"{good}\n{{broken\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        L.read_jsonl(spark, str(tmp_path)).collect()


def both_logs(spark, csv, jsonl):
    return as_set(L.read_csv(spark, csv)), as_set(L.read_jsonl(spark, jsonl))


@pytest.mark.parametrize("fault", ["csv", "json", "manifest"])
def test_a_write_that_fails_changes_neither_log(log, spark, tmp_path, monkeypatch, fault):
    csv, jsonl = str(tmp_path / "csv"), str(tmp_path / "jsonl")
    old, new = log.limit(3), log.subtract(log.limit(3))
    L.save_predictions(old, csv, jsonl, "first")
    L.save_predictions(old, csv, jsonl, "again")
    write = L._write

    def broken(rows, path, batch_id, attempt, file_format):
        write(rows, path, batch_id, attempt, file_format)
        if file_format == fault:
            raise OSError("lost")

    def unpublished(*args):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(L, "_write", broken)
        if fault == "manifest":
            patch.setattr(L.files, "publish", unpublished)
        for batch in ("second", "again"):
            with pytest.raises(OSError, match="lost"):
                L.save_predictions(new, csv, jsonl, batch)
    before = as_set(old)
    assert both_logs(spark, csv, jsonl) == (before, before)
    assert L.read_csv(spark, csv).count() == L.read_jsonl(spark, jsonl).count() == 6
    assert L.read_newest(spark, jsonl, 100).count() == 6
    L.save_predictions(new, csv, jsonl, "again")
    assert both_logs(spark, csv, jsonl) == (as_set(log), as_set(log))
    assert L.read_csv(spark, csv).count() == len(NASTY)
    assert L.drop_unpublished(spark, csv) > 0
    assert L.read_csv(spark, csv).count() == L.read_jsonl(spark, jsonl).count() == len(NASTY)


def test_an_empty_batch_replaces_a_full_one(log, spark, tmp_path):
    csv, jsonl = str(tmp_path / "csv"), str(tmp_path / "jsonl")
    L.save_predictions(log, csv, jsonl, "batch")
    L.save_predictions(log.limit(0), csv, jsonl, "batch")
    assert both_logs(spark, csv, jsonl) == (set(), set())
    L.append_csv(log, csv, "own")  # a batch of one log alone
    assert both_logs(spark, csv, jsonl) == (as_set(log), set())


def test_a_name_is_written_once(spark, tmp_path):
    folder = str(tmp_path / "names")
    assert files.names(spark, folder) == [] and files.newest(spark, folder) == {}
    assert files.write_new(spark, folder, "k.000000001.json", "first")
    assert not files.write_new(spark, folder, "k.000000001.json", "second")
    assert files.publish(spark, folder, "k", "third") == 2
    assert files.newest(spark, folder) == {"k": 2}
    assert files.read_text(spark, files.version_path(folder, "k", 1)) == "first"
    assert all(n.startswith("k.") for n in files.names(spark, folder))


def test_history(log):
    newest = [r.input_note for r in H.history(log).collect()]
    assert newest == NASTY[::-1]
    assert [r.input_note for r in H.history(log, 2).collect()] == NASTY[:-3:-1]
    recent = H.recent_predictions(log, 3)
    assert recent.columns == ["timestamp", "issue_category"]
    times = [r.timestamp for r in recent.collect()]
    assert times == sorted(times) and len(times) == 3
    assert H.recent_predictions(log.drop("issue_category")).columns == ["timestamp"]
    counts = {r.issue_category: r.n for r in H.category_counts(log).collect()}
    assert counts == {"demand_spike": 7, "unknown": 1}


def test_scan_notes(spark, tmp_path):
    path = tmp_path / "notes.csv"
    path.write_text(
        'rep_note,issue_category,region\n"low ""stock"", now",DEMAND_SURGE,1\n'
        'NA,OTHER,2\n"two\nlines", demand_surge ,\n123,nan,4\n'
    )
    rows = N.scan_notes(spark, str(path)).orderBy("note_id").collect()
    assert [r.rep_note for r in rows] == ['low "stock", now', None, "two\nlines", "123"]
    assert [r.issue_category for r in rows] == ["DEMAND_SURGE", "OTHER", " demand_surge ", None]
    assert [r.region for r in rows] == ["1", "2", None, "4"]
    assert [r.note_id for r in rows] == [0, 1, 2, 3]


def test_scan_other_formats(spark, tmp_path):
    df = spark.createDataFrame([(5, "a", "OTHER")], "note_id int, rep_note string, issue_category string")
    for file_format in ("parquet", "json"):
        path = str(tmp_path / file_format)
        df.write.format(file_format).save(path)
        assert N.scan_notes(spark, path, file_format).first().note_id == 5


def test_scan_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        N.scan_notes(spark, str(tmp_path / "none.csv"))
    wrong = tmp_path / "wrong.csv"
    wrong.write_text("wrong_column,another\n1,2\n")
    with pytest.raises(ValueError, match="issue_category"):
        N.scan_notes(spark, str(wrong))


def test_labelled_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(n, "demand_spike") for n in NASTY], N.LABELLED_SCHEMA)
    path = N.write_labelled_jsonl(df, str(tmp_path / "x"))
    assert {tuple(r) for r in N.read_labelled_jsonl(spark, path).collect()} == {
        tuple(r) for r in df.collect()
    }


def test_predict_keeps_the_note_as_it_came(spark):
    notes = spark.createDataFrame(
        [(1, " STK   shortage!! "), (2, "  "), (3, "x" * 1001), (4, None)], "note_id long, rep_note string"
    )
    found = predict_notes(notes).orderBy("note_id").collect()
    assert [(r.status, r.cleaned_note, r.issue_category, r.method) for r in found] == [
        ("ok", "stock shortage!", "supply_chain_delay", "keyword"),
        ("blank", None, None, None),
        ("too_long", None, None, None),
        ("missing", None, None, None),
    ]
    assert [r.input_note for r in found] == [" STK   shortage!! ", "  ", "x" * 1001, None]
    assert {r.note_id: r.status for r in rejected_input(notes).collect()} == {
        2: "blank", 3: "too_long", 4: "missing",
    }


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_path):
    source, schema = tmp_path / "in", "note_id long, rep_note string"
    paths = [str(tmp_path / p) for p in ("csv", "jsonl", "checkpoint")]

    def feed(first, last):
        rows = [(i, "  " if i % 7 == 0 else f"stk low {i}") for i in range(first, last)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(source))
        classify_stream(stream, *paths, rejects_path=str(tmp_path / "rejects")).awaitTermination()

    def logged():
        return [
            sorted((r.input_note, r.issue_category) for r in read(spark, p).collect())
            for read, p in ((L.read_csv, paths[0]), (L.read_jsonl, paths[1]))
        ]

    feed(0, 50)
    run()
    run()
    feed(50, 80)
    run()
    expected = sorted(
        (r.input_note, r.issue_category)
        for r in predict_notes(spark.read.parquet(str(source))).where("status = 'ok'").collect()
    )
    assert logged() == [expected, expected]
    both = L.read_csv(spark, paths[0]).intersect(L.read_jsonl(spark, paths[1]))
    assert both.count() == len(expected)
    rejects = spark.read.json(str(tmp_path / "rejects"))
    assert {r.note_id for r in rejects.collect()} == set(range(0, 80, 7))
    assert {r.status for r in rejects.collect()} == {"blank"} and rejects.count() == 12


def test_count_stream(spark, tmp_path, log):
    paths = [str(tmp_path / p) for p in ("log", "counts", "checkpoint")]
    counts = lambda: {tuple(r) for r in read_counts(spark.newSession(), paths[1]).collect()}

    def run():
        stream = spark.readStream.schema(log.schema).parquet(paths[0])
        count_stream(stream, *paths[1:]).awaitTermination()

    assert counts() == set()
    for _ in range(2):
        log.write.mode("append").parquet(paths[0])
        run()
        run()
    doubled = {tuple(r) for r in H.category_counts(log.unionByName(log)).collect()}
    assert counts() == doubled
    # The last batch is repeated when its commit was lost.
    for file in (tmp_path / "checkpoint" / "commits").iterdir():
        if file.name.strip(".").split(".")[0] == "1":
            file.unlink()
    run()
    assert counts() == doubled


def test_tiered_stream_keeps_the_version_of_a_repeated_batch(spark, tmp_path, monkeypatch):
    rows = [(i, f"{'shortage of stock' if i % 2 else 'price war'} {i}", ["a", "b"][i % 2]) for i in range(40)]
    train = spark.createDataFrame(rows, "note_id long, input string, output string")
    store, results, source = (str(tmp_path / p) for p in ("model", "results", "in"))
    paths = [str(tmp_path / p) for p in ("csv", "jsonl")]
    save = lambda: save_classifier(spark, NoteClassifier.fit(train, n_trees=3, tree_depth=3), store)
    save()

    def feed(first, last):
        notes = [(i, "  " if i % 7 == 0 else rows[i % 40][1]) for i in range(first, last)]
        spark.createDataFrame(notes, "note_id long, rep_note string").write.mode("append").parquet(source)

    def primary(notes):
        known = notes.where("note_id % 5 = 1 AND rep_note <> '  '")
        return known.selectExpr("note_id", "'demand_spike' AS raw_output", "0.5D AS latency_seconds")

    def run():
        stream = spark.readStream.schema("note_id long, rep_note string").parquet(source)
        classify_stream_tiered(stream, store, *paths, results, str(tmp_path / "checkpoint"), primary).awaitTermination()

    feed(0, 20)
    run()
    save()
    assert current_version(spark, store) == 2
    feed(20, 40)
    with monkeypatch.context() as patch:
        patch.setattr(L.files, "publish", lambda *a: 1 / 0)
        with pytest.raises(Exception, match="ZeroDivisionError"):
            run()
    save()
    run()
    found = {r.note_id: r for r in read_results(spark, results).collect()}
    assert len(found) == 40
    assert {i: r.model_version for i, r in found.items()} == {i: 1 if i < 20 else 2 for i in range(40)}
    for i, r in found.items():
        if i % 7 == 0:
            assert (r.status, r.method, r.issue_category) == ("blank", None, None)
        elif i % 5 == 1:
            assert (r.method, r.issue_category) == (PRIMARY_METHOD, "demand_spike")
        else:
            assert (r.method, r.issue_category) == (FALLBACK_METHOD, rows[i % 40][2])
    logged = sorted((r.input_note, r.issue_category) for r in found.values() if r.status == "ok")
    assert logged == sorted((r.input_note, r.issue_category) for r in L.read_csv(spark, paths[0]).collect())
    assert logged == sorted((r.input_note, r.issue_category) for r in L.read_jsonl(spark, paths[1]).collect())


def test_log_rows_are_stamped(spark):
    rows = L.log_rows(spark.createDataFrame([("a", "b")], "input_note string, issue_category string"))
    assert rows.select(F.typeof("timestamp")).first()[0] == "timestamp_ntz"
