"""Records cut in many tasks against Spark's reader of whole files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fieldsift.operators.sampling import stratified_split
from fieldsift.sources import csv_records
from fieldsift.sources import notes as N

CELLS = ["", "a", 'say ""so""', "two\nlines", "\n", "\n\n,x\n", "a,b", "cr\r\nlf", " pad ", "é\U0001f600", '""', "x" * 300 + "\n" * 7]


def csv_text(rng, rows, end):
    lines = ["rep_note,issue_category,extra"]
    for i in range(rows):
        cells = [rng.choice(CELLS) for _ in range(2)] + [str(i)]
        lines.append(",".join(f'"{c}"' if rng.random() < 0.5 or set(c) & set('",\n\r') or not c else c for c in cells))
        if rng.random() < 0.1:
            lines.append("")
    return end.join(lines) + (end if rng.random() < 0.5 else "")


@pytest.fixture
def splits(spark):
    """Runs a function with files read in splits of some bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]

    def run(size, fn):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
        return fn()

    yield run
    for n, value in zip(names, old):
        spark.conf.set(n, value)


def rows_of(df, number="note_id"):
    return [tuple(r) for r in df.select("rep_note", "issue_category", "extra", number).orderBy(number).collect()]


@pytest.mark.parametrize(("seed", "end"), [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_any_split_size_gives_the_rows_of_whole_files(spark, tmp_path, splits, seed, end):
    rng = random.Random(seed)
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_bytes(csv_text(rng, 40, end).encode())
    whole = []
    for name in ("a", "b"):
        df = spark.read.options(**N.CSV_OPTIONS).csv(str(tmp_path / f"{name}.csv"))
        whole += [tuple(r) for r in df.withColumn("n", F.monotonically_increasing_id()).orderBy("n").drop("n").collect()]
    wanted = [(*r, i) for i, r in enumerate(whole)]
    if end == "\r\n":  # the reader of whole files then takes \n in cells
        wanted = [tuple(x.replace("\n", end) if isinstance(x, str) else x for x in r) for r in wanted]
    tasks = []
    for size in (150, 2000, 10_000_000):
        df = splits(size, lambda: csv_records.read_csv_records(spark, str(tmp_path), N.CSV_OPTIONS))
        tasks.append(df.rdd.getNumPartitions())
        found = rows_of(df, csv_records.NUMBER)
        if end == "\r\n":
            found = [tuple(re.sub("\r?\n", end, x) if isinstance(x, str) else x for x in r) for r in found]
        assert found == wanted
    assert tasks[0] > tasks[-1]


def test_one_record_over_many_blocks(spark, tmp_path, splits):
    text = "rep_note,issue_category,extra\n" + '"' + "long\n" * 500 + '",b,1\nlast,c,2\n"open to the end\nof the file,'
    (tmp_path / "x.csv").write_text(text)
    found = splits(64, lambda: rows_of(csv_records.read_csv_records(spark, str(tmp_path), N.CSV_OPTIONS), csv_records.NUMBER))
    assert found[:2] == [("long\n" * 500, "b", "1", 0), ("last", "c", "2", 1)] and found[2][3] == 2 and len(found) == 3


def test_header_over_two_blocks_and_empty_files(spark, tmp_path, splits):
    (tmp_path / "a.csv").write_text('rep_note,"issue_category","extra\ncolumn"\n1,2,3\n')
    (tmp_path / "b.csv").write_text('rep_note,"issue_category","extra\ncolumn"\n')
    (tmp_path / "c.csv").write_text('rep_note,"issue_category","extra\ncolumn"\n4,5,6\n7\n')
    df = splits(40, lambda: csv_records.read_csv_records(spark, str(tmp_path), N.CSV_OPTIONS))
    assert df.columns == [csv_records.NUMBER, "rep_note", "issue_category", "extra\ncolumn"]
    assert sorted(map(tuple, df.collect())) == [(0, "1", "2", "3"), (1, "4", "5", "6"), (2, "7", None, None)]


@pytest.mark.parametrize("file_format", ["csv", "json", "parquet"])
def test_ids_do_not_depend_on_splits(spark, tmp_path, splits, file_format):
    df = spark.range(400).select(
        F.concat(F.lit("note "), "id").alias("rep_note"), F.element_at(F.array(*map(F.lit, "ab")), (F.col("id") % 2 + 1).cast("int")).alias("issue_category")
    ).repartition(3)
    path = str(tmp_path / "notes")
    df.write.option("header", True).option("parquet.block.size", 1024).format(file_format).save(path)
    found = []
    for size in (1000, 10_000_000):
        notes = splits(size, lambda: N.scan_notes(spark, path, file_format, multi_line=False))
        ids = {r.rep_note: r.note_id for r in notes.collect()}
        assert sorted(ids.values()) == list(range(400))
        split = stratified_split(notes.withColumnRenamed("issue_category", "output"))
        found.append((ids, {r.note_id for r in split.where("split = 'test'").collect()}))
    assert found[0] == found[1]
