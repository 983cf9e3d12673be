"""Queries against their SQL; the odd cases of exact dedup, mixing and WARC."""

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldsift.llm import exact_dedup as dedup
from fieldsift.llm import mixing, warc
from fieldsift.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    found = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    wanted = con.execute(ORACLES[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    rows = [tuple(r[c] for c in columns) for r in found.collect()]
    assert sorted(rows, key=repr) == sorted(wanted.fetchall(), key=repr)


DOCS = [
    (1, "a b", "x"), (2, "ab ", "y"), (3, "a  b", "x"), (3, "a  b", "x"), (4, None, None),
    (5, " \t\n", "x"), (None, "ab", "z"), (6, "c" * 50_000, "x"), (7, "", "y"),
]


def docs(spark, rows=DOCS):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumn("found", F.lit(1)).withColumn("mark", F.lit(2)).withColumn("KEPT", F.lit(3))


@pytest.mark.parametrize("hot_rows", [dedup.HOT_ROWS, 1])
def test_exact_dedup_odd_rows(spark, hot_rows):
    df = docs(spark)
    rows = dedup.exact_dedup(df, found="out", hot_rows=hot_rows).collect()
    assert len(rows) == len(DOCS) and rows[0].__fields__[:6] == df.columns
    same = [r for r in rows if (r.text or "").replace(" ", "") == "ab"]
    assert {r.out.keep_id for r in same} == {3} and {r.out.group_size for r in same} == {5}
    assert sum(r.out.kept for r in same) == 1
    empty = [r for r in rows if not (r.text or "").strip()]
    assert {r.out.keep_id for r in empty} == {5} and {r.out.group_size for r in empty} == {3}
    assert dedup.drop_copies(df).count() == 3
    assert dedup.drop_copies(df.limit(0)).count() == 0


def test_exact_dedup_hot_text(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(F.col("id").cast("string")).alias("text")
    )
    out = dedup.exact_dedup(rows, hot_rows=10)
    hot = out.filter("text = 'hot text'").select("found.*").distinct()
    assert hot.count() == 2 and hot.filter("kept").first()["keep_id"] == 0
    assert out.filter("found.kept").count() == 2001


def test_mixing_odd_rows(spark):
    df = docs(spark)
    rows = mixing.mix_report(df).collect()
    assert len(rows) == len(DOCS) and all(r.taken <= 3 * r["size"] for r in rows)
    assert abs(sum({r.source_size: r.target for r in rows}.values())) >= 0
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    per = {r.doc_id: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    sizes = {r.doc_id: (r["size"], r.taken) for r in rows if r.doc_id not in (3, None)}
    assert all(size * per.get(i, 0) == taken for i, (size, taken) in sizes.items())
    assert mixing.mix_report(df.limit(0)).count() == 0


def test_mixing_meets_targets(spark):
    df = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (F.col("id") % 17 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 100 == 1, "b").otherwise("c").alias("source"),
    )
    sums = mixing.mix_report(df).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r["t"] - r["target"]) <= 17 for r in sums)
    assert max(r["target"] / r["source_size"] for r in sums) == 3.0


def test_warc_round_trip(spark):
    long = "é" * 600
    rows = [(1, "http://a/\r\nb", long), (2, None, long), (2, None, long), (3, "u", None), (4, "u", "x"), (5, "u", "x"),
            (None, "u", long), (6, "u", "y" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    found = {}
    for r in warc.archive(df).collect():
        found.setdefault(r.page_id, []).append((r.payload_bytes, r.record_type, r.refers_to))
    assert found[1] == [(1200, "revisit", 2)] and found[2] == [(1200, "response", None)] * 2
    assert found[3] == [(0, "response", None)] and found[4] == found[5] == [(1, "response", None)]
    assert found[None] == [(1200, "response", None)] and found[6] == [(3_000_000, "response", None)]
    assert warc.archive(df.limit(0)).count() == 0
    listed, n = warc.write_warc(df.repartition(1), file_bytes=100)
    assert n > 3 and warc.read_warc(listed, n).count() == len(rows)


def test_warc_reader_refuses_damage():
    import io
    import zlib

    good = warc.record(1, "u", b"payload" * 100, None) + warc.record(2, "u", b"", 1)
    assert [r.fields["warc-type"] for r in warc.read_records(io.BytesIO(good).read)] == ["response", "revisit"]
    plain = zlib.decompress(warc.record(1, "u", b"payload", None), 31)
    for bad in (plain.replace(b"payload", b"paylaod"), plain[:-6]):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(packer.compress(bad) + packer.flush()).read))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good[:50]).read))


def test_mix_takes_empty_texts_no_more_than_most(spark):
    rows = [(i, "w" if i % 8 == 3 else "", "b") for i in range(40)] + [(100 + i, "w " * 50, "a") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.unionByName(df.selectExpr("doc_id + 1000 as doc_id", "text", "'c' as source").filter("text = 'w'"))
    per = {(r.source, r.doc_id): r["n"] for r in mixing.mix(df).groupBy("source", "doc_id").agg(F.count("*").alias("n")).collect()}
    assert max(per.values()) == mixing.MOST
    empty = [n for (source, i), n in per.items() if source == "b" and i % 8 != 3]
    assert empty == [mixing.MOST] * 35
