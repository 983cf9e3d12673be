"""Views on tables that are a file or a folder of files."""

from pyspark.sql import functions as F

from fieldsift.plans.inputs import view_stream


def test_stream_of_a_table_of_several_files(spark, tmp_path):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("note "), F.col("id")).alias("text"))
    docs.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    one = tmp_path / "file" / "documents.parquet"
    one.parent.mkdir()
    docs.toPandas().to_parquet(one)
    for kind in ("folder", "file"):
        got = []
        view_stream(spark, str(tmp_path / kind), "v_notes").writeStream.foreachBatch(
            lambda batch, _, got=got: got.extend(r.note_id for r in batch.collect())
        ).option("checkpointLocation", str(tmp_path / f"checkpoint-{kind}")).trigger(
            availableNow=True
        ).start().awaitTermination()
        assert sorted(got) == list(range(40)), kind
