"""Readers and writers of labelled notes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import NA_VALUES
from ..session import stage
from .csv_records import MOST_BLOCKS, NUMBER, read_csv_records

REQUIRED_COLUMNS = ("rep_note", "issue_category")

# Quotes are doubled, lines may break inside quotes, nothing is trimmed.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
LABELLED_SCHEMA = "input string, output string"


def path_missing(error: AnalysisException) -> bool:
    """Whether Spark failed because there is no file at the path."""
    return "PATH_NOT_FOUND" in (error.getCondition() or "")


def require_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    """``df`` itself; fails if a required column is missing."""
    missing = set(required) - set(df.columns)
    if missing:
        raise ValueError(
            f"missing required columns: {sorted(missing)}; available: {df.columns}"
        )
    return df


def scan_notes(
    spark: SparkSession,
    path: str,
    file_format: str = "csv",
    na_values: list[str] = NA_VALUES,
    multi_line: bool = True,
) -> DataFrame:
    """Labelled notes with ``note_id``; extra columns are kept.

    CSV cells are read as text, and those in ``na_values`` count as missing.
    Multi-line CSV is cut into records by all tasks, also within a file, and
    staged, since later steps read the notes more than once; set ``multi_line``
    to false if no note holds a line break. Without a ``note_id`` column, notes
    are numbered in the order of paths and of rows in a file, whatever the size
    of the splits.
    """
    try:
        if file_format == "csv" and multi_line:
            df = read_csv_records(spark, path, CSV_OPTIONS)
        else:
            reader = spark.read
            if file_format == "csv":
                reader = reader.options(**CSV_OPTIONS).option("multiLine", False)
            df = reader.format(file_format).load(path)
    except AnalysisException as error:
        if path_missing(error):
            raise FileNotFoundError(path) from error
        raise
    require_columns(df)
    if "note_id" in df.columns:
        df = df.withColumn("note_id", F.col("note_id").cast("bigint")).drop(NUMBER)
    elif NUMBER in df.columns:
        columns = [F.col(f"`{c}`") for c in df.columns if c != NUMBER]
        df = df.select(*columns, F.col(NUMBER).alias("note_id"))
    else:
        df = numbered(df, file_format)
    if file_format == "csv" and multi_line:
        df = stage(df, "notes")
    if file_format == "csv":
        df = df.select(
            *[
                F.col(c) if c == "note_id" else F.when(~F.col(f"`{c}`").isin(na_values), F.col(f"`{c}`")).alias(c)
                for c in df.columns
            ]
        )
    return df


def numbered(df: DataFrame, file_format: str) -> DataFrame:
    """Rows read from files with ``note_id``, their place in the order of paths.

    Counts per file, or per split where the format knows no row numbers, give
    the number of rows before it; nothing is shuffled but those counts.
    """
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    if file_format == "parquet":
        block, place = F.lit(0).cast("bigint"), F.col("_metadata.row_index")
    else:
        # Rows of a split follow each other in one task, in this scan and the next.
        place = F.monotonically_increasing_id()
    keyed = df.select("*", file.alias("_file"), block.alias("_block"), place.alias("_place"))
    splits = keyed.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_place").alias("low")).collect()
    if len(splits) > MOST_BLOCKS:
        raise ValueError(f"{len(splits)} splits: set spark.sql.files.maxPartitionBytes higher")
    before, rows = 0, []
    for r in sorted(splits, key=lambda r: (r["_file"], r["_block"])):
        rows.append((r["_file"], r["_block"], before - (0 if file_format == "parquet" else r["low"])))
        before += r["n"]
    schema = "_file string, _block long, _shift long"
    shifts = F.broadcast(df.sparkSession.createDataFrame(rows, schema))
    return keyed.join(shifts, ["_file", "_block"]).select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_place") + F.col("_shift")).alias("note_id")
    )


def write_labelled_jsonl(df: DataFrame, path: str) -> str:
    """Write one {"input", "output"} object per line; returns the path."""
    df.select("input", "output").write.mode("overwrite").option(
        "ignoreNullFields", "false"
    ).json(path)
    return path


def read_labelled_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Read what :func:`write_labelled_jsonl` wrote; a broken line is an error."""
    return spark.read.schema(LABELLED_SCHEMA).option("mode", "FAILFAST").json(path)
