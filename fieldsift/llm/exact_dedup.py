"""Exact duplicates by content sort.

Spark samples splitters of the normalised text and deals the rows out by range,
each task sorts its range (externally, if need be), and rows next to each other
are compared in full. The range key is the first characters of the text, a
digest that parts texts with a common beginning, and a salt. The salt is 0 but
for texts so frequent that one task would have to take all copies; their leaders
per salt, a bounded number, are sorted and compared once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldsift.llm.shared import WHITE, col, fresh, stage

# Characters of a text that are sampled for splitters.
HEAD = 64
# Frequent texts: more copies than this, and than one row in HOT_SHARE. There
# are fewer than HOT_SHARE of them, at any size of the table.
HOT_ROWS = 4096
HOT_SHARE = 1024
SALTS = 32


def normalised(text: str | F.Column) -> F.Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _local_leaders(rows: DataFrame, row_id: str, text: str, mark: str) -> DataFrame:
    """Sort ranges of (head, digest, salt) and compare neighbours in full.

    The rows keep their columns; ``mark`` gains the leader of the run of equal
    texts, the size of the run and the row's place in it.
    """
    key = [f"{mark}.head", f"{mark}.digest", f"{mark}.salt"]
    names = [fresh(rows, f"{mark}_{i}") for i in range(3)]
    norm = fresh(rows, f"{mark}_norm")
    ranged = rows.select("*", *(F.col(k).alias(n) for k, n in zip(key, names, strict=True)))
    ranged = ranged.repartitionByRange(*names).withColumn(norm, normalised(col(text)))
    run = Window.partitionBy(*names, norm).orderBy(
        F.length(F.coalesce(col(text), F.lit(""))).desc(), col(row_id).asc_nulls_last()
    )
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = F.struct(
        F.col(f"{mark}.salt").alias("salt"),
        F.first(col(row_id)).over(whole).alias("keep_id"),
        F.count(F.lit(1)).over(whole).alias("group_size"),
        F.row_number().over(run).alias("place"),
        F.sha2(F.col(norm).cast("binary"), 256).alias("sha"),
        F.length(F.coalesce(col(text), F.lit(""))).alias("length"),
    )
    return ranged.withColumn(mark, found).drop(*names, norm)


def exact_dedup(
    docs: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    found: str = "found",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``docs`` with a struct column ``found`` of the row's group of equal texts.

    Texts are equal when identical without white space. Fields: ``keep_id`` (id
    of the row that stays: most code points, then smallest id, null ids last),
    ``group_size``, ``kept`` (exactly one row of a group, also among repeated
    rows) and ``text_sha256`` of the normalised text. Null counts as empty,
    empty texts are one group, an empty table gives no rows. An input column
    with the name ``found`` must not exist; all others pass through.
    """
    if found in docs.columns:
        raise ValueError(f"column {found} exists")
    mark = fresh(docs, "mark")
    norm = normalised(col(text))
    digest = F.xxhash64(norm)
    least = max(hot_rows, docs.count() // HOT_SHARE)
    hot = [
        r[0]
        for r in docs.select(digest.alias("d")).groupBy("d").count().filter(F.col("count") > least).collect()
    ]
    is_hot = digest.isin(hot) if hot else F.lit(False)

    def keyed(rows: DataFrame, salt: F.Column) -> DataFrame:
        head = F.substring(norm, 1, HEAD)
        return rows.withColumn(mark, F.struct(head.alias("head"), digest.alias("digest"), salt.alias("salt")))

    def final(keep_id: F.Column, size: F.Column, kept: F.Column) -> F.Column:
        return F.struct(
            keep_id.alias("keep_id"),
            size.alias("group_size"),
            kept.alias("kept"),
            F.col(f"{mark}.sha").alias("text_sha256"),
        )

    cold = _local_leaders(keyed(docs.filter(~is_hot) if hot else docs, F.lit(0)), row_id, text, mark)
    m = F.col(mark)
    cold = cold.withColumn(found, final(m.keep_id, m.group_size, m.place == 1)).drop(mark)
    if not hot:
        return cold

    # A frequent text: leaders per salt, then the leader of those.
    salt = F.pmod(F.xxhash64(F.coalesce(col(row_id).cast("string"), F.lit(""))), F.lit(SALTS))
    parts = _local_leaders(keyed(docs.filter(is_hot), salt.cast("int")), row_id, text, mark)
    own = fresh(parts, "own")
    rows = stage(parts.withColumn(own, F.when(m.place == 1, normalised(col(text)))), "hot_texts")
    again = Window.partitionBy("norm").orderBy(F.col("length").desc(), F.col("keep_id").asc_nulls_last(), "salt")
    all_of = again.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leaders = (
        rows.filter(m.place == 1)
        .select(
            m.salt.alias("salt"), m.sha.alias("sha"), m.keep_id.alias("keep_id"),
            m.group_size.alias("n"), m.length.alias("length"), F.col(own).alias("norm"),
        )
        .select(
            F.struct(
                "salt",
                "sha",
                F.first("keep_id").over(all_of).alias("keep_id"),
                F.sum("n").over(all_of).alias("group_size"),
                (F.row_number().over(again) == 1).alias("first"),
            ).alias(own)
        )
    )
    rows = rows.drop(own)
    # At most HOT_SHARE texts times SALTS rows.
    joined = rows.join(
        F.broadcast(leaders),
        (F.col(f"{mark}.sha") == F.col(f"{own}.sha")) & (F.col(f"{mark}.salt") == F.col(f"{own}.salt")),
    )
    o = F.col(own)
    warm = joined.withColumn(found, final(o.keep_id, o.group_size, o.first & (m.place == 1))).drop(mark, own)
    return cold.unionByName(warm)


def drop_copies(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    found = fresh(docs, "found")
    return exact_dedup(docs, row_id, text, found).filter(F.col(f"{found}.kept")).drop(found)
