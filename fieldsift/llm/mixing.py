"""Mixing sources to target weights with hash-threshold histograms.

A document is taken ``whole`` times, and once more if its hash lies below its
source's threshold. The threshold comes from sums of words by source and hash
bucket: the bucket in which the budget runs out is split into finer buckets,
level after level, until it holds one hash. Nothing is sorted by hash, and a
source with most of the rows is as cheap as any other, since sums are combined
before they move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldsift.llm.shared import WHITE, col, fresh, stage

WEIGHTS = (5, 2, 1)
# No document is taken more often than this.
MOST = 3
# Bits of a hash, and bits by which a bucket is split.
BITS = 60
STEP = 10
SEED = "mix"


def words(text: F.Column) -> F.Column:
    """Number of runs of characters that are not white space; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def document_hash(row_id: F.Column) -> F.Column:
    """60 bits of a seeded digest of the id; a null id counts as empty text."""
    seeded = F.concat(F.lit(f"{SEED}:"), F.coalesce(row_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(seeded), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size).

    Weights go to the sources in order of code points, null last. Shares above
    ``most`` times the source are cut and the rest is shared out by weight: in
    order of (cap / weight), a source is capped while the level that the open
    sources would reach lies above its cap. One row per source is sorted.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    cap = F.lit(most) * F.col("source_size")
    ranked = sizes.withColumn("place", place).withColumn("weight", weight).withColumn("cap", cap)
    ranked = ranked.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "place")
    every = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(every)
    level = (total - capped).cast("double") / open_weight
    ranked = ranked.withColumn("level", level)
    free = F.when(F.col("level") <= F.col("ratio"), F.col("level"))
    return ranked.withColumn("share", F.first(free, ignorenulls=True).over(every)).select(
        "source",
        "source_size",
        F.least(F.col("cap").cast("double"), F.col("share") * F.col("weight")).alias("target"),
    )


def thresholds(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, whole, cut) for rows of (source, size, hash).

    A row is taken ``whole`` times, and once more if hash < cut. ``cut`` is the
    point at which the words taken come nearest to the target from either side;
    rows with one hash go together.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = (
        targets(sizes, weights, most)
        .withColumn("whole", F.least(whole, F.lit(most)).cast("long"))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("below", F.lit(0).cast("long"))
        .withColumn("prefix", F.lit(0).cast("long"))
        # A source at its cap has no budget left; no document is taken once more.
        .withColumn("cut", F.when(F.col("whole") >= most, 0).cast("long"))
    )
    state = stage(state, "mix_0")
    for level in range(1, BITS // STEP + 1):
        if state.filter(F.col("cut").isNull()).isEmpty():
            break
        open_ = state.filter(F.col("cut").isNull())
        o = open_.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
        shift = BITS - STEP * level
        buckets = (
            sized.join(o, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", shift + STEP) == F.col("p")))
            .groupBy("source", F.shiftright("hash", shift).alias("bucket"))
            .agg(F.sum("size").alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        )
        # At most 2^STEP buckets for each source.
        up_to = Window.partitionBy("source").orderBy("bucket")
        run = buckets.withColumn("upto", F.sum("n").over(up_to)).select(
            F.col("source").alias("s"), "bucket", "n", "lo", "hi", "upto"
        )
        crossing = (
            run.join(open_, F.col("source").eqNullSafe(F.col("s")))
            .filter(F.col("below") + F.col("upto") > F.col("budget"))
            .groupBy("s")
            .agg(F.min_by(F.struct("bucket", "n", "lo", "hi", "upto"), F.col("bucket")).alias("b"))
        )
        b = F.col("b")
        before = F.col("below") + b.upto - b.n
        nearer = before + b.n - F.col("budget") < F.col("budget") - before
        cut = F.when(b.isNull(), F.lit(1 << BITS)).when(b.lo == b.hi, b.lo + F.when(nearer, 1).otherwise(0))
        keep = ["source", "source_size", "target", "whole", "budget"]
        step = open_.join(crossing, F.col("source").eqNullSafe(F.col("s")), "left").select(
            *keep, before.alias("below"), b.bucket.alias("prefix"), cut.cast("long").alias("cut")
        )
        state = stage(state.filter(F.col("cut").isNotNull()).unionByName(step), f"mix_{level}")
    return state.select("source", "source_size", "target", "whole", "cut")


def copies(whole: F.Column, cut: F.Column, hash_: F.Column) -> F.Column:
    """How often a row is taken."""
    return whole + F.when(hash_ < cut, 1).otherwise(0)


def sized(docs: DataFrame, row_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Staged (row_id, source, size, hash), so that texts are counted once."""
    rows = docs.select(
        col(row_id).alias("row_id"),
        col(source).alias("source"),
        words(col(text)).alias("size"),
        document_hash(col(row_id)).alias("hash"),
    )
    return stage(rows, "mix_sizes")


def mix_report(docs: DataFrame, row_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row.

    Null text has size 0, null sources are one source and null ids one hash;
    repeated rows are taken or left together. An empty table gives no rows.
    """
    rows = sized(docs, row_id, text, source)
    cuts = thresholds(rows).withColumnRenamed("source", "s")
    return rows.join(cuts, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("row_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * copies(F.col("whole"), F.col("cut"), F.col("hash"))).alias("taken"),
    )


def mix(docs: DataFrame, row_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, 0 included."""
    s, whole, cut = (fresh(docs, n) for n in ("mix_source", "mix_whole", "mix_cut"))
    cuts = thresholds(sized(docs, row_id, text, source)).select(
        F.col("source").alias(s), F.col("whole").alias(whole), F.col("cut").alias(cut)
    )
    times = copies(F.col(whole), F.col(cut), document_hash(col(row_id))).cast("int")
    joined = docs.join(cuts, col(source).eqNullSafe(F.col(s))).withColumn(whole, times)
    return (
        joined.filter(F.col(whole) > 0)
        .withColumn(cut, F.explode(F.array_repeat(F.lit(1), F.col(whole))))
        .drop(s, whole, cut)
    )
