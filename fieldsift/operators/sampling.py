"""Stratified split, folds and few-shot picks; exact sizes, seeded, repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import EXAMPLES_PER_CATEGORY, N_FOLDS, SEED, TEST_SIZE
from ..session import scratch
from .ranking import (
    SORT_LIMIT,
    keys_at_ranks,
    rank_keys,
    seeded_value,
    slots_at_or_above,
    stratum_ranges,
)


def test_quotas(sizes: DataFrame, test_size: float = TEST_SIZE) -> DataFrame:
    """Test rows per stratum, (stratum, quota), from (stratum, n).

    ceil(test_size * total) rows are shared out in proportion to the strata by
    largest remainder; the stratum name breaks ties. One row per stratum.
    """
    wide = "decimal(38,0)"
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("n").over(everything).cast(wide)
    shares = (
        sizes.withColumn("total", total)
        .withColumn("drawn", F.ceil(F.col("total").cast("double") * test_size).cast(wide))
        .withColumn("product", (F.col("n").cast(wide) * F.col("drawn")).cast(wide))
        .withColumn("rest", F.col("product") % F.col("total"))
        .withColumn("whole", ((F.col("product") - F.col("rest")) / F.col("total")).cast("bigint"))
    )
    extra = F.col("drawn").cast("bigint") - F.sum("whole").over(everything)
    place = F.row_number().over(everything.orderBy(F.desc("rest"), "stratum"))
    return shares.select(
        "stratum",
        (F.col("whole") + F.when(place <= extra, 1).otherwise(0)).alias("quota"),
    )


test_quotas.__test__ = False  # not a test case, whatever its name


def stratified_split(
    df: DataFrame,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    stratum: str = "output",
    sort_limit: int = SORT_LIMIT,
) -> DataFrame:
    """Add ``split`` ('train' or 'test') with exact proportions per stratum.

    The test rows are the first ones per stratum in a seeded order. Only the key
    of the last test row is looked up, so the rows themselves are never moved.
    """
    if not 0.0 < test_size < 1.0:
        raise ValueError(f"test_size must be between 0 and 1, got {test_size}")
    value = seeded_value(seed, F.col("note_id"))
    with scratch(df.sparkSession):
        keys = rank_keys(df, stratum, value)
        ranges = stratum_ranges(keys)
        wanted = (
            test_quotas(ranges.select("stratum", "n"), test_size)
            .where("quota > 0")
            .select("stratum", F.lit(0).alias("slot"), F.col("quota").alias("rank"))
        )
        last = keys_at_ranks(keys, ranges, wanted, sort_limit).select(
            F.col("stratum").alias(stratum),
            F.struct("value", "note_id").alias("_last"),
        )
    key = F.struct(value.alias("value"), F.col("note_id"))
    return (
        df.join(F.broadcast(last), stratum, "left")
        .withColumn("split", F.when(key <= F.col("_last"), "test").otherwise("train"))
        .drop("_last")
    )


def complement(df: DataFrame, held_out: DataFrame) -> DataFrame:
    """Rows of ``df`` whose note is not in an externally given held-out set."""
    return df.join(held_out.select("note_id"), "note_id", "left_anti")


def stratified_folds(
    df: DataFrame,
    n_folds: int = N_FOLDS,
    seed: int = SEED,
    stratum: str = "output",
    sort_limit: int = SORT_LIMIT,
) -> DataFrame:
    """Add ``fold`` (0-based), shuffled by seed within each stratum.

    Fold sizes are those of dealing out all rows in turn, stratum after stratum
    in order of first appearance, so folds differ by at most one row in total as
    well as per stratum.
    """
    value = seeded_value(seed, F.col("note_id"))
    with scratch(df.sparkSession):
        cuts, empty = _fold_cuts(rank_keys(df, stratum, value), n_folds, stratum, sort_limit)
    return (
        slots_at_or_above(df, cuts, stratum, value)
        .join(F.broadcast(empty), stratum, "left")
        .withColumn("fold", (F.col("slot") + F.coalesce("_skipped", F.lit(0))).cast("int"))
        .drop("slot", "_skipped")
    )


def _fold_cuts(
    keys: DataFrame, n_folds: int, stratum: str, sort_limit: int
) -> tuple[DataFrame, DataFrame]:
    """Last keys of the folds, and the number of empty folds before the first one."""
    earlier = Window.orderBy("id_lo").rowsBetween(Window.unboundedPreceding, -1)
    # One row per stratum reaches this unpartitioned window.
    ranges = stratum_ranges(keys)
    sizes = ranges.withColumn(
        "start", F.coalesce(F.sum("n").over(earlier), F.lit(0))
    )

    def dealt(fold: Column) -> Column:
        # Positions p with p % n_folds == fold among [start, start + n).
        upto = F.floor((F.col("start") + F.col("n") - 1 - fold + n_folds) / n_folds)
        before = F.floor((F.col("start") - 1 - fold + n_folds) / n_folds)
        return upto - before

    in_stratum = Window.partitionBy("stratum").orderBy("slot")
    cuts = (
        sizes.select(
            "stratum", "start", "n",
            F.explode(F.array(*[F.lit(i) for i in range(n_folds - 1)])).alias("slot"),
        )
        .withColumn("rank", F.sum(dealt(F.col("slot"))).over(in_stratum))
        .where("rank > 0")
        .select("stratum", "slot", "rank")
    )
    # A first fold without rows has no cut key, so later folds shift up.
    empty = sizes.select(
        F.col("stratum").alias(stratum),
        F.aggregate(
            F.array(*[F.lit(i) for i in range(n_folds - 1)]),
            F.struct(F.lit(0).alias("skipped"), F.lit(True).alias("leading")),
            lambda acc, i: F.struct(
                (
                    acc["skipped"]
                    + F.when(acc["leading"] & (dealt(i) == 0), 1).otherwise(0)
                ).alias("skipped"),
                (acc["leading"] & (dealt(i) == 0)).alias("leading"),
            ),
        )["skipped"].alias("_skipped"),
    )
    return keys_at_ranks(keys, ranges, cuts, sort_limit), empty


def _length_keys(
    df: DataFrame, stratum: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keys by note length, their ranges and the rows per stratum."""
    keys = rank_keys(df, stratum, F.char_length("input"))
    ranges = stratum_ranges(keys)
    return keys, ranges, ranges.select("stratum", "n")


def _every_row(sizes: DataFrame, per_category: int) -> DataFrame:
    """All ranks of the strata that hold no more than the wanted examples."""
    return sizes.where(F.col("n") <= per_category).select(
        "stratum",
        F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("slot"),
    ).select("stratum", "slot", F.col("slot").cast("bigint").alias("rank"))


def _examples(
    df: DataFrame, picked: DataFrame, sizes: DataFrame, stratum: str, per_category: int
) -> DataFrame:
    """Texts of the picked notes: (stratum, position, note_id, input).

    A stratum taken whole keeps its note order.
    """
    in_stratum = Window.partitionBy("stratum").orderBy(
        F.when(F.col("n") > per_category, F.col("slot")), "note_id"
    )
    placed = picked.join(F.broadcast(sizes), "stratum").select(
        F.col("stratum").alias(stratum),
        "note_id",
        F.row_number().over(in_stratum).alias("position"),
    )
    # At most per_category rows per stratum are broadcast.
    return df.join(F.broadcast(placed), [stratum, "note_id"]).select(
        stratum, "position", "note_id", "input"
    )


def fewshot_by_bucket(
    df: DataFrame,
    per_category: int = EXAMPLES_PER_CATEGORY,
    seed: int = SEED,
    stratum: str = "output",
    sort_limit: int = SORT_LIMIT,
) -> DataFrame:
    """One seeded pick from each of ``per_category`` equal runs of note length.

    Notes left over after the last full run are not eligible; a stratum with no
    more than ``per_category`` notes is taken whole.
    """
    keys, ranges, sizes = _length_keys(df, stratum)
    run = F.floor(F.col("n") / per_category)
    ends = sizes.where(F.col("n") > per_category).select(
        "stratum",
        run.alias("run"),
        F.explode(F.sequence(F.lit(1), F.lit(per_category))).alias("slot"),
    ).select("stratum", "slot", (F.col("slot") * F.col("run")).alias("rank"))
    cuts = keys_at_ranks(keys, ranges, ends, sort_limit)
    runs = slots_at_or_above(keys, cuts, "stratum", F.col("value"))
    picked = (
        runs.join(F.broadcast(sizes.where(F.col("n") > per_category)), "stratum")
        .where(F.col("slot") < per_category)
        .groupBy("stratum", "slot")
        .agg(
            F.min(
                F.struct(
                    seeded_value(seed, F.col("note_id")).alias("value"), "note_id"
                )
            )["note_id"].alias("note_id")
        )
    )
    whole = keys.join(
        F.broadcast(sizes.where(F.col("n") <= per_category)), "stratum"
    ).select("stratum", F.lit(0).alias("slot"), "note_id")
    return _examples(df, picked.unionByName(whole), sizes, stratum, per_category)


def fewshot_by_stride(
    df: DataFrame,
    per_category: int = EXAMPLES_PER_CATEGORY,
    stratum: str = "output",
    sort_limit: int = SORT_LIMIT,
) -> DataFrame:
    """Notes at evenly spaced places of the length order.

    A stratum with no more than ``per_category`` notes is taken whole.
    """
    with scratch(df.sparkSession):
        keys, ranges, sizes = _length_keys(df, stratum)
        step = F.floor(F.col("n") / per_category)
        spaced = sizes.where(F.col("n") > per_category).select(
            "stratum",
            step.alias("step"),
            F.explode(F.sequence(F.lit(0), F.lit(per_category - 1))).alias("slot"),
        ).select("stratum", "slot", (F.col("slot") * F.col("step") + 1).alias("rank"))
        wanted = spaced.unionByName(_every_row(sizes, per_category))
        picked = keys_at_ranks(keys, ranges, wanted, sort_limit).select(
            "stratum", "slot", "note_id"
        )
    return _examples(df, picked, sizes, stratum, per_category)
