"""Exact rows at given ranks within strata, without sorting a stratum in one task.

A stratum (a category) may hold a third of all rows, and so may one value (a
note length) inside it. ``row_number`` over a stratum would sort all of it in a
single task. Here only histograms are shuffled: each pass counts rows per slice
of the key range, combined on the map side, and keeps the slices that hold a
wanted rank, until those are small enough to sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind
from ..session import stage

# Rows of one slice that one task may sort; they are three longs wide.
SORT_LIMIT = 4_000_000
SLICES = 4096
# Strata whose ranges and cuts are held as literals.
MAX_STRATA = 50_000

BOUNDS = ["v_lo", "v_hi", "id_lo", "id_hi"]


def seeded_value(seed: int, note_id: Column) -> Column:
    """A 60-bit pseudo-random value of a note, the same on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), note_id.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def rank_keys(df: DataFrame, stratum: str, value: Column) -> DataFrame:
    """Staged narrow table (stratum, value, note_id); rows rank by value, then id.

    A NULL stratum is refused: it would get a quota that none of its rows meets.
    """
    refused = F.raise_error(F.lit(f"{stratum} is NULL; drop or name such rows")).cast("string")
    named = F.when(F.col(stratum).isNull(), refused.cast(df.schema[stratum].dataType)).otherwise(F.col(stratum))
    keys = df.select(
        named.alias("stratum"), value.cast("bigint").alias("value"), "note_id"
    )
    return stage(keys, "rank-keys")


def hold(table: DataFrame) -> DataFrame:
    """Compute a table now and keep it as a literal.

    Only for tables of one row per stratum or per wanted rank: later uses then
    do not go through the keys again.
    """
    return table.sparkSession.createDataFrame(table.collect(), table.schema)


def _ranges(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.min("value").alias("v_lo"),
        F.max("value").alias("v_hi"),
        F.min("note_id").alias("id_lo"),
        F.max("note_id").alias("id_hi"),
    )


def stratum_ranges(keys: DataFrame) -> DataFrame:
    """Row count and key range per stratum: (stratum, n, v_lo, v_hi, id_lo, id_hi)."""
    ranges = _ranges(keys, "stratum")
    if ranges.limit(MAX_STRATA + 1).count() > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata: they are held on the driver and broadcast")
    return hold(ranges)


def _largest_range(located: DataFrame) -> int:
    """Rows of the largest range that can still be cut."""
    can_be_cut = (F.col("v_lo") < F.col("v_hi")) | (F.col("id_lo") < F.col("id_hi"))
    return located.where(can_be_cut).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def _rows_in(keys: DataFrame, located: DataFrame) -> DataFrame:
    """Rows inside the located ranges, with the range they fall in.

    ``located`` has one row per wanted rank, so the broadcast is bounded.
    """
    ranges = located.select("stratum", *BOUNDS).distinct()
    return keys.join(F.broadcast(ranges), "stratum").where(
        F.col("value").between(F.col("v_lo"), F.col("v_hi"))
        & F.col("note_id").between(F.col("id_lo"), F.col("id_hi"))
    )


def _refine(keys: DataFrame, located: DataFrame) -> DataFrame:
    """Cut every located range into slices and locate the ranks in those."""

    def slice_of(x: str, lo: str, hi: str) -> Column:
        # Exact: ids may span more than a BIGINT holds.
        wide = lambda c: F.col(c).cast("decimal(20,0)")
        share = (wide(x) - wide(lo)).cast("double") / ((wide(hi) - wide(lo)).cast("double") + 1.0)
        return F.least(F.floor(share * SLICES), F.lit(SLICES - 1))

    # A range of one value is cut by note id.
    sliced = _rows_in(keys, located).withColumn(
        "slice",
        F.when(F.col("v_lo") < F.col("v_hi"), slice_of("value", "v_lo", "v_hi"))
        .otherwise(slice_of("note_id", "id_lo", "id_hi")),
    )
    outer = [F.col(b).alias(f"outer_{b}") for b in BOUNDS]
    counts = _ranges(
        sliced.select("stratum", "value", "note_id", "slice", *outer),
        "stratum", *[f"outer_{b}" for b in BOUNDS], "slice",
    )
    in_range = Window.partitionBy("stratum", *[f"outer_{b}" for b in BOUNDS])
    before = F.sum("n").over(
        in_range.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    wanted = located.select("stratum", "slot", "rank", *outer)
    return (
        counts.join(F.broadcast(wanted), ["stratum", *[f"outer_{b}" for b in BOUNDS]])
        .where("rank > before AND rank <= before + n")
        .select(
            "stratum", "slot", (F.col("rank") - F.col("before")).alias("rank"),
            "n", *BOUNDS,
        )
    )


def keys_at_ranks(
    keys: DataFrame,
    ranges: DataFrame,
    wanted: DataFrame,
    sort_limit: int = SORT_LIMIT,
) -> DataFrame:
    """The keys at the wanted ranks: (stratum, slot, value, note_id).

    ``ranges`` are the :func:`stratum_ranges` of ``keys``, and ``keys`` comes from :func:`rank_keys`; note ids must be unique. ``wanted``
    has (stratum, slot, rank), ranks from 1, a handful of slots per stratum;
    ranks beyond a stratum's size give no row.
    """
    located = hold(
        wanted.join(ranges.select("stratum", "n", *BOUNDS), "stratum")
        .where("rank <= n")
        .select("stratum", "slot", "rank", "n", *BOUNDS)
    )
    while _largest_range(located) > sort_limit:
        located = hold(_refine(keys, located))
    in_range = Window.partitionBy("stratum", *BOUNDS).orderBy("value", "note_id")
    ranked = _rows_in(keys, located).withColumn("rank", F.row_number().over(in_range))
    return hold(
        ranked.join(
            F.broadcast(located.select("stratum", *BOUNDS, "slot", "rank")),
            ["stratum", *BOUNDS, "rank"],
        ).select("stratum", "slot", "value", "note_id")
    )


def slots_at_or_above(
    df: DataFrame, cuts: DataFrame, stratum: str, value: Column
) -> DataFrame:
    """Add ``slot``: how many of the stratum's cut keys lie below the row's key.

    The cut keys are a few rows per stratum and are broadcast; the rows do not
    move. Rows of a stratum without cuts get 0.
    """
    per_stratum = cuts.groupBy(F.col("stratum").alias(stratum)).agg(
        F.collect_list(F.struct("value", "note_id")).alias("_cuts")
    )
    key = F.struct(value.cast("bigint").alias("value"), F.col("note_id"))
    # Bound first, so the key is not computed again for every cut.
    below = bind(key, lambda k: F.size(F.filter("_cuts", lambda cut: cut < k)))
    return (
        df.join(F.broadcast(per_stratum), stratum, "left")
        .withColumn("slot", F.coalesce(below, F.lit(0)))
        .drop("_cuts")
    )
