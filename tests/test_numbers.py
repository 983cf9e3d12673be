import random

from pyspark.sql import functions as F

from fieldsift.functions import numbers as N


def test_equals_printf(spark):
    rng = random.Random(3)
    values = [0.0, 0.125, 0.375, 1.005, 2.675, 0.5, 1.5, 2.5, 1e-7, 12345.678, 0.655, -0.125]
    values += [rng.random() * 10 for _ in range(500)]
    values += [rng.randrange(20000) / 1000 for _ in range(1000)]
    values += [rng.randrange(2000) / 64 for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v",
        *[N.fixed_point(F.col("v"), d).alias(f"d{d}") for d in range(5)],
        N.percent(F.col("v"), 0).alias("p0"),
        N.percent(F.col("v"), 1).alias("p1"),
        N.round_half_even(F.col("v"), 3).alias("r"),
    )
    for row in rows.collect():
        for digits in range(5):
            assert row[f"d{digits}"] == f"{row.v:.{digits}f}"
        assert row.p0 == f"{row.v:.0%}"
        assert row.p1 == f"{row.v:.1%}"
        assert row.r == round(row.v, 3)


def test_large_and_special(spark):
    values = [2.0**53 + 2, 1e17, 2.0**44 + 0.125, 2.0**50 - 0.5, 2.0**63, 2.0**80 + 2.0**40, -1e30, 9.995, 0.995]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", *[N.fixed_point(F.col("v"), d).alias(f"d{d}") for d in range(5)]
    )
    for row in rows.collect():
        for digits in range(5):
            assert row[f"d{digits}"] == f"{row.v:.{digits}f}"
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (1e300,)], "v double")
    found = [r[0] for r in odd.select(N.fixed_point(F.col("v"), 2)).collect()]
    assert found[:3] == ["nan", "inf", "-inf"] and float(found[3]) == 1e300


def test_null(spark):
    row = spark.range(1).select(N.fixed_point(F.lit(None).cast("double"), 2).alias("x")).first()
    assert row.x is None
