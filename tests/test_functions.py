from pyspark.sql import functions as F

from fathomline.functions import (
    big_mark,
    drop_trailing_zeros,
    fixed,
    na_skipping_sum,
    ratio,
    replace_first,
    replace_first_literal,
    strict_mean,
    strict_sum,
    strict_sum_where,
)
from fathomline.functions.distributions import t_two_sided
from fathomline.plans.survey import blank_cell, na_cell, significant


def one(df, column):
    return df.select(column.alias("x")).first()["x"]


def test_sums_and_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "k STRING, v DOUBLE")
    got = {r["k"]: r for r in df.groupBy("k").agg(
        strict_sum("v").alias("s"), strict_mean("v").alias("m"), na_skipping_sum("v").alias("n"),
        strict_sum_where(F.col("v") > 2, "v").alias("w"), strict_sum_where(F.col("v") > 9, "v", 0.0).alias("e"),
    ).collect()}
    assert got["a"]["s"] is None and got["a"]["m"] is None and got["a"]["n"] == 1.0
    assert got["b"]["s"] == 5.0 and got["b"]["m"] == 2.5
    assert got["b"]["w"] == 3.0 and got["b"]["e"] == 0.0 and got["a"]["w"] is None


def test_strict_sum_where_tells_absent_from_missing(spark):
    df = spark.createDataFrame([("x", None), ("y", 1.0)], "k STRING, v DOUBLE")
    row = df.agg(
        strict_sum_where(F.col("k") == "x", "v", 0.0).alias("missing"),
        strict_sum_where(F.col("k") == "z", "v", 0.0).alias("absent"),
        strict_sum_where(F.col("k") == "z", "v").alias("absent_null"),
    ).first()
    assert row["missing"] is None and row["absent"] == 0.0 and row["absent_null"] is None


def test_ratio_by_zero_is_missing(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a DOUBLE, b DOUBLE")
    assert one(df, ratio("a", "b")) is None


def test_number_text(spark):
    df = spark.createDataFrame([(0.25, 1234567.5, 100.0, None)], "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")
    assert one(df, fixed(F.col("a"), 1)) == "0.2"
    assert one(df, fixed(F.col("b"), 1)) == "1234567.5"
    assert one(df, big_mark(F.col("b"))) == "1,234,568"
    assert one(df, drop_trailing_zeros(fixed(F.col("c"), 1))) == "100"
    assert one(df, drop_trailing_zeros(F.lit("100"))) == "100"
    assert one(df, drop_trailing_zeros(F.lit("0.50"))) == "0.5"
    assert one(df, fixed(F.col("d"), 1)) == "NA"


def test_only_the_first_match_is_replaced(spark):
    df = spark.createDataFrame([("a.b.b", None)], "s STRING, n STRING")
    assert one(df, replace_first_literal(F.col("s"), ".b")) == "a.b"
    assert one(df, replace_first_literal(F.col("s"), "x")) == "a.b.b"
    assert one(df, replace_first_literal(F.col("n"), "x")) is None
    assert one(df, replace_first(F.col("s"), "[.]b", "-")) == "a-.b"


def test_significant_digits(spark):
    values = [114.7, 0.4, 0.0, 12345.6, 9.96]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    got = [r[0] for r in df.select(significant(F.col("v"), 1)).collect()]
    assert got == ["115", "0.4", "0", "12,346", "10"]


def test_cells(spark):
    data = [(11340.2, 0.2271), (0.0, None), (None, None), (18.0, 1.0), (5.0, 0.001)]
    df = spark.createDataFrame(data, "biomass DOUBLE, cv DOUBLE")
    got = df.select(blank_cell().alias("b"), na_cell().alias("n")).collect()
    assert [r["b"] for r in got] == ["11,340 (0.23)", "0", "", "18 (1.00)", "5"]
    assert [r["n"] for r in got] == ["11,340 (0.23)", "0 (NA)", None, "18 (1)", "5 (0)"]


def test_t_probabilities(spark):
    # (t, degrees of freedom, two-sided probability)
    known = [(1.0, 1, 0.5), (2.0, 2, 0.183503), (2.0, 3, 0.139326), (-2.0, 5, 0.101939), (2.228139, 10, 0.05),
             (2.093024, 19, 0.05), (0.0, 7, 1.0)]
    df = spark.createDataFrame([(t, n) for t, n, _ in known], "t DOUBLE, n BIGINT")
    got = [r[0] for r in df.select(t_two_sided(F.col("t"), F.col("n"))).collect()]
    assert [round(p, 6) for p in got] == [p for _, _, p in known]
