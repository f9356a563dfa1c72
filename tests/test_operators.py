import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import (
    clean_names,
    complete,
    exact_quantiles,
    grid,
    lookup_join,
    pivot_wider,
    running_sum,
    top_with_ties,
    unpivot_longer,
    year_span,
)


def test_complete_is_the_product_of_observed_values(spark, rows):
    data = [("a", 1, "x", 2.0), ("b", 2, "x", None), ("a", 2, "y", 3.0)]
    df = spark.createDataFrame(data, "k STRING, year INT, s STRING, v DOUBLE")
    got = {(r["k"], r["year"], r["s"]): r["v"] for r in complete(df, ["k", "year", "s"], {"v": 0.0}).collect()}
    assert set(got) == set(itertools.product("ab", (1, 2), "xy"))
    assert got["a", 1, "x"] == 2.0 and got["b", 2, "x"] == 0.0 and got["b", 1, "y"] == 0.0
    empty = {(r["k"], r["year"], r["s"]): r["v"] for r in complete(df, ["k", "year", "s"]).collect()}
    assert empty["b", 1, "y"] is None


def test_complete_counts_missing_as_a_value_and_keeps_nested_pairs(spark):
    df = spark.createDataFrame(
        [("a", "p", 1, 1.0), (None, "q", 2, 2.0)], "k STRING, j STRING, year INT, v DOUBLE"
    )
    got = {(r["k"], r["j"], r["year"]): r["v"] for r in complete(df, ["year", ["k", "j"]], {"v": 0.0}).collect()}
    assert got == {("a", "p", 1): 1.0, ("a", "p", 2): 0.0, (None, "q", 1): 0.0, (None, "q", 2): 2.0}


def test_complete_with_known_levels(spark):
    df = spark.createDataFrame([(1, "SST", 1.0)], "year INT, c STRING, v DOUBLE")
    got = complete(df, ["year", "c"], {"v": 0.0}, {"c": ["SST", "non-SST"]}).collect()
    assert {(r["c"], r["v"]) for r in got} == {("SST", 1.0), ("non-SST", 0.0)}


def test_pivot_and_back(spark, rows):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "a", 3.0)], "id INT, n STRING, v DOUBLE")
    wide = pivot_wider(df, ["id"], "n", "v", ["a", "b"], fill=0.0)
    assert rows(wide) == [(1, 1.0, None), (2, 3.0, 0.0)]
    assert rows(unpivot_longer(wide, ["id"], ["a", "b"])) == [
        (1, "a", 1.0), (1, "b", None), (2, "a", 3.0), (2, "b", 0.0),
    ]


def test_grid_and_year_span(spark, rows):
    assert rows(grid(spark, year=range(2000, 2002), s=["a", "b"])) == [
        (2000, "a"), (2000, "b"), (2001, "a"), (2001, "b"),
    ]
    df = spark.createDataFrame([(1990,), (1993,)], "year INT")
    assert [r[0] for r in rows(year_span(df))] == [1990, 1991, 1992, 1993]
    assert [r[0] for r in rows(year_span(df, last=1995))][-1] == 1995


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Collection Year` INT, `a.b` INT, `A  c` INT")
    assert clean_names(df).columns == ["collection_year", "a_b", "a_c"]


def test_top_keeps_ties(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([9, 7, 7, 7, 3])], "i INT, v DOUBLE")
    assert {r["i"] for r in top_with_ties(df, "v", 2).collect()} == {0, 1, 2, 3}
    assert top_with_ties(df, "v", 10).count() == 5


@pytest.mark.parametrize("kind", ["spread", "hot", "few", "tails"])
def test_exact_quantiles(spark, kind):
    rng = random.Random(7)
    values = {
        "spread": [rng.gauss(0, 100) for _ in range(5000)],
        # a third of all rows are one value
        "hot": [5.0 if i % 3 == 0 else rng.random() * 10 for i in range(3000)],
        "few": [3.0, 1.0, 2.0],
        "tails": [10 ** rng.uniform(-8, 8) for _ in range(2000)],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, "v", probs, accuracy=200).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([], "v DOUBLE"), "v", [0.5]).count() == 0


def test_lookup_join_leaves_the_strategy_to_the_planner(spark, rows):
    fact = spark.range(100).select((F.col("id") % 5).alias("k"), "id")
    lookup = spark.range(4).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    small = lookup_join(fact, lookup, ["k"])
    assert "BroadcastHashJoin" in small._jdf.queryExecution().sparkPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        large = lookup_join(fact, lookup, ["k"])
        assert rows(small) == rows(large)
        assert "BroadcastHashJoin" not in large._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_complete_with_many_values_in_a_later_key(spark):
    cells = spark.range(100_000).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("x"))
    full = complete(cells, ["a", "b"], {"x": 0.0})
    assert tuple(full.agg(F.count("*"), F.sum("x")).first()) == (300_000, 100_000.0)


def test_running_sum_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("o"), F.lit(1).alias("w"))
    got = running_sum(df, "g", "o", "w", "upto").collect()
    assert all(r["upto"] == r["o"] // 2 + 1 for r in got)


def test_wide_refuses_repeated_cells(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "i INT, k STRING, x DOUBLE")
    with pytest.raises(Exception, match="more than one row"):
        pivot_wider(df, ["i"], "k", "x", ["a"]).collect()


def test_numbers_follow_the_sort_at_any_partitioning(spark, rows):
    from fathomline.operators import numbered

    data = spark.range(5000).selectExpr("id * 7919 % 5000 AS x", "id % 3 AS y")
    for parts in (1, 7, 40):
        got = numbered(data.repartition(parts).orderBy("x"), "n", start=2)
        assert [tuple(r) for r in got.orderBy("n").select("x", "n").collect()] == [(k, k + 2) for k in range(5000)]
    assert numbered(data.filter("x < 0").orderBy("x")).count() == 0
    assert numbered(data.limit(1)).columns == ["x", "y", "row_no"]


def test_complete_with_a_closed_domain(spark, rows):
    from fathomline.operators import complete

    cells = spark.createDataFrame([(2000, "b", 1.0), (2001, "a", 2.0)], "year INT, part STRING, catch DOUBLE")
    got = rows(complete(cells, ["year", "part"], {"catch": 0.0}, domains={"part": ["a", "b", "c"]}))
    assert got == [(2000, "a", 0.0), (2000, "b", 1.0), (2000, "c", 0.0), (2001, "a", 2.0), (2001, "b", 0.0), (2001, "c", 0.0)]
    assert rows(complete(cells.limit(0), ["year", "part"], domains={"part": ["a"]})) == []
