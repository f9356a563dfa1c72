"""Top rows with ties and exact quantiles without gathering a group in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.session import settled

def top_with_ties(df: DataFrame, measure: str, n: int) -> DataFrame:
    """Rows whose measure is at least the n-th largest one; ties are exact.

    The n-th largest value comes from per-partition top-n lists, so no task sorts
    the whole table as a rank over an unpartitioned window would. ``df`` is read twice
    and must give the same digits each time: settle it first where the measure is a sum.
    """
    bar = (
        df.select(measure)
        .orderBy(F.col(measure).desc_nulls_last())
        .limit(n)
        .agg(F.min(measure).alias("bar"))
        .scalar()
    )
    return df.filter(F.col(measure) >= bar)


def running_sum(df: DataFrame, group: str, order: str, weight: str, name: str) -> DataFrame:
    """``df`` with the sum of ``weight`` up to and with each row, within ``group`` by ``order``.

    The rows are dealt by ranges and sorted; one row per range and group gives the ranges their
    starts. No task holds more than a range, however long a group is.
    """
    ranged = df.repartitionByRange(group, order).sortWithinPartitions(group, order)
    kept = settled(ranged.withColumn("_range", F.spark_partition_id()))
    sums = kept.groupBy(group, "_range").agg(F.sum(weight).alias("_held"))
    before = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(group, "_range", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy("_range", group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = kept.withColumn(name, F.sum(weight).over(within)).join(starts, [group, "_range"])
    return summed.withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_start")


def numbered(df: DataFrame, name: str = "row_no", start: int = 0) -> DataFrame:
    """``df`` with the number of each row in the order it comes in, from ``start`` on without gaps.

    ``df`` is sorted, so its partitions follow each other. The rows are written once with their place
    in their partition; counts per partition, summed up, give each partition its start. No task holds more
    than a partition. Rows that the sort leaves tied may swap their numbers from run to run.
    """
    placed = settled(df.withColumn("_place", F.monotonically_increasing_id()))
    return dense_numbers(placed, "_place", name, start=start)


def dense_numbers(df: DataFrame, place: str, name: str, groups: Sequence[str] = (), start: int = 0) -> DataFrame:
    """``df`` with gapless numbers within ``groups`` in place of a column of increasing ids.

    An id has the partition above its low 33 bits and the place in the partition in them. ``df`` is read twice: settle it first.
    """
    part = F.shiftright(place, 33)
    counts = df.groupBy(*groups, part.alias("_part")).agg(F.count(F.lit(1)).alias("_held"))
    before = W.partitionBy(*groups, F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*groups, "_part", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_start"))
    number = F.col("_start") + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + start
    joined = df.withColumn("_part", part).join(starts, [*groups, "_part"])
    return joined.withColumn(name, number.cast("long")).drop("_part", "_start", *([place] if place != name else []))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], accuracy: int = 20_000) -> DataFrame:
    """Linearly interpolated quantiles as rows (prob, quantile), exact at any size.

    A mergeable sketch gives a narrow bracket around each quantile, one aggregation
    counts what lies below it, and only the values inside the brackets are put in
    order, by ranges. A bracket that turns out not to hold its rank is widened, so the
    sketch decides the cost and never the result. Equal values become one row before
    they are ordered. The values are settled first, as every pass must see the same ones.
    """
    spark = df.sparkSession
    rows = settled(df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull()))
    v = F.col("v")
    probs = sorted({float(p) for p in probs})
    slack = 2.0 / accuracy
    while True:
        sides = [F.lit(min(max(p + side, 0.0), 1.0)) for p in probs for side in (-slack, slack)]
        head = rows.agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx("v", F.array(*sides), F.lit(accuracy)).alias("edges"),
        ).first()
        total = head["n"]
        if total == 0:
            return spark.createDataFrame([], "prob DOUBLE, quantile DOUBLE")
        low, high = head["edges"][0::2], head["edges"][1::2]
        counts = rows.agg(
            *[F.count(F.when(v < F.lit(a), 1)) for a in low], *[F.count(F.when(v <= F.lit(b), 1)) for b in high]
        ).first()
        below, upto = counts[: len(probs)], counts[len(probs) :]
        at = [(total - 1) * p for p in probs]
        first, last = [math.floor(x) for x in at], [math.ceil(x) for x in at]
        if all(b <= f and c < u for b, f, c, u in zip(below, first, last, upto)):
            break
        slack *= 8

    brackets = [v.between(F.lit(a), F.lit(b)) for a, b in zip(low, high)]
    hits = [F.when(inside, F.struct(F.lit(i).alias("i"))) for i, inside in enumerate(brackets)]
    inside = rows.filter(reduce(or_, brackets)).select("v", F.inline(F.array_compact(F.array(*hits))))
    merged = inside.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))

    def of(numbers):
        return F.array(*[F.lit(x) for x in numbers])[F.col("i")]

    placed = running_sum(merged, "i", "v", "n", "upto").withColumn("upto", F.col("upto") + of(below))

    def has(ranks):
        return (of(ranks) < F.col("upto")) & (of(ranks) >= F.col("upto") - F.col("n"))

    share = [x - f for x, f in zip(at, first)]
    part = F.when(has(first), v * (1 - of(share))).otherwise(0.0) + F.when(has(last), v * of(share)).otherwise(0.0)
    return placed.groupBy(of(probs).alias("prob")).agg(F.sum(part).alias("quantile"))
