"""Tail probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def t_two_sided(t: Column, df: Column) -> Column:
    """Probability that |T| exceeds |t| for whole degrees of freedom.

    The finite sine and cosine series of the t distribution: exact, one term for
    every second degree of freedom.
    """
    angle = F.atan(F.abs(t) / F.sqrt(df))
    cos = F.cos(angle)
    odd = df % 2 == 1
    first = F.when(odd, cos).otherwise(F.lit(1.0))
    start = F.struct(first.alias("term"), first.alias("sum"))
    # steps 1..n multiply the term by 2k/(2k+1) cos^2 (odd) or (2k-1)/(2k) cos^2 (even)
    steps = F.floor((df - F.when(odd, 3).otherwise(2)) / 2)

    def add(state, k):
        factor = F.when(odd, 2.0 * k / (2.0 * k + 1.0)).otherwise((2.0 * k - 1.0) / (2.0 * k))
        term = state["term"] * factor * cos * cos
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    terms = F.when(steps >= 1, F.sequence(F.lit(1).cast("bigint"), steps)).otherwise(F.array().cast("array<bigint>"))
    series = F.aggregate(terms, start, add, lambda s: s["sum"])
    inside_odd = 2.0 / math.pi * (angle + F.when(df > 1, F.sin(angle) * series).otherwise(0.0))
    return 1.0 - F.when(odd, inside_odd).otherwise(F.sin(angle) * series)
