"""Aggregates and arithmetic in which a missing value spreads unless told otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strict_sum(value: Column | str) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    value = _column(value)
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def strict_mean(value: Column | str) -> Column:
    """Mean that is NULL as soon as one input is NULL."""
    value = _column(value)
    return F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))


def na_skipping_sum(value: Column | str) -> Column:
    """Sum over the non-missing inputs, 0 when there are none."""
    return F.coalesce(F.sum(_column(value)), F.lit(0.0))


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient that is NULL, never an error, when the denominator is 0."""
    return F.try_divide(_column(numerator), _column(denominator))


def strict_sum_where(condition: Column, value: Column | str, empty: float | None = None) -> Column:
    """Sum over the rows meeting a condition, NULL if one of them is missing.

    ``empty`` is the result where no row meets it: several of these in one
    aggregation make a wide table of sums without a second pass.
    """
    value = _column(value)
    missing = F.count(F.when(condition & value.isNull(), 1))
    total = F.sum(F.when(condition, value))
    return F.when(missing == 0, total if empty is None else F.coalesce(total, F.lit(empty)))


def strict_sum_over(value: Column | str, window) -> Column:
    """``strict_sum`` over a whole window partition."""
    value = _column(value)
    complete = F.count(value).over(window) == F.count(F.lit(1)).over(window)
    return F.when(complete, F.sum(value).over(window))
