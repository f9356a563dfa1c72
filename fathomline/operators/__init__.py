"""Relational building blocks shared by the plans."""

from fathomline.operators.lookup import lookup_join
from fathomline.operators.naming import clean_names, lower_names
from fathomline.operators.ranking import dense_numbers, exact_quantiles, numbered, running_sum, top_with_ties
from fathomline.operators.reshape import (
    complete,
    grid,
    pivot_wider,
    unpivot_longer,
    year_span,
)

__all__ = [
    "clean_names",
    "complete",
    "dense_numbers",
    "exact_quantiles",
    "grid",
    "lookup_join",
    "lower_names",
    "numbered",
    "pivot_wider",
    "running_sum",
    "top_with_ties",
    "unpivot_longer",
    "year_span",
]
