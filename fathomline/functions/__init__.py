"""Column functions with the missing-value and text rules the reports rely on."""

from fathomline.functions.missing import (
    na_skipping_sum,
    ratio,
    strict_mean,
    strict_sum,
    strict_sum_over,
    strict_sum_where,
)
from fathomline.functions.text import (
    big_mark,
    drop_trailing_zeros,
    fixed,
    or_na,
    replace_first,
    replace_first_literal,
)

__all__ = [
    "big_mark",
    "drop_trailing_zeros",
    "fixed",
    "na_skipping_sum",
    "or_na",
    "ratio",
    "replace_first",
    "replace_first_literal",
    "strict_mean",
    "strict_sum",
    "strict_sum_over",
    "strict_sum_where",
]
