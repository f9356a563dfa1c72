"""Number-to-text and first-match replacement as the report tables print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "NA"


def or_na(text: Column) -> Column:
    """Missing text prints as NA."""
    return F.coalesce(text, F.lit(MISSING))


def fixed(value: Column, digits: int) -> Column:
    """Fixed decimals without grouping, ties rounded on the binary value."""
    return or_na(F.translate(F.format_number(value, digits), ",", ""))


def drop_trailing_zeros(text: Column) -> Column:
    """12.0 prints as 12 and 0.50 as 0.5; integers are left alone."""
    shorter = F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1")
    return F.regexp_replace(shorter, r"\.$", "")


def big_mark(value: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(value, 0)


def replace_first(value: Column, pattern: str, replacement: str = "") -> Column:
    """Replace only the first match of a regular expression."""
    return F.regexp_replace(value, f"(?s)^(.*?)(?:{pattern})", "$1" + replacement)


def replace_first_literal(value: Column, text: str, replacement: str = "") -> Column:
    """Replace only the first occurrence of a literal text."""
    at = F.instr(value, text)
    return F.when(at > 0, F.overlay(value, F.lit(replacement), at, F.lit(len(text)))).otherwise(value)
