"""Joins of large facts to derived lookup tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from fathomline.session import settled


def lookup_join(fact: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a fact to a lookup computed from other facts.

    The planner cannot know how small an aggregate turns out and would shuffle the
    fact to meet it. So the lookup is written once; its files have a size in bytes, and
    the planner's own threshold decides between broadcast and shuffle.
    """
    return fact.join(settled(lookup), list(on), how)
