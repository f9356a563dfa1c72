"""Column-name clean-up."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.lower() for name in df.columns])


def clean_names(df: DataFrame) -> DataFrame:
    """Lower case, with each run of spaces and each dot turned into one underscore."""
    return df.toDF(*[re.sub(r"\s+|\.", "_", name).lower() for name in df.columns])
