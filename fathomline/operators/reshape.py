"""Long to wide, wide to long, and filling a grid of key values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from fathomline.session import settled


def pivot_wider(
    df: DataFrame,
    ids: Sequence[str],
    names: str,
    values: str,
    domain: Sequence | Mapping,
    fill=None,
) -> DataFrame:
    """One column per value of ``names``; ``df`` holds one row per id and name, else the query fails.

    ``domain`` lists the values (or maps value to column name), so that the schema
    does not hang on the data and all columns come from a single aggregation.
    ``fill`` is used where a row is absent, not where its value is missing.
    """
    labels = domain if isinstance(domain, Mapping) else {v: str(v) for v in domain}
    cells = []
    for value, label in labels.items():
        hit = F.col(names) == F.lit(value)
        cell = F.max(F.when(hit, F.col(values)))
        again = F.raise_error(F.lit(f"more than one row for an id and {names} {value!r}"))
        cell = F.when(F.count(F.when(hit, 1)) > 1, again.cast(dict(df.dtypes)[values])).otherwise(cell)
        if fill is not None:
            cell = F.when(F.count(F.when(hit, 1)) == 0, F.lit(fill)).otherwise(cell)
        cells.append(cell.alias(label))
    return df.groupBy(*ids).agg(*cells)


def unpivot_longer(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], names_to: str = "name", values_to: str = "value"
) -> DataFrame:
    return df.unpivot(list(ids), list(columns), names_to, values_to)


def grid(spark: SparkSession, **domains: Sequence | range) -> DataFrame:
    """All combinations of literal domains, for instance years by sources."""
    df = spark.range(1).select()
    for name, values in domains.items():
        if isinstance(values, range):
            items = F.sequence(F.lit(values.start), F.lit(values.stop - 1))
        else:
            items = F.array(*[F.lit(v) for v in values])
        df = df.select("*", F.explode(items).alias(name))
    return df


def year_span(df: DataFrame, year: str = "year", last: int | None = None) -> DataFrame:
    """Every year from the first observed one to ``last`` (or the last observed)."""
    end = F.max(year) if last is None else F.lit(last)
    ends = df.agg(F.min(year).alias("first"), end.alias("last"))
    return ends.select(F.explode(F.sequence("first", "last")).alias(year))


def complete(
    cells: DataFrame,
    keys: Sequence[str | Sequence[str]],
    fill: Mapping[str, object] | None = None,
    also: Mapping[str, Sequence] | None = None,
    domains: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """Add the combinations of observed key values that have no row.

    ``keys`` are key columns; a nested list counts as one key whose combinations
    are taken as observed. ``fill`` replaces missing measures, present ones too.
    ``also`` gives known values of a key that may not be observed, ``domains`` all values that a key can
    have: these are dealt out to every row as they are, without looking for them.

    The first key stays distributed and meets the distinct values of each other key, which
    are dealt to salts: a salt has all values of the other key and its share of the rows
    so far, so nothing is gathered in one task or on the driver. Put the key with most values
    first. ``cells`` are aggregates: they are settled, so that the facts behind them are read
    once and not for each branch.
    """
    cells = settled(cells)
    groups = [[key] if isinstance(key, str) else list(key) for key in keys]
    names = [name for group in groups for name in group]
    measures = [name for name in cells.columns if name not in names]
    first, *others = groups
    product = cells.select(*first).distinct()
    salts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for group in others:
        if group[0] in (domains or {}):
            product = product.withColumn(group[0], F.explode(F.array(*[F.lit(v) for v in domains[group[0]]])))
            continue
        values = cells.select(*group)
        known = (also or {}).get(group[0]) if len(group) == 1 else None
        if known:
            kind = cells.schema[group[0]].dataType
            values = values.unionAll(cells.sparkSession.createDataFrame([(v,) for v in known], StructType([StructField(group[0], kind)])))
        dealt = values.distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = product.withColumn("_salt", F.pmod(F.hash(*product.columns), F.lit(salts)))
        product = salted.join(dealt, "_salt").drop("_salt")

    left, right = product.alias("p"), cells.alias("c")
    same: Column = reduce(
        lambda a, b: a & b, [F.col(f"p.{name}").eqNullSafe(F.col(f"c.{name}")) for name in names]
    )
    filled = []
    for name in measures:
        value = F.col(f"c.{name}")
        if fill and name in fill:
            value = F.coalesce(value, F.lit(fill[name]))
        filled.append(value.alias(name))
    return left.join(right, same, "left").select(*[F.col(f"p.{name}") for name in names], *filled)
