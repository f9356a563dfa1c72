"""Readers and writers for delimited files, databases and sectioned reports."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path, schema) -> DataFrame:
    """CSV with a header, NA for missing, quoted commas; a byte-order mark is dropped."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", "NA")
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(path)
    )


def write_csv(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and return what was written, read back, so that a pipeline goes on without redoing it."""
    # quotes inside a field are doubled, as the reader takes them
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").option("escape", '"').csv(path)
    return read_csv(df.sparkSession, path, df.schema)


def write_yearly(df: DataFrame, path: str, assessment_year: int) -> DataFrame:
    """Parquet output of one assessment year in its own partition folder, read back."""
    target = f"{path.rstrip('/')}/assessment_year={int(assessment_year)}"
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def read_yearly(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def jdbc_options(
    url: str,
    query: str,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int = 64,
    fetch_rows: int = 10_000,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Reader options for a database query, split on a numeric column when one is given.

    Spark takes a split only together with ``dbtable``, so the query becomes a
    derived table in that case. ``properties`` go to the driver as they are: user, password,
    driver class and the like, which the caller takes from where secrets are kept.
    """
    options = {**(properties or {}), "url": url, "fetchsize": str(fetch_rows)}
    if partition_column is None:
        return {**options, "query": query}
    if lower is None or upper is None:
        raise ValueError("a split read needs the lower and upper value of its column")
    return {
        **options,
        "dbtable": f"({query}) source",
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def read_database(spark: SparkSession, **options) -> DataFrame:
    """Database query scan; filters and columns chosen later are pushed to the source."""
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def bounds_query(query: str, column: str) -> str:
    """Query for what a split needs to know of a numeric column: least, greatest, rows, and rows without a value."""
    return (
        f"SELECT MIN({column}) AS lowest, MAX({column}) AS highest, COUNT(*) AS total, COUNT(*) - COUNT({column}) AS absent"
        f" FROM ({query}) source"
    )


def split_predicates(column: str, lowest, highest, total: int, absent: int, rows: int = 1_000_000, most: int = 1024) -> list[str]:
    """Conditions that part a table into about ``rows`` rows each; every row meets exactly one of them.

    Ranges of equal width between the bounds, the first and last without an end, so that rows written
    after the bounds were read are not lost; rows without a value have a condition of their own, which is there
    whether or not any were seen. Numbers of any length stay whole. Without values there is one range.
    """
    missing = f"{column} IS NULL"
    if lowest is None or highest is None:
        return [missing, f"{column} IS NOT NULL"]
    low, high = int(math.floor(lowest)), int(math.ceil(highest))
    parts = max(1, min(most, -(-(total - absent) // rows), high - low + 1))
    cuts = sorted({low + (high - low) * k // parts for k in range(1, parts)})
    if not cuts:
        return [missing, f"{column} IS NOT NULL"]
    ranges = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [missing, f"{column} < {cuts[0]}", *ranges, f"{column} >= {cuts[-1]}"]


def read_database_split(
    spark: SparkSession,
    url: str,
    query: str,
    column: str,
    rows: int = 1_000_000,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """Database query scan in parts of about ``rows`` rows, cut on a numeric column by bounds that the source tells.

    One small query asks for the bounds and the number of missing values; each part is then read by a task of its own.
    """
    known = read_database(spark, url=url, query=bounds_query(query, column), properties=properties).first()
    found = {name.lower(): value for name, value in known.asDict().items()}
    conditions = split_predicates(column, found["lowest"], found["highest"], int(found["total"]), int(found["absent"]), rows)
    return spark.read.jdbc(url, f"({query}) source", predicates=conditions, properties=dict(properties or {}))


def write_report(lines: DataFrame, path: str) -> DataFrame:
    """Write report lines in order; part files follow each other in name order. Returns the lines read back."""
    lines.orderBy("section", "row_no").select("line").write.mode("overwrite").text(path)
    return lines.sparkSession.read.text(path).withColumnRenamed("value", "line")


def quoted_list(values) -> str:
    """'a', 'b' for an SQL IN list; quotes inside a value are doubled."""
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def wide_key_filter(df: DataFrame, column: str, key: str) -> DataFrame:
    """Rows of one key that may exceed BIGINT, given as text."""
    return df.filter(F.col(column) == F.lit(key).cast("decimal(20,0)"))
