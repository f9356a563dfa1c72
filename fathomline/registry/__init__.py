"""Named queries over the test tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.sources.bindings import Bound, with_bindings


@dataclass
class Query:
    name: str
    build: Callable[[Bound], DataFrame]
    sql: str | None = None
    uses: tuple[str, ...] = ()
    extra: dict[str, str] = field(default_factory=dict)
    digits: dict[str, int] = field(default_factory=dict)

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        """The query with its doubles rounded as the check rounds them."""
        df = self.build(Bound(spark, folder))
        columns = []
        for name, kind in df.dtypes:
            column = F.col(f"`{name}`")
            if kind == "double":
                column = F.round(column, self.digits.get(name, 6)) + F.lit(0.0)
            columns.append(column.alias(name))
        return df.select(*columns)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return with_bindings(self.uses, self.extra) + "\n" + self.sql.strip()


ALL: dict[str, Query] = {}


def register(name: str, build, sql: str | None = None, uses=(), extra=None, digits=None) -> None:
    ALL[name] = Query(name, build, sql, tuple(uses), dict(extra or {}), dict(digits or {}))


def load() -> dict[str, Query]:
    from fathomline.registry import catch, extraction, gaps, lengths, limits, models, sources, survey  # noqa: F401

    return ALL
