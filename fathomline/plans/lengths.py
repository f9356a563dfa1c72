"""Length compositions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.functions import or_na, ratio, strict_sum, strict_sum_over
from fathomline.plans.labels import DUSKY_CODE, SST_CODE

GROUP = ["source", "fmp_subarea", "species_code", "year"]


def length_comps(lengths: DataFrame, species: DataFrame, more_than: float = 50) -> DataFrame:
    """Share of each length in its source, subarea, species and year; small groups dropped.

    The window runs over sums per length, so a group has as many rows as lengths.
    """
    sums = lengths.groupBy(*GROUP, "length").agg(strict_sum("frequency").alias("n"))
    whole = strict_sum_over("n", W.partitionBy(*GROUP))
    total = F.col("total")
    number = F.when(total == F.floor(total), total.cast("bigint").cast("string")).otherwise(
        total.cast("string")
    )
    names = species.select("species_code", "common_name")
    return (
        sums.withColumn("total", whole)
        .filter(total > more_than)
        .join(names, "species_code", "left")
        .select(
            *GROUP,
            "length",
            "n",
            ratio("n", "total").alias("prop"),
            "common_name",
            F.concat(F.lit("N = "), or_na(number)).alias("n_label"),
        )
    )


def length_comps_check(comps: DataFrame) -> DataFrame:
    """Sum of the shares in each group, 1 when all is well."""
    return comps.groupBy(*GROUP).agg(strict_sum("prop").alias("tst"))


@dataclass(frozen=True)
class Panel:
    """One figure: a species, the sources and subareas shown and the length range."""

    name: str
    species: int
    sources: dict[str, str]  # source in the data -> source shown
    subareas: tuple[str, ...]
    shortest: float
    longest: float
    first_year: int
    data_from: int | None = None


AI_SBS = "AI BTS in SBS"


def panels(dusky_from: int = 1997, sst_from: int = 1996) -> list[Panel]:
    """The four figures; the EBS one of SST starts a year later in the data."""
    same = lambda *names: {name: name for name in names}
    ebs = {"AI BTS": AI_SBS}
    return [
        Panel("AI dusky", DUSKY_CODE, same("AI fishery", "AI BTS"), ("AI",), 20, 50, dusky_from),
        Panel(
            "EBS dusky", DUSKY_CODE, {**same("EBS fishery"), **ebs}, ("EBS", "SBS"), 20, 50, dusky_from
        ),
        Panel(
            "AI SST", SST_CODE, same("AI BTS", "AI fishery", "AI LLS"), ("AI",), 10, 70, sst_from, sst_from
        ),
        Panel(
            "EBS SST", SST_CODE, {**ebs, **same("EBS LLS", "EBS fishery")}, ("EBS", "SBS"), 10, 70,
            sst_from, sst_from + 1,
        ),
    ]


def length_year_spine(comps: DataFrame, shown: Sequence[Panel], last_year: int) -> DataFrame:
    """Compositions of every panel on a spine of all its years and sources.

    Each row is sent to the panels that show it, so the lengths are read once.
    """
    pieces = []
    for panel in shown:
        source = F.lit(None).cast("string")
        for old, new in panel.sources.items():
            source = F.when(F.col("source") == old, F.lit(new)).otherwise(source)
        fits = (
            (F.col("species_code") == panel.species)
            & F.col("length").between(panel.shortest, panel.longest)
            & F.col("source").isin(list(panel.sources))
            & F.col("fmp_subarea").isin(list(panel.subareas))
        )
        if panel.data_from is not None:
            fits = fits & (F.col("year") >= panel.data_from)
        pieces.append(F.when(fits, F.struct(F.lit(panel.name).alias("panel"), source.alias("shown"))))
    rows = comps.select("*", F.inline(F.array_compact(F.array(*pieces)))).drop("source")
    rows = rows.withColumnRenamed("shown", "source")

    spine = comps.sparkSession.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(panel.name).alias("panel"),
                        F.lit(source).alias("source"),
                        F.lit(panel.first_year).alias("first"),
                    )
                    for panel in shown
                    for source in panel.sources.values()
                ]
            )
        )
    )
    spine = spine.select("panel", "source", F.explode(F.sequence("first", F.lit(last_year))).alias("year"))
    return spine.join(rows, ["panel", "source", "year"], "left")
