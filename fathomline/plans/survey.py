"""Survey biomass by stratum: sums, grids, intervals and tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import big_mark, drop_trailing_zeros, fixed, or_na, ratio, strict_sum
from fathomline.operators import complete, pivot_wider
from fathomline.plans.labels import (
    AI_AREAS,
    MAJOR_SPECIES,
    SST,
    SST_NAME,
    Z_ROUNDED,
    complex_of_code,
    keep_or_other,
    ordinal,
)

REGION_ORDER = ["AI", "EBS_SHELF", "SBS", "EBS_SLOPE"]
AREA_ORDER = ["AI", "EBS Shelf", "SBS", "EBS Slope"]


def survey_region() -> Column:
    """Survey as region, with the AI survey split into AI and SBS."""
    in_ai = F.col("survey") == "AI"
    return (
        F.when(in_ai & (F.col("area") == "SBS"), F.lit("SBS"))
        .when(in_ai & F.col("area").contains("AI"), F.lit("AI"))
        .otherwise(F.col("survey"))
    )


def area_region() -> Column:
    """Area as region, with the three AI areas folded."""
    return F.when(F.col("area").isin(AI_AREAS), F.lit("AI")).otherwise(F.col("area"))


REGIONS = {"survey": survey_region, "area": area_region}


def biomass_strata(biomass: DataFrame, scheme: str = "survey", zero_cv: str = "zero") -> DataFrame:
    """Biomass, variance and cv by species group, region and year.

    Variances are added across species, as the published numbers are. ``zero_cv``
    says what cv a zero biomass has: 0 ('zero') or none ('null').
    """
    sums = biomass.groupBy(complex_of_code().alias("species"), REGIONS[scheme]().alias("region"), "year").agg(
        strict_sum("biomass").alias("biomass"), strict_sum("var").alias("var")
    )
    return sums.withColumn("cv", _cv(zero_cv))


def _cv(zero_cv: str) -> Column:
    cv = ratio(F.sqrt("var"), F.col("biomass"))
    return cv if zero_cv == "null" else F.when(F.col("biomass") == 0, F.lit(0.0)).otherwise(cv)


def biomass_complex_all(biomass: DataFrame, name: str, region: Column | None = None) -> DataFrame:
    """The whole complex as one stock by region (the survey, unless given) and year."""
    region = F.col("survey") if region is None else region
    sums = biomass.groupBy(F.lit(name).alias("species"), region.alias("region"), "year").agg(
        strict_sum("biomass").alias("biomass"), strict_sum("var").alias("var")
    )
    return sums.withColumn("cv", _cv("zero"))


def folded_area() -> Column:
    """Area with the three AI areas and SBS in one."""
    return F.when(F.col("area").isin([*AI_AREAS, "SBS"]), F.lit("AI")).otherwise(F.col("area"))


def merged_species(merges: Mapping[str, Sequence[str]]) -> Column:
    """Common name after merging the names listed under each new name."""
    name = F.col("common_name")
    merged = name
    for new, olds in merges.items():
        merged = F.when(name.isin(list(olds)), F.lit(new)).otherwise(merged)
    return merged


# fixed values: species reported together, by survey region and by area
MERGED_BY_SURVEY = {
    "dusky rockfish": ["dusky and dark rockfishes unid."],
    "other thornyhead": ["broadfin thornyhead", "longspine thornyhead"],
}
MERGED_BY_AREA = {
    "dusky and dark rockfish": ["dusky and dark rockfishes unid.", "dusky rockfish"],
    "other thornyhead": ["broadfin thornyhead", "longspine thornyhead"],
}


def biomass_species_complete(biomass: DataFrame, scheme: str = "survey") -> DataFrame:
    """Biomass of the remaining species by region and year on a full grid."""
    if scheme == "survey":
        rows, merges, levels = biomass.filter(F.col("common_name") != SST_NAME), MERGED_BY_SURVEY, REGION_ORDER
    else:
        rows, merges, levels = biomass.filter(complex_of_code() != SST), MERGED_BY_AREA, AREA_ORDER
    sums = rows.groupBy(
        merged_species(merges).alias("species"), REGIONS[scheme]().alias("region"), "year"
    ).agg(strict_sum("biomass").alias("biomass"), strict_sum("var").alias("var"))
    full = complete(sums, ["species", "region", "year"], {"biomass": 0.0, "var": 0.0})
    return full.withColumn("region_order", ordinal(F.col("region"), levels))


def biomass_group_complete(biomass: DataFrame) -> DataFrame:
    """Biomass of the two groups by region and year on a full grid."""
    sums = biomass.groupBy(complex_of_code().alias("species"), survey_region().alias("region"), "year").agg(
        strict_sum("biomass").alias("biomass")
    )
    return complete(sums, ["species", "region", "year"], {"biomass": 0.0})


# fixed values: display group of each common name; other names have none
SPECIES_GROUPS = {
    "shortspine thornyhead": "SST",
    "dusky and dark rockfishes unid.": "dusky",
    "dusky rockfish": "dusky",
    "broadfin thornyhead": "other thornyheads",
    "longspine thornyhead": "other thornyheads",
    "redbanded rockfish": "redbanded",
    "sharpchin rockfish": "sharpchin",
    "harlequin rockfish": "harlequin",
    "yelloweye rockfish": "yelloweye",
    "yellowmouth rockfish": "yellowmouth",
    "rockfish unid.": "other",
}


def species_label(biomass: DataFrame) -> DataFrame:
    """Biomass rows with group, region, subarea and display names."""
    label = F.lit(None).cast("string")
    for name, group in SPECIES_GROUPS.items():
        label = F.when(F.col("common_name") == name, F.lit(group)).otherwise(label)
    region = survey_region()
    return biomass.select(
        complex_of_code().alias("species"),
        "common_name",
        F.when(region == "AI", F.lit("AI")).otherwise(F.lit("EBS")).alias("fmp_subarea"),
        region.alias("region"),
        "year",
        "biomass",
        label.alias("species_name"),
        keep_or_other(label, MAJOR_SPECIES).alias("species_name2"),
    )


def survey_ci(strata: DataFrame, z: float = Z_ROUNDED) -> DataFrame:
    """Normal 95% interval of the survey estimate, never below 0."""
    half = F.lit(z) * F.sqrt("var")
    low = F.col("biomass") - half
    return strata.withColumns(
        {"lci": F.when(low < 0, F.lit(0.0)).otherwise(low), "uci": F.col("biomass") + half}
    )


def survey_grid_nulls(
    strata: DataFrame, impossible: Sequence[tuple[str, str]] = ((SST, "EBS_SHELF"),)
) -> DataFrame:
    """All species, region and year combinations, empty where not surveyed.

    The four survey regions are always there, observed or not.
    """
    full = complete(strata, ["species", "region", "year"], also={"region": REGION_ORDER})
    for species, region in impossible:
        full = full.filter(~((F.col("species") == species) & (F.col("region") == region)))
    return full


def significant(value: Column, digits: int) -> Column:
    """Number text with at least ``digits`` significant digits, whole part kept."""
    size = F.when(value == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(value))))
    decimals = F.greatest(F.lit(0), F.lit(digits - 1) - size).cast("int")
    return drop_trailing_zeros(F.call_function("format_number", value, decimals))


def blank_cell(value: str = "biomass", cv: str = "cv") -> Column:
    """'1,234 (0.23)'; a missing part and a cv that rounds to 0 are left blank."""
    amount = F.coalesce(big_mark(F.col(value)), F.lit(""))
    shown = F.when(F.bround(cv, 2) != 0, fixed(F.col(cv), 2)).otherwise(F.lit(""))
    return (
        F.when(shown == "", amount).otherwise(F.concat(amount, F.lit(" ("), shown, F.lit(")")))
    )


def na_cell(value: str = "biomass", cv: str = "cv") -> Column:
    """'1,234 (0.23)'; a missing cv prints as NA, a missing value leaves no text."""
    shown = or_na(significant(F.bround(cv, 2), 2))
    text = F.concat(significant(F.col(value), 1), F.lit(" ("), shown, F.lit(")"))
    return F.when(F.col(value).isNotNull(), text)


def biomass_cv_table(strata: DataFrame, regions: Sequence[str] = REGION_ORDER) -> DataFrame:
    """Species and year by region with blank-style cells."""
    cells = strata.select("species", "year", "region", blank_cell().alias("text"))
    return pivot_wider(cells, ["species", "year"], "region", "text", regions)


def cv_table(
    series: DataFrame, strata: Sequence[str], years: DataFrame | None = None, column: str = "strata",
    value: str = "biomass",
) -> DataFrame:
    """Year by stratum with NA-style cells, on a spine of years when one is given."""
    cells = series.select("year", column, na_cell(value).alias("text"))
    wide = pivot_wider(cells, ["year"], column, "text", strata)
    return wide if years is None else years.join(wide, "year", "left")


def zero_obs_flag(strata: DataFrame) -> DataFrame:
    return strata.withColumn("zero_obs", F.col("biomass") == 0)


def drop_years_before(df: DataFrame, first_years: Mapping[str, int]) -> DataFrame:
    """Leave out years before the survey of a region began."""
    for region, first in first_years.items():
        df = df.filter(~((F.col("region") == region) & (F.col("year") < first)))
    return df
