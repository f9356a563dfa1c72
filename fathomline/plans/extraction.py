"""Cleaning of source tables: species, surveys, catch, observer and line-survey data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import na_skipping_sum, ratio, replace_first_literal, strict_sum
from fathomline.operators import complete, lookup_join, lower_names
from fathomline.plans.labels import (
    DUSKY_CODE,
    MAIN_NAMES,
    NAME_PATTERN,
    OTHER_NAMES,
    SST,
    SST_AGENCY_CODE,
    SST_CODE,
    either,
)

# fixed values: what precedes or follows a species name in the catch records
NAME_PARTS = ["rockfish, ", " (red snapper)", " (idiots)"]
# fixed values: survey areas and their short names
AREA_NAMES = {
    "Southern Bering Sea": "SBS",
    "Eastern Aleutians": "Eastern AI",
    "Western Aleutians": "Western AI",
    "Central Aleutians": "Central AI",
}


# --- species ---------------------------------------------------------------
def species_subset(
    species: DataFrame, names: Sequence[str] = (*MAIN_NAMES, *OTHER_NAMES), pattern: str = NAME_PATTERN
) -> DataFrame:
    """Species listed by name or matched by a pattern."""
    return species.filter(F.col("common_name").isin(list(names)) | F.col("common_name").rlike(pattern))


def agency_codes(agency: DataFrame, species: DataFrame, pattern: str | None = None) -> DataFrame:
    """Agency codes of chosen species, found through their survey code."""
    wanted = species.select(F.col("species_code").alias("species_code_race")).distinct()
    found = lower_names(agency).join(wanted, "species_code_race", "left_semi")
    return found if pattern is None else found.filter(F.col("common_name").rlike(pattern))


def catch_species_list(raw: DataFrame, group: str) -> DataFrame:
    """Species codes and names reported under one species group."""
    columns = ["agency_species_code", "species_name", "species_group_name"]
    return raw.filter(F.col("species_group_name") == group).select(*columns).distinct()


def area_lookup(raw: DataFrame, fmp: str) -> DataFrame:
    """Reporting areas of one management area with their subarea."""
    return (
        raw.filter((F.col("fmp_area") == fmp) & F.col("reporting_area_code").isNotNull())
        .select(F.col("fmp_area").alias("fmp"), "fmp_subarea", F.col("reporting_area_code").alias("nmfs_area"))
        .distinct()
    )


# --- surveys ---------------------------------------------------------------
def survey_harmonize(
    ai: DataFrame, areas: DataFrame, shelf: DataFrame, slope: DataFrame, species: DataFrame
) -> DataFrame:
    """Three survey sources in one table with area and species names."""
    area = F.lit(None).cast("string")
    for long, short in AREA_NAMES.items():
        area = F.when(F.col("area") == long, F.lit(short)).otherwise(area)
    ai = lower_names(ai).join(lower_names(areas), ["survey", "area_code"], "left").withColumn("area", area)
    shelf = lower_names(shelf).withColumn("area", F.lit("EBS Shelf"))
    slope = lower_names(slope).withColumns({"survey": F.lit("EBS_SLOPE"), "area": F.lit("EBS Slope")})
    names = lower_names(species).select("species_code", "common_name")
    columns = ["survey", "year", "area_code", "species_code", "biomass", "var", "area", "common_name"]
    return (
        ai.unionByName(shelf, allowMissingColumns=True)
        .unionByName(slope, allowMissingColumns=True)
        .join(names, "species_code", "left")
        .select(*columns)
    )


# --- catch -----------------------------------------------------------------
def catch_extract(raw: DataFrame, codes: Sequence[int], fmp: str, first_year: int) -> DataFrame:
    """Landing records of given species in one management area since a year."""
    return lower_names(raw).filter(
        F.col("agency_species_code").isin(list(codes))
        & (F.col("fmp_area") == fmp)
        & (F.col("year") >= first_year)
    )


# fixed values: tidy column and the source column it comes from
CATCH_COLUMNS = {
    "year": "year",
    "date": "catch_activity_date",
    "fmp": "fmp_area",
    "fmp_subarea": "fmp_subarea",
    "nmfs_area": "reporting_area_code",
    "gear": "agency_gear_code",
    "retained_or_discarded": "retained_or_discarded",
    "target": "trip_target_name",
    "species_code": "agency_species_code",
    "species_group": "species_group_name",
    "species_name": "species_name",
    "tons": "weight_posted",
}


MIXED_CLASS = "thornyhead"
MIXED_REST = "other thornyheads"


def short_species(name_parts: Sequence[str] = NAME_PARTS) -> Column:
    """Species name without the parts that reports leave out."""
    species = F.col("species_name")
    for part in name_parts:
        species = replace_first_literal(species, part)
    return species


def catch_clean(
    raw: DataFrame, name_parts: Sequence[str] = NAME_PARTS, columns: Sequence[str] = tuple(CATCH_COLUMNS)
) -> DataFrame:
    """Landing records (or their sums) with tidy columns, short species names and EBS for BS."""
    subarea = F.col("fmp_subarea")
    tidied = {
        "species_name": short_species(name_parts),
        "fmp_subarea": F.when(subarea == "BS", F.lit("EBS")).otherwise(subarea),
    }
    return lower_names(raw).select(*[tidied.get(c, F.col(CATCH_COLUMNS[c])).alias(c) for c in columns])


def target_catch_filter(raw: DataFrame, target: str, name_parts: Sequence[str]) -> DataFrame:
    """Cleaned catch of a one-species fishery, directed trips only."""
    return catch_clean(raw, name_parts).filter(F.col("target") == target)


def strata_series_complete(raw: DataFrame, stratum: str = "sampling_strata_name") -> DataFrame:
    """Yearly catch of each observed stratum and area, 0 where a year has none."""
    cells = raw.groupBy("year", stratum, "reporting_area_code").agg(strict_sum("weight_posted").alias("catch"))
    return complete(cells, [[stratum, "reporting_area_code"], "year"], {"catch": 0.0})


# --- observers -------------------------------------------------------------
def observer_join(
    composition: DataFrame,
    hauls: DataFrame,
    species: Sequence[int],
    area_range: tuple[int, int] | None = None,
    areas: Sequence[int] | None = None,
    first_year: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Species composition with the haul it came from. Hauls are unique by key.

    ``first_year`` bounds the year of the composition where that table has one, else of the
    haul. A column that both tables have is taken from the composition. ``columns`` picks
    what is read on.
    """
    hauls, composition = lower_names(hauls), lower_names(composition)
    composition = composition.filter(F.col("species").isin(list(species)))
    if area_range is not None:
        hauls = hauls.filter(F.col("nmfs_area").between(*area_range))
    if areas is not None:
        hauls = hauls.filter(F.col("nmfs_area").isin(list(areas)))
    if first_year is not None and "year" in composition.columns:
        composition = composition.filter(F.col("year") >= first_year)
    elif first_year is not None:
        hauls = hauls.filter(F.col("year") >= first_year)
    both = [c for c in hauls.columns if c in composition.columns and c != "haul_join"]
    joined = composition.join(hauls.drop(*both), "haul_join")
    return joined if columns is None else joined.select(*columns)


def subarea_of_area(area: str = "nmfs_area"):
    """Areas 500 to 540 count as EBS for the proportion, although 540 is listed under AI."""
    return either(F.col(area).between(500, 540), F.lit("EBS"), F.lit("AI"))


def class_proportion(observed: DataFrame, code: int = SST_AGENCY_CODE, name: str = "prop_sst") -> DataFrame:
    """Share of one species in the observed weight by year and subarea.

    One aggregation with conditional sums: no window over the class sums.
    """
    hit = F.col("species") == code
    weight = F.col("extrapolated_weight")
    return (
        observed.groupBy("year", subarea_of_area().alias("fmp_subarea"))
        .agg(
            F.count(F.when(hit, 1)).alias("seen"),
            F.sum(F.when(hit, weight)).alias("w"),
            strict_sum(weight).alias("total"),
        )
        .filter(F.col("seen") > 0)
        .select("year", "fmp_subarea", ratio("w", "total").alias(name))
    )


def class_proportion_of_hauls(
    composition: DataFrame,
    hauls: DataFrame,
    species: Sequence[int],
    area_range: tuple[int, int],
    code: int = SST_AGENCY_CODE,
    name: str = "prop_sst",
    first_year: int | None = None,
) -> DataFrame:
    """The same shares straight from the two source tables.

    ``first_year`` bounds the year of the composition where that table has one, else of the haul.
    Weights are summed per haul before the join, so a haul with very many rows
    meets its haul record as a single row and the join keeps the shuffle of the sum.
    """
    hit = F.col("species") == code
    weight = F.col("extrapolated_weight")
    composition, hauls = lower_names(composition), lower_names(hauls)
    if first_year is not None:
        since = F.col("year") >= first_year
        if "year" in composition.columns:
            composition = composition.filter(since)
        else:
            hauls = hauls.filter(since)
    per_haul = (
        composition.filter(F.col("species").isin(list(species)))
        .groupBy("haul_join")
        .agg(
            F.count(F.when(hit, 1)).alias("seen"),
            F.sum(F.when(hit, weight)).alias("w"),
            strict_sum(weight).alias("total"),
        )
    )
    places = hauls.filter(F.col("nmfs_area").between(*area_range)).select(
        "haul_join", "year", subarea_of_area().alias("fmp_subarea")
    )
    return (
        per_haul.join(places, "haul_join")
        .groupBy("year", "fmp_subarea")
        .agg(F.sum("seen").alias("seen"), F.sum("w").alias("w"), strict_sum("total").alias("total"))
        .filter(F.col("seen") > 0)
        .select("year", "fmp_subarea", ratio("w", "total").alias(name))
    )


def haul_count_check(composition: DataFrame, hauls: DataFrame, code: int, at_least: int) -> DataFrame:
    """Hauls per year and gear in which one species has at least some number of rows."""
    rows = (
        lower_names(composition)
        .filter(F.col("species") == code)
        .groupBy("haul_join")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        rows.join(lower_names(hauls).select("haul_join", "year", "gear_type"), "haul_join")
        .groupBy("year", "gear_type")
        .agg(F.count(F.when(F.col("n") >= at_least, 1)).alias("n_hauls"))
    )


def allocate_by_proportion(
    catch: DataFrame,
    proportion: DataFrame,
    mixed: str = MIXED_CLASS,
    part: str = SST,
    rest: str = MIXED_REST,
    share: str = "prop_sst",
    aggregated: bool = False,
) -> DataFrame:
    """Split the rows of a mixed class into a part and the rest; other rows pass.

    One pass over the catch: each row becomes one or two. Where no proportion is
    known, both halves have missing tons. Splitting is linear, so it may also run on
    aggregated catch (``aggregated``); both sides are small then and join plainly.
    """
    keys = ["year", "fmp_subarea"]
    catch = catch.filter(F.col("species_name").isNotNull())
    joined = catch.join(proportion, keys, "left") if aggregated else lookup_join(catch, proportion, keys)
    tons, p = F.col("tons"), F.col(share)

    def piece(name, amount):
        return F.struct(name.alias("species_name"), amount.alias("tons"))

    pieces = F.when(
        F.col("species_name") == mixed,
        F.array(piece(F.lit(part), tons * p), piece(F.lit(rest), tons * (1 - p))),
    ).otherwise(F.array(piece(F.col("species_name"), tons)))
    others = [c for c in catch.columns if c not in ("species_name", "tons")]
    return joined.select(*others, F.inline(pieces)).select(*catch.columns)


# --- line survey -----------------------------------------------------------
# fixed values: survey area names of the two groups of slopes
WEST_SLOPES = ["NW Aleutians slope", "SW Aleutians slope"]
EAST_SLOPES = ["NE Aleutians slope", "SE Aleutians slope"]


def lls_index(lls: DataFrame, country: str = "United States") -> DataFrame:
    """Relative weight and its cv by stratum and year; missing parts are skipped."""
    place = F.col("geographic_area_name")
    strata = F.when(place.isin(EAST_SLOPES), F.lit("Eastern AI")).otherwise(F.lit("EBS Slope"))
    sums = (
        lls.filter((F.col("country") == country) & ~F.coalesce(place.isin(WEST_SLOPES), F.lit(False)))
        .groupBy(strata.alias("strata"), "year")
        .agg(na_skipping_sum("rpw").alias("cpue"), na_skipping_sum("rpw_var").alias("v"))
    )
    return sums.select("strata", "year", "cpue", ratio(F.sqrt("v"), F.col("cpue")).alias("cv"))


def lls_series(lls: DataFrame) -> DataFrame:
    return lls.filter(F.col("rpn").isNotNull())


def lls_length_sum(lengths: DataFrame) -> DataFrame:
    return (
        lengths.filter(F.col("geographic_area_name").rlike("Bering|Aleutians"))
        .groupBy("year", "council_sablefish_management_area", "length")
        .agg(na_skipping_sum("rpw").alias("rpw"))
    )


# --- lengths ---------------------------------------------------------------
def sorted_detail(df: DataFrame, *keys: str) -> DataFrame:
    """Sort by ``keys`` and then by all other columns.

    The extra keys change nothing that is asked for, but let a range of equal keys
    be cut into several partitions when one key holds a large part of the rows.
    """
    return df.orderBy(*keys, *[c for c in df.columns if c not in keys])


def fishery_length_prep(
    lengths: DataFrame, areas: DataFrame, codes: Mapping[int, int] | None = None, sort: bool = True
) -> DataFrame:
    """Observer lengths with survey species codes and the subarea of their area."""
    codes = codes or {SST_AGENCY_CODE: SST_CODE}
    code = F.lit(DUSKY_CODE)
    for agency, survey in codes.items():
        code = either(F.col("species_code") == agency, F.lit(survey), code)
    lengths = lower_names(lengths).withColumn("species_code", code)
    joined = lookup_join(lengths, areas, ["nmfs_area"])
    subarea = F.col("fmp_subarea")
    joined = joined.withColumn("fmp_subarea", F.when(subarea == "BS", F.lit("EBS")).otherwise(subarea))
    return sorted_detail(joined, "species_code", "year", "length") if sort else joined


def survey_length_prep(lengths: DataFrame, sort: bool = True) -> DataFrame:
    """Survey lengths in cm."""
    df = lower_names(lengths).withColumn("length", F.col("length") / 10)
    return sorted_detail(df, "species_code", "year", "length") if sort else df


def survey_strata(strata: DataFrame) -> DataFrame:
    """Strata with their area and a text for the depth range."""
    depth = F.concat(
        F.col("min_depth").cast("string"), F.lit("-"), F.col("max_depth").cast("string"), F.lit(" m")
    )
    return lower_names(strata).select("area", "stratum", depth.alias("description")).distinct()


def survey_length_strata(lengths: DataFrame, strata: DataFrame, sort: bool = True) -> DataFrame:
    """Survey lengths in cm with AI or SBS from the stratum; one area is left out."""
    df = survey_length_prep(lengths, sort=False).join(survey_strata(strata), "stratum", "left")
    df = df.filter(F.col("area") != "Chirikof").withColumn(
        "area", F.when(F.col("area").rlike("Aleutians"), F.lit("AI")).otherwise(F.lit("SBS"))
    )
    return sorted_detail(df, "species_code", "area", "year", "length") if sort else df


def length_union(fishery: DataFrame, survey: DataFrame, slope: DataFrame, line: DataFrame) -> DataFrame:
    """Four length sources in one schema with a source label."""

    def labelled(df, subarea, source):
        return df.withColumn("fmp_subarea", subarea).withColumn("source", source)

    def tail(text):
        return F.concat(F.coalesce(F.col("fmp_subarea"), F.lit("NA")), F.lit(text))

    columns = ["species_code", "year", "length", "frequency", "fmp_subarea", "source"]
    parts = [
        labelled(fishery, F.col("fmp_subarea"), tail(" fishery")),
        labelled(survey, F.col("area"), F.lit("AI BTS")),
        labelled(slope, F.lit("EBS"), F.lit("EBS slope BTS")),
        labelled(
            line.withColumns({"species_code": F.lit(SST_CODE), "frequency": F.col("rpw")}),
            either(F.col("council_sablefish_management_area") == "Aleutians", F.lit("AI"), F.lit("EBS")),
            tail(" LLS"),
        ),
    ]
    union = parts[0].select(*columns)
    for part in parts[1:]:
        union = union.unionByName(part.select(*columns))
    return union
