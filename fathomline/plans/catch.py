"""Catch tables.

Every table takes ``catch``: landing records, or their sums over at least the
columns the table uses (see ``catch_cells``). Wide tables are single aggregations
of conditional sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.functions import (
    drop_trailing_zeros,
    fixed,
    ratio,
    strict_mean,
    strict_sum,
    strict_sum_where,
)
from fathomline.operators import clean_names, complete, lower_names, pivot_wider, top_with_ties
from fathomline.plans.extraction import (
    CATCH_COLUMNS,
    allocate_by_proportion,
    catch_clean,
)
from fathomline.plans.labels import (
    COMMON_SPECIES,
    COMPLEX,
    GEARS,
    KEY_AREAS,
    MAJOR_SPECIES,
    NON_SST,
    SST,
    complex_of_name,
    either,
    keep_or_other,
    ordinal,
)
from fathomline.session import settled

COMPLEX_ORDER = [SST, NON_SST]


def yearly(catch: DataFrame, *keys: str | Column) -> DataFrame:
    return catch.groupBy(*keys).agg(strict_sum("tons").alias("catch"))


def with_complex(catch: DataFrame) -> DataFrame:
    return catch.withColumn("complex", complex_of_name())


def catch_cells(
    raw: DataFrame, proportion: DataFrame, keys: Sequence[str], species: Sequence[str] | None = None
) -> DataFrame:
    """Landing records summed over ``keys``, tidied, and split into SST and other thornyheads.

    The source columns are summed as they are; the sums are then tidied and split. So
    no text is worked on record by record, and the records are neither joined nor
    doubled. A key may have several rows here: the tables sum again. ``species`` keeps these
    names only, once the sums are tidied: a name is not cleaned per record to be compared.
    """
    raw = lower_names(raw)
    needed = list(dict.fromkeys(["year", "fmp_subarea", *keys, "species_name"]))
    sums = (
        raw.groupBy(*[CATCH_COLUMNS[key] for key in needed])
        .agg(strict_sum(CATCH_COLUMNS["tons"]).alias(CATCH_COLUMNS["tons"]))
    )
    split = allocate_by_proportion(catch_clean(sums, columns=[*needed, "tons"]), proportion, aggregated=True)
    return split if species is None else split.filter(F.col("species_name").isin(list(species)))


# --- totals ----------------------------------------------------------------
def noncommercial_catch(records: DataFrame, agencies: Sequence[str]) -> DataFrame:
    """Tonnes by year and agency with a total; weights are in kg."""
    records = clean_names(records).withColumnRenamed("collection_year", "year")
    columns = [
        (strict_sum_where(F.col("collection_agency") == a, "weight") / 1000).alias(a) for a in agencies
    ]
    total = (strict_sum("weight") / 1000).alias("Total (t)")
    return records.groupBy("year").agg(*columns, total)


def catch_by_fmp(catch: DataFrame, fmps: Sequence[str] = ("BSAI",), subareas=("AI", "EBS")) -> DataFrame:
    columns = [strict_sum_where(F.col("fmp") == f, "tons").alias(f) for f in fmps]
    columns += [strict_sum_where(F.col("fmp_subarea") == s, "tons").alias(s) for s in subareas]
    return catch.groupBy(F.col("year").alias("Year")).agg(*columns)


# fixed values: column titles of the species table in print order
SPECIES_TITLES = {
    "dusky": "dusky rockfish",
    "SST": "SST",
    "other thornyheads": "other thornyheads",
    "perc_sst": "% SST in thornyhead catch",
    "harlequin": "harlequin rockfish",
    "yelloweye": "yelloweye rockfish",
    "redbanded": "redbanded rockfish",
    "redstripe": "redstripe rockfish",
    "black": "black rockfish",
    "other": "other rockfish",
    "total": "Total (t)",
}


def catch_by_species(catch: DataFrame, proportion: DataFrame) -> DataFrame:
    """Species columns by year and subarea with an average row, as text.

    Averages count the years in which a species was not caught as 0.
    """
    name = keep_or_other(F.col("species_name"), COMMON_SPECIES)
    wide = catch.groupBy("year", "fmp_subarea").agg(
        *[strict_sum_where(name == s, "tons", 0.0).alias(s) for s in COMMON_SPECIES],
        strict_sum("tons").alias("total"),
    )
    wide = wide.join(proportion, ["year", "fmp_subarea"], "left").withColumn(
        "perc_sst", F.col("prop_sst") * 100
    )
    # a year's own row is the mean of one row, so years and average are one aggregation
    rows = wide.withColumn("Year", F.explode(F.array(F.col("year").cast("string"), F.lit("Average"))))
    means = rows.groupBy(F.col("fmp_subarea").alias("Area"), rows["Year"]).agg(
        *[strict_mean(c).alias(c) for c in SPECIES_TITLES]
    )
    text = {c: fixed(F.col(c), 1) for c in SPECIES_TITLES}
    text["perc_sst"] = F.concat(text["perc_sst"], F.lit("%"))
    return (
        means.orderBy("Area", F.col("Year") == "Average", "Year")
        .select("Year", "Area", *[text[c].alias(title) for c, title in SPECIES_TITLES.items()])
    )


# --- complex ---------------------------------------------------------------
def _key_areas(df: DataFrame) -> DataFrame:
    """Only the areas shown, with their label and display order."""
    label = F.lit(None).cast("string")
    for area, text in KEY_AREAS.items():
        label = F.when(F.col("nmfs_area") == area, F.lit(text)).otherwise(label)
    return df.filter(F.col("nmfs_area").isin(list(KEY_AREAS))).select(
        "*", label.alias("nmfs_area2"), ordinal(F.col("nmfs_area"), list(KEY_AREAS)).alias("area_order")
    )


def catch_complex_area(catch: DataFrame) -> DataFrame:
    """SST and non-SST catch by year and reporting area, selected areas labelled."""
    sums = yearly(with_complex(catch), "year", "nmfs_area", "complex")
    full = complete(sums, ["nmfs_area", "year", "complex"], {"catch": 0.0}, domains={"complex": COMPLEX_ORDER})
    return _key_areas(full).withColumn("complex_order", ordinal(F.col("complex"), COMPLEX_ORDER))


def catch_complex_subarea(catch: DataFrame) -> DataFrame:
    return yearly(with_complex(catch), "year", "fmp_subarea", "complex")


def nonsst_share(catch: DataFrame) -> DataFrame:
    """Percent of non-SST in the yearly catch and its mean over years."""
    group = complex_of_name()
    wide = catch.groupBy("year").agg(
        *[strict_sum_where(group == g, "tons", 0.0).alias(g) for g in (SST, NON_SST)]
    )
    share = ratio(F.col(NON_SST), F.col(NON_SST) + F.col(SST)) * 100
    shares = settled(wide.withColumn("prop_nonsst", share))
    mean = shares.agg(strict_mean("prop_nonsst").alias("m")).scalar()
    return shares.withColumn("mean_prop", mean)


def catch_major_species(catch: DataFrame) -> DataFrame:
    name = keep_or_other(F.col("species_name"), MAJOR_SPECIES)
    sums = yearly(catch, "year", "fmp_subarea", name.alias("species_name2"))
    return complete(sums, ["year", "species_name2", "fmp_subarea"], {"catch": 0.0})


def catch_other_species(catch: DataFrame) -> DataFrame:
    """Breakdown of what is 'other' in the table of major species."""
    name = keep_or_other(F.col("species_name"), COMMON_SPECIES)
    rest = catch.withColumn("species_name", name).filter(~F.col("species_name").isin(MAJOR_SPECIES))
    sums = yearly(rest, "year", "fmp_subarea", "species_name")
    return complete(sums, ["year", "species_name", "fmp_subarea"], {"catch": 0.0})


# --- fisheries -------------------------------------------------------------
# fixed values: trip target to fishery; all others are 'Other'
TARGET_FISHERY = {
    "Atka Mackerel": "Atka mackerel",
    "Greenland Turbot - BSAI": "Flatfish",
    "Kamchatka Flounder - BSAI": "Flatfish",
    "Rock Sole - BSAI": "Flatfish",
    "Flathead Sole": "Flatfish",
    "Other Flatfish - BSAI": "Flatfish",
    "Yellowfin Sole - BSAI": "Flatfish",
    "Pacific Cod": "Pacific cod",
    "Pollock - midwater": "Pollock",
    "Pollock - bottom": "Pollock",
    "Rockfish": "Rockfish",
    "Halibut": "Halibut",
    "Sablefish": "Sablefish",
}
# fixed values: gear code to gear; other codes have none
GEAR_NAME = {
    "NPT": "Bottom trawl",
    "TRW": "Bottom trawl",
    "PTR": "Pelagic trawl",
    "POT": "Pot",
    "HAL": "Longline",
    "JIG": "Jig",
}


def _mapped(column: Column, names: Mapping[str, str], default: Column) -> Column:
    groups: dict[str, list[str]] = {}
    for old, new in names.items():
        groups.setdefault(new, []).append(old)
    result = default
    for new, olds in groups.items():
        result = F.when(column.isin(olds), F.lit(new)).otherwise(result)
    return result


def classify_fishery(catch: DataFrame) -> DataFrame:
    """Add target fishery and gear names."""
    return catch.withColumns(
        {
            "target_fishery": _mapped(F.col("target"), TARGET_FISHERY, F.lit("Other")),
            "gear_name": _mapped(F.col("gear"), GEAR_NAME, F.lit(None).cast("string")),
        }
    )


def _with_fishery(catch: DataFrame) -> DataFrame:
    fishery = F.concat_ws(" ", "target_fishery", F.coalesce(F.col("gear_name"), F.lit("NA")))
    return with_complex(classify_fishery(catch)).withColumn("fishery", fishery)


def top_fisheries(catch: DataFrame, n: int = 5) -> DataFrame:
    """All fishery and group sums, with the name they are shown under.

    The n largest over both groups together keep their name, ties included.
    """
    return _shown_names(settled(yearly(_with_fishery(catch), "fishery", "complex")), n)


def _shown_names(sums: DataFrame, n: int) -> DataFrame:
    top = top_with_ties(sums, "catch", n).select("fishery", "complex", F.lit("top").alias("top"))
    tagged = sums.join(top, ["fishery", "complex"], "left")
    shown = (
        F.when(F.col("top") == "top", F.col("fishery"))
        .when(F.col("fishery").contains("trawl"), F.lit("Other trawl"))
        .otherwise(F.lit("Other fixed gear"))
    )
    return tagged.withColumn("plot_fishery", shown)


def _by_plot_fishery(catch: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Catch by ``keys``, shown fishery and group; the top list covers all of ``catch``."""
    sums = settled(yearly(_with_fishery(catch), *keys, "fishery", "complex"))
    by_fishery = settled(sums.groupBy("fishery", "complex").agg(strict_sum("catch").alias("catch")))
    names = _shown_names(by_fishery, n).select("fishery", "complex", "plot_fishery")
    return (
        sums.join(names, ["fishery", "complex"])
        .groupBy(*keys, "plot_fishery", "complex")
        .agg(strict_sum("catch").alias("catch"))
    )


def catch_fishery_subarea(catch: DataFrame, n: int = 5) -> DataFrame:
    sums = _by_plot_fishery(catch, ["year", "fmp_subarea"], n)
    full = complete(sums, ["year", "fmp_subarea", "plot_fishery", "complex"], {"catch": 0.0})
    return full.withColumn("complex_order", ordinal(F.col("complex"), COMPLEX_ORDER))


def catch_fishery_area(catch: DataFrame, n: int = 5) -> DataFrame:
    sums = _by_plot_fishery(catch, ["year", "nmfs_area"], n)
    full = complete(sums, ["nmfs_area", "year", "plot_fishery", "complex"], {"catch": 0.0})
    return _key_areas(full).withColumn("complex_order", ordinal(F.col("complex"), COMPLEX_ORDER))


# fixed values: regions in the order of the published table
REGION_ORDER = ["AI", "SBS", "EBS Slope"]


def catch_fishery_region(catch: DataFrame, n: int = 5) -> DataFrame:
    """The selected areas folded into three regions."""
    region = (
        F.when(F.col("nmfs_area").isin(541, 542, 543), F.lit("AI"))
        .when(F.col("nmfs_area").isin(517, 519), F.lit("SBS"))
        .when(F.col("nmfs_area") == 521, F.lit("EBS Slope"))
    )
    sums = _by_plot_fishery(catch, ["year", "nmfs_area"], n)
    sums = (
        sums.filter(F.col("nmfs_area").isin(list(KEY_AREAS)))
        .groupBy("year", region.alias("region2"), "plot_fishery", "complex")
        .agg(strict_sum("catch").alias("catch"))
    )
    keys = ["year", "region2", "plot_fishery", "complex"]
    full = complete(sums, keys, {"catch": 0.0}, domains={"region2": REGION_ORDER})
    return full.withColumn("region_order", ordinal(F.col("region2"), REGION_ORDER))


def gear_target_pct(catch: DataFrame) -> DataFrame:
    """Percent of the whole catch by target fishery and gear, with totals, as text."""
    sums = yearly(classify_fishery(catch), "target_fishery", "gear_name")
    by_target = settled(
        sums.groupBy("target_fishery").agg(
            *[strict_sum_where(F.col("gear_name") == g, "catch", 0.0).alias(g) for g in GEARS],
            strict_sum("catch").alias("all"),
        )
    )
    total = by_target.agg(strict_sum("all").alias("total")).scalar()
    percent = by_target.select(
        "target_fishery", *[(ratio(F.col(g), total) * 100).alias(g) for g in GEARS]
    ).withColumn("Total", sum((F.col(g) for g in GEARS[1:]), F.col(GEARS[0])))
    rows = percent.withColumn("row", F.explode(F.array(F.col("target_fishery"), F.lit("Total"))))
    columns = [*GEARS, "Total"]
    summed = rows.groupBy(F.col("row").alias("Target fishery")).agg(
        *[strict_sum(c).alias(c) for c in columns]
    )
    ordered = summed.orderBy(F.col("Target fishery") == "Total", F.col("Total").desc(), "Target fishery")
    return ordered.select(
        "Target fishery", *[drop_trailing_zeros(fixed(F.col(c), 1)).alias(c) for c in columns]
    )


def catch_gear_trend(catch: DataFrame) -> DataFrame:
    sums = yearly(classify_fishery(catch), "year", "gear_name", "fmp_subarea")
    return complete(sums, ["year", "gear_name", "fmp_subarea"], {"catch": 0.0})


def catch_target_trend(catch: DataFrame) -> DataFrame:
    fishery = F.col("target_fishery")
    merged = F.when(fishery.isin("Pollock", "Halibut"), F.lit("Other")).otherwise(fishery)
    sums = yearly(classify_fishery(catch), "year", merged.alias("target2"), "fmp_subarea")
    return complete(sums, ["year", "target2", "fmp_subarea"], {"catch": 0.0})


def detailed_catch_byarea(catch: DataFrame, areas: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Gear and target rows, area columns, total and percent, with a total row, as text.

    ``by`` makes one table per value of further columns in the same pass.
    """
    by = list(by)
    sums = yearly(classify_fishery(catch), *by, "gear_name", "target_fishery", "nmfs_area")
    # each sum goes to its own row and the total row, in its area's column and the total column
    entry = F.struct(F.lit(False).alias("last"), F.col("gear_name").alias("Gear"), F.col("target_fishery").alias("Target fishery"))
    none = F.lit(None).cast("string")
    total = F.struct(F.lit(True).alias("last"), F.lit("Total (t)").alias("Gear"), none.alias("Target fishery"))
    shown = F.when(F.col("nmfs_area").isin(list(areas)), F.col("nmfs_area").cast("string"))
    long = sums.select(*by, F.inline(F.array(entry, total)), "nmfs_area", "catch")
    long = long.select(*by, "last", "Gear", "Target fishery", F.explode(F.array_compact(F.array(shown, F.lit("Total (t)")))).alias("column"), "catch")
    rows = [*by, "last", "Gear", "Target fishery"]
    values = long.groupBy(*rows, "column").agg(strict_sum("catch").alias("value"))

    def text(value: Column) -> Column:
        return drop_trailing_zeros(fixed(value, 1))

    whole_column = F.col("column") == "Total (t)"
    wide = values.withColumn("text", text(F.col("value"))).groupBy(*rows).agg(
        *[F.coalesce(F.max(F.when(F.col("column") == str(area), F.col("text"))), F.lit("0")).alias(str(area)) for area in areas],
        F.max(F.when(whole_column, F.col("text"))).alias("Total (t)"),
        F.max(F.when(whole_column, F.col("value"))).alias("all"),
    )
    # gears by fisheries: a few dozen rows for each table
    if by:
        whole = F.max(F.when(F.col("last"), F.col("all"))).over(W.partitionBy(*by))
    else:
        wide = settled(wide)
        whole = wide.filter("last").agg(F.max("all")).scalar()
    percent = wide.withColumn("% of total", text(ratio(F.col("all"), whole) * 100))
    ordered = percent.orderBy(*by, "last", F.col("all").desc(), "Gear", "Target fishery")
    columns = [*[str(a) for a in areas], "Total (t)", "% of total"]
    return ordered.select(*by, "Gear", "Target fishery", *[F.col(f"`{c}`") for c in columns])


# --- discards --------------------------------------------------------------
def discard_table(catch: DataFrame) -> DataFrame:
    """Retained and discarded catch with percent discarded, as text.

    A total needs both parts: where one is absent it is missing.
    """
    kept = F.col("retained_or_discarded") == "R"
    wide = catch.groupBy(F.col("fmp_subarea").alias("Area"), F.col("year").alias("Year")).agg(
        strict_sum_where(kept, "tons").alias("Retained"), strict_sum_where(~kept, "tons").alias("Discarded")
    )
    total = F.col("Retained") + F.col("Discarded")
    percent = F.concat(fixed(ratio(F.col("Discarded"), total) * 100, 1), F.lit("%"))
    return wide.orderBy("Area", "Year").select(
        "Area",
        "Year",
        fixed(F.col("Discarded"), 0).alias("Discarded"),
        fixed(F.col("Retained"), 0).alias("Retained"),
        fixed(total, 0).alias("Total catch"),
        percent.alias("Percent discarded"),
    )


def discard_rate(catch: DataFrame) -> DataFrame:
    dropped = F.col("retained_or_discarded") == "D"
    sums = with_complex(catch).groupBy("complex", "year").agg(
        strict_sum_where(dropped, "tons", 0.0).alias("d"), strict_sum("tons").alias("t")
    )
    return sums.select("complex", "year", ratio("d", "t").alias("discard_rate"))


def discard_rate_summary(catch: DataFrame) -> DataFrame:
    return (
        discard_rate(catch)
        .groupBy("complex")
        .agg(
            strict_mean("discard_rate").alias("mean_discard_rate"),
            F.stddev_samp("discard_rate").alias("sd_discard_rate"),
        )
    )


def discard_complete(catch: DataFrame) -> DataFrame:
    status = either(F.col("retained_or_discarded") == "D", F.lit("Discarded"), F.lit("Retained"))
    sums = yearly(
        with_complex(catch), "fmp_subarea", "complex", "year", status.alias("retained_or_discarded")
    )
    keys = ["year", "fmp_subarea", "complex", "retained_or_discarded"]
    return complete(sums, keys, {"catch": 0.0}).withColumn(
        "complex_order", ordinal(F.col("complex"), COMPLEX_ORDER)
    )


# --- relations, maps, extracts ---------------------------------------------
ATKA = "Atka mackerel"


def normalized_catch_relation(
    directed: DataFrame, catch: DataFrame, area: int = 541, low: float = -1.0, high: float = 1.0
) -> DataFrame:
    """Directed catch and non-SST catch of one area, each scaled to [low, high].

    A series that never changes is put in the middle.
    """
    columns = ["year", "nmfs_area", "complex", "tons"]
    bycatch = with_complex(catch).filter((F.col("fmp_subarea") == "AI") & (F.col("complex") == NON_SST))
    both = directed.withColumn("complex", F.lit(ATKA)).select(*columns).unionByName(bycatch.select(*columns))
    sums = yearly(
        both.filter(F.col("nmfs_area") == area).withColumn("nmfs_area2", F.lit(KEY_AREAS[area])),
        "complex",
        "year",
        "nmfs_area2",
    )
    full = complete(sums, ["year", "nmfs_area2", "complex"], {"catch": 0.0})
    one = W.partitionBy("complex", "nmfs_area2")
    least, most = F.min("catch").over(one), F.max("catch").over(one)
    position = ratio(F.col("catch") - least, most - least)
    scaled = F.when(most == least, F.lit((low + high) / 2)).otherwise(position * (high - low) + low)
    return full.withColumn("norm_catch", scaled)


def normalized_catch_correlation(relation: DataFrame) -> DataFrame:
    wide = pivot_wider(relation, ["nmfs_area2", "year"], "complex", "norm_catch", [ATKA, NON_SST])
    return wide.groupBy("nmfs_area2").agg(F.corr(ATKA, NON_SST).alias("correlation"))


def catch_export(catch: DataFrame) -> DataFrame:
    return classify_fishery(catch).select("year", "date", "nmfs_area", "target_fishery")


# fixed values: the maps and the species each covers
MAPS = {COMPLEX: None, "Non-SST": NON_SST, "SST": SST}


def catch_by_map_area(
    catch: DataFrame, areas: DataFrame, years: Sequence[int] | None = None
) -> DataFrame:
    """Catch by reporting area for each map, for all listed areas."""
    if years is not None:
        catch = catch.filter(F.col("year").isin(list(years)))
    group = complex_of_name()
    sums = [
        (strict_sum("tons") if value is None else strict_sum_where(group == value, "tons")).alias(name)
        for name, value in MAPS.items()
    ]
    wide = catch.groupBy(F.col("nmfs_area").alias("REP_AREA")).agg(*sums)
    listed = areas.select(F.col("nmfs_area").alias("REP_AREA")).distinct()
    return listed.join(wide, "REP_AREA", "left").unpivot("REP_AREA", list(MAPS), "map", "catch")


def observer_points(observed: DataFrame, years: Sequence[int], wrap: str = "west") -> DataFrame:
    """Positions of hauls on one side of the date line, with a class of area.

    'west' puts all longitudes below 0, 'east' all above.
    """
    lon = F.col("londd_start")
    if wrap == "west":
        lon = F.when(lon > 0, lon - 360).otherwise(lon)
        group = either(F.col("nmfs_area") > 600, F.lit(2), F.lit(4))
    else:
        lon = F.when(lon < 0, lon + 360).otherwise(lon)
        group = either(F.col("nmfs_area") == 610, F.lit(4), F.lit(6))
    return observed.filter(
        F.col("year").isin(list(years))
        & F.col("londd_start").isNotNull()
        & F.col("latdd_start").isNotNull()
    ).select(
        lon.alias("lon"),
        F.col("latdd_start").alias("lat"),
        "haul_join",
        F.col("extrapolated_weight").alias("catch"),
        "year",
        "nmfs_area",
        group.alias("fmp"),
    )
