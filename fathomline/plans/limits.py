"""Combined uncertainty, catch limits, apportionment and model comparison.

These tables come after the model: a few rows per stock, region and year.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.functions import ratio, strict_mean, strict_sum, strict_sum_over, strict_sum_where
from fathomline.functions.distributions import t_two_sided
from fathomline.operators import exact_quantiles, grid, pivot_wider, unpivot_longer
from fathomline.plans.labels import (
    ABC_SHARE,
    COMPLEX,
    COMPLEX_TOTAL,
    NATURAL_MORTALITY,
    NON_SST,
    SST,
    Z_EXACT,
    Z_ROUNDED,
    ai_or_ebs,
    complex_of_name,
    mortality,
    ordinal,
)
from fathomline.session import settled

# --- combined uncertainty --------------------------------------------------


def combine_ci(states: DataFrame, z: float = Z_ROUNDED) -> DataFrame:
    """Estimate and log-normal interval by species and FMP, by species, and in total.

    The three levels are grouping sets over one pass: the parts of the delta-method
    formula add up. ``level`` is 'fmp', 'species' or 'total'.
    """
    m, s2 = F.col("biomsd"), F.col("biomsd_sd") * F.col("biomsd_sd")
    cells = states.select("species", "year", ai_or_ebs(F.col("region")).alias("FMP"), "re_est", m, s2.alias("s2"))
    numerator = F.exp(2 * m + F.col("s2")) * (F.exp(F.col("s2")) - 1)
    denominator = F.exp(m + 0.5 * F.col("s2"))
    sums = cells.groupingSets(
        [["species", "year", "FMP"], ["species", "year"], ["year"]], "species", "year", "FMP"
    ).agg(
        F.grouping_id().alias("gid"),
        strict_sum("re_est").alias("est"),
        strict_sum(numerator).alias("numer"),
        strict_sum(denominator).alias("denom"),
    )
    sd = F.sqrt(F.log(ratio(F.col("numer"), F.col("denom") * F.col("denom")) + 1))
    level = (
        F.when(F.col("gid") == 0, F.lit("fmp")).when(F.col("gid") == 1, F.lit("species")).otherwise(F.lit("total"))
    )
    return sums.select(
        level.alias("level"),
        F.when(F.col("gid") > 1, F.lit(COMPLEX_TOTAL)).otherwise(F.col("species")).alias("species"),
        "year",
        "FMP",
        "est",
        sd.alias("sd"),
        F.exp(F.log("est") - z * sd).alias("lci"),
        F.exp(F.log("est") + z * sd).alias("uci"),
    )


def fmp_estimates(combined: DataFrame) -> DataFrame:
    rows = combined.filter(F.col("level") == "fmp")
    return rows.select("species", "year", "FMP", F.col("est").alias("fmp_est"))


def species_estimates(combined: DataFrame) -> DataFrame:
    rows = combined.filter(F.col("level") == "species")
    return rows.select("species", "year", F.col("est").alias("re_est"))


def at_last_year(df: DataFrame, year: str = "year") -> DataFrame:
    """Rows of the latest year."""
    return df.filter(F.col(year) == df.agg(F.max(year).alias("y")).scalar())


# --- specifications --------------------------------------------------------
def tier5_specs(total: DataFrame, fmp: DataFrame, year: int) -> DataFrame:
    """Limits of one year: F_OFL = M, F_ABC = 0.75 M, split by the FMP share of biomass."""
    m = F.col("M")
    specs = (
        total.filter(F.col("year") == year)
        .withColumn("M", mortality(F.col("species")))
        .withColumns({"F_OFL": m, "maxF_ABC": ABC_SHARE * m, "F_ABC": ABC_SHARE * m})
        .withColumns(
            {
                "OFL": F.col("re_est") * F.col("F_OFL"),
                "maxABC": F.col("re_est") * F.col("maxF_ABC"),
                "ABC": F.col("re_est") * F.col("F_ABC"),
            }
        )
    )
    fraction = ratio("fmp_est", "re_est")
    return specs.join(fmp.filter(F.col("year") == year).drop("year"), "species", "left").select(
        "species",
        "FMP",
        "M",
        F.col("re_est").alias("Biomass"),
        "F_OFL",
        "maxF_ABC",
        "F_ABC",
        "OFL",
        "maxABC",
        "ABC",
        (fraction * F.col("ABC")).alias("FMP_ABC"),
        (fraction * F.col("OFL")).alias("FMP_OFL"),
    )


# fixed values: the variables of the specification table in its order
SPECS_VARIABLES = ["M", "Biomass", "F_OFL", "maxF_ABC", "F_ABC", "OFL", "maxABC", "ABC", "AI ABC", "EBS ABC"]
ADDED_UP = ["Biomass", "OFL", "maxABC", "ABC", "AI ABC", "EBS ABC"]
SPECIES_ORDER = [SST, NON_SST, COMPLEX]


def specs_long(specs: DataFrame) -> DataFrame:
    """Species, variable, value with complex totals; rates of the complex are missing."""
    own = [v for v in SPECS_VARIABLES if v not in ("AI ABC", "EBS ABC")]
    by_species = unpivot_longer(specs.select("species", *own).distinct(), ["species"], own, "Variable", "Value")
    by_fmp = specs.select(
        "species", F.concat_ws(" ", "FMP", F.lit("ABC")).alias("Variable"), F.col("FMP_ABC").alias("Value")
    )
    long = by_species.unionByName(by_fmp)
    sums = (
        long.filter(F.col("Variable").isin(ADDED_UP))
        .groupBy("Variable")
        .agg(strict_sum("Value").alias("Value"))
    )
    rates = grid(specs.sparkSession, Variable=[v for v in own if v not in ADDED_UP]).withColumn(
        "Value", F.lit(None).cast("double")
    )
    complex_rows = sums.unionByName(rates).withColumn("species", F.lit(COMPLEX))
    return (
        long.unionByName(complex_rows)
        .select(
            F.col("species").alias("Species"),
            "Variable",
            "Value",
            ordinal(F.col("species"), SPECIES_ORDER).alias("species_order"),
            ordinal(F.col("Variable"), SPECS_VARIABLES).alias("variable_order"),
        )
        .orderBy("species_order", "variable_order")
    )


def specs_crossfoot(fmp: DataFrame, year: int) -> DataFrame:
    """Biomass of one year with its sums by species and by FMP and its share of the species."""
    rows = fmp.filter(F.col("year") == year).select("species", "year", "FMP", F.col("fmp_est").alias("biom"))
    return rows.select(
        "*",
        strict_sum_over("biom", W.partitionBy("species")).alias("species_biomass"),
        strict_sum_over("biom", W.partitionBy("FMP")).alias("fmp_biomass"),
    ).withColumn("fmp_share", ratio("biom", "species_biomass"))


def specs_ofl_check(specs: DataFrame) -> DataFrame:
    """OFL by FMP and in total (FMP missing), which should equal the sum of species OFLs."""
    by_fmp = specs.groupBy("FMP").agg(strict_sum("FMP_OFL").alias("OFL"))
    return by_fmp.rollup("FMP").agg(strict_sum("OFL").alias("OFL"))


# --- limits by model -------------------------------------------------------
def totals_by_model(biomass: DataFrame) -> DataFrame:
    """Predicted biomass over all strata by group, model and year."""
    return biomass.groupBy("species_group", "model_name", "year").agg(strict_sum("pred").alias("pred"))


def abc_ofl_by_group(totals: DataFrame, year: int | None = None) -> DataFrame:
    """Limits of one year (the last one, unless given) by group and model."""
    rows = at_last_year(totals) if year is None else totals.filter(F.col("year") == year)
    m = mortality(F.col("species_group"))
    return rows.select("species_group", "model_name", "year", F.col("pred").alias("biomass"), m.alias("M")).withColumns(
        {"OFL": F.col("biomass") * F.col("M"), "maxABC": F.col("biomass") * (ABC_SHARE * F.col("M"))}
    )


def abc_ofl_summary(
    by_group: DataFrame, status_quo: str, override: Mapping[str, float] | None = None
) -> DataFrame:
    """Complex limits by model with percent change from the status quo model.

    ``override`` replaces the biomass of a model by a given value first.
    """
    sums = by_group.groupBy("model_name", "year").agg(
        *[strict_sum(c).alias(c) for c in ("biomass", "OFL", "maxABC")]
    )
    for model, value in (override or {}).items():
        fixed = F.when(F.col("model_name") == model, F.lit(float(value))).otherwise(F.col("biomass"))
        sums = sums.withColumn("biomass", fixed)
    # one row per model in a year
    year = W.partitionBy("year")

    def change(column):
        before = F.max(F.when(F.col("model_name") == status_quo, F.col(column))).over(year)
        return ratio(F.col(column) - before, before) * 100

    return sums.select(
        "*",
        change("biomass").alias("biomass_percent_change"),
        change("OFL").alias("OFL_maxABC_percent_change"),
    )


def apportionment(biomass: DataFrame, year: int | None = None) -> DataFrame:
    """Limits by group, model and FMP with the FMP share of the group's biomass."""
    rows = at_last_year(biomass) if year is None else biomass.filter(F.col("year") == year)
    sums = rows.groupBy("species_group", "model_name", ai_or_ebs(F.col("strata")).alias("fmp")).agg(
        strict_sum("pred").alias("biomass")
    )
    group = W.partitionBy("model_name", "species_group")
    return (
        sums.withColumn("M", mortality(F.col("species_group")))
        .withColumns(
            {
                "species_fmp_ABC": F.col("biomass") * (ABC_SHARE * F.col("M")),
                "species_fmp_OFL": F.col("biomass") * F.col("M"),
                "total_biomass": strict_sum_over("biomass", group),
            }
        )
        .withColumn("prop_biomass", ratio("biomass", "total_biomass"))
    )


def apportionment_pct(apportioned: DataFrame) -> DataFrame:
    """Percent of the complex ABC by model and FMP, one column per FMP."""
    abc = F.col("species_fmp_ABC")
    sums = apportioned.groupBy("model_name").agg(
        *[strict_sum_where(F.col("fmp") == f, abc).alias(f) for f in ("AI", "EBS")], strict_sum(abc).alias("all")
    )
    return sums.select("model_name", *[(ratio(F.col(f), F.col("all")) * 100).alias(f) for f in ("AI", "EBS")])


# --- catch against limits --------------------------------------------------
NAME_ORDER = ["Catch", "ABC", "OFL"]


def _catch(catch: DataFrame, *keys) -> DataFrame:
    return catch.groupBy("year", *keys).agg(strict_sum("tons").alias("Catch"))


def _long(wide: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    order = [*names[-1:], *names[:-1]]
    long = unpivot_longer(wide, ids, names)
    return long.withColumn("name_order", ordinal(F.col("name"), order))


def catch_vs_limits_fmp(apportioned: DataFrame, catch: DataFrame) -> DataFrame:
    """Catch, ABC* and OFL* by FMP, species and year (``apportioned`` of one model)."""
    limits = apportioned.select(
        F.col("species_group").alias("species"),
        F.col("fmp").alias("FMP"),
        F.col("species_fmp_ABC").alias("ABC*"),
        F.col("species_fmp_OFL").alias("OFL*"),
    )
    yearly = _catch(catch, F.col("fmp_subarea").alias("FMP"), complex_of_name().alias("species"))
    return _long(
        limits.join(yearly, ["species", "FMP"], "left"), ["species", "FMP", "year"], ["ABC*", "OFL*", "Catch"]
    )


def catch_vs_limits_species(by_group: DataFrame, catch: DataFrame) -> DataFrame:
    limits = by_group.select(F.col("species_group").alias("species"), F.col("maxABC").alias("ABC"), "OFL")
    yearly = _catch(catch, complex_of_name().alias("species"))
    return _long(limits.join(yearly, "species", "left"), ["species", "year"], ["ABC", "OFL", "Catch"])


def catch_vs_limits_total(by_group: DataFrame, catch: DataFrame) -> DataFrame:
    """Limits of the complex beside its yearly catch; one row of limits serves all years."""
    rows = by_group.select("species_group", F.col("maxABC").alias("ABC"), "OFL").distinct()
    limits = rows.agg(F.struct(strict_sum("ABC").alias("ABC"), strict_sum("OFL").alias("OFL"))).scalar()
    yearly = catch.groupBy("year").agg(strict_sum("tons").alias("Catch")).withColumn("limits", limits)
    wide = yearly.select(F.lit(COMPLEX).alias("species"), "year", "limits.ABC", "limits.OFL", "Catch")
    return _long(wide, ["species", "year"], ["ABC", "OFL", "Catch"])


def group_percent(
    amounts: DataFrame, group: str, amount: str, keep: str = SST, first: int | None = None, before: int | None = None
) -> DataFrame:
    """Yearly percent of one group, with mean, least and largest over the years kept."""
    hit = F.col(group) == keep
    yearly = (
        amounts.groupBy("year")
        .agg(
            F.count(F.when(hit, 1)).alias("seen"),
            strict_sum_where(hit, amount).alias("amount"),
            strict_sum(amount).alias("total"),
        )
        .filter(F.col("seen") > 0)
        .drop("seen")
        .withColumn("percent", ratio(100 * F.col("amount"), F.col("total")))
    )
    if before is not None:
        yearly = yearly.filter(F.col("year") < before)
    if first is not None:
        yearly = yearly.filter(F.col("year") >= first)
    yearly = settled(yearly)
    stats = yearly.agg(
        F.struct(
            strict_mean("percent").alias("mean_percent"),
            F.min("percent").alias("min_percent"),
            F.max("percent").alias("max_percent"),
        )
    ).scalar()
    return yearly.withColumn("s", stats).select("year", "amount", "total", "percent", "s.*")


def catch_biomass_ratio(apportioned: DataFrame, catch: DataFrame, biomass: DataFrame) -> DataFrame:
    """Catch over predicted biomass by species, FMP and year (one model throughout)."""
    limits = apportioned.select(
        F.col("species_group").alias("species"), F.col("fmp").alias("FMP"), F.col("M").alias("F_OFL")
    )
    yearly = _catch(catch, F.col("fmp_subarea").alias("FMP"), complex_of_name().alias("species"))
    sums = biomass.groupBy(
        F.col("species_group").alias("species"), "year", ai_or_ebs(F.col("strata")).alias("FMP")
    ).agg(strict_sum("pred").alias("biomass"))
    return (
        limits.join(yearly, ["species", "FMP"], "left")
        .join(sums, ["species", "year", "FMP"], "left")
        .withColumn("ratio", ratio("Catch", "biomass"))
    )


def mean_ratio(ratios: DataFrame) -> DataFrame:
    return ratios.groupBy("FMP", "species").agg(strict_mean("ratio").alias("mean_ratio"))


def pooled_ratio(ratios: DataFrame) -> DataFrame:
    """Percent of the biomass of both FMPs together that was caught."""
    sums = ratios.groupBy("species", "year").agg(strict_sum("Catch").alias("c"), strict_sum("biomass").alias("b"))
    return sums.select("species", "year", (ratio("c", "b") * 100).alias("ratio"))


# --- archive tables --------------------------------------------------------
def sara_biomass(totals: DataFrame, first_year: int = 1991) -> DataFrame:
    """Group biomass by year with total, SST share and mortality weighted by share."""
    wide = pivot_wider(totals.filter(F.col("year") >= first_year), ["year"], "species_group", "pred", [SST, NON_SST])
    sst_m, other_m = NATURAL_MORTALITY[SST], NATURAL_MORTALITY[NON_SST]
    return (
        wide.withColumn("total", F.col(SST) + F.col(NON_SST))
        .withColumn("p_SST", ratio(SST, "total"))
        .withColumns({"SST_M": F.lit(sst_m), "nonSST_M": F.lit(other_m)})
        .withColumn("weighted_M", F.col("SST_M") * F.col("p_SST") + F.col("nonSST_M") * (1 - F.col("p_SST")))
    )


def sara_survey(strata: DataFrame, regions: Sequence[str], first_year: int = 1991) -> DataFrame:
    """Survey biomass with a row per year and a column per area."""
    rows = strata.filter(F.col("year") >= first_year)
    columns = [strict_sum_where(F.col("region") == r, "biomass").alias(r) for r in regions]
    return rows.groupBy("year").agg(*columns)


def sara_survey_by_area(strata: DataFrame, years: Sequence[int]) -> DataFrame:
    """The other shape: SBS counts as AI, a row per area and a column per year."""
    region = F.when(F.col("region") == "SBS", F.lit("AI")).otherwise(F.col("region"))
    columns = [strict_sum_where(F.col("year") == y, "biomass").alias(str(y)) for y in years]
    return strata.groupBy(region.alias("area")).agg(*columns)


def sara_exploitation(catch: DataFrame, sara: DataFrame) -> DataFrame:
    """Yearly catch over total biomass."""
    yearly = catch.groupBy("year").agg(strict_sum("tons").alias("catch"))
    biomass = sara.select("year", F.col("total").alias("biomass"))
    return yearly.join(biomass, "year", "left").withColumn("exploitation", ratio("catch", "biomass"))


def sara_annual_catch(catch: DataFrame) -> DataFrame:
    """Yearly catch in whole tonnes, halves to even."""
    return catch.groupBy("year").agg(F.bround(strict_sum("tons"), 0).alias("catch"))


# --- model comparison ------------------------------------------------------
def model_compare_pct(biomass: DataFrame, base: str, other: str, signed: bool = False) -> DataFrame:
    """Percent difference of two models by group, stratum and year."""
    wide = pivot_wider(biomass, ["species_group", "strata", "year"], "model_name", "pred", [base, other])
    difference = ratio(F.col(other) - F.col(base), F.col(base)) * 100
    return wide.withColumn("percent_difference", difference if signed else F.abs(difference))


SUMMARY = ["min", "q1", "median", "mean", "q3", "max"]


def five_numbers(df: DataFrame, column: str) -> DataFrame:
    """Least, quartiles, mean and largest value as rows (statistic, value)."""
    df = settled(df.select(column))
    quartiles = exact_quantiles(df, column, [0.0, 0.25, 0.5, 0.75, 1.0])
    name = (
        F.when(F.col("prob") == 0.0, "min")
        .when(F.col("prob") == 0.25, "q1")
        .when(F.col("prob") == 0.5, "median")
        .when(F.col("prob") == 0.75, "q3")
        .otherwise("max")
    )
    mean = df.agg(F.avg(column).alias("value")).select(F.lit("mean").alias("statistic"), "value")
    return quartiles.select(name.alias("statistic"), F.col("quantile").alias("value")).unionByName(mean)


def model_total_table(totals: DataFrame, models: Sequence[str]) -> DataFrame:
    """Year by model totals for each group and for both together as Total."""
    label = F.explode(F.array(F.col("species_group"), F.lit("Total")))
    rows = totals.withColumn("species_group", label)
    columns = [strict_sum_where(F.col("model_name") == m, "pred").alias(m) for m in models]
    return rows.groupBy("species_group", "year").agg(*columns).orderBy("species_group", "year")


def stratum_share(biomass: DataFrame, model: str, group: str, stratum: str) -> DataFrame:
    """One stratum of one group as a share of everything, by year."""
    one = (F.col("species_group") == group) & (F.col("strata") == stratum)
    sums = (
        biomass.filter(F.col("model_name") == model)
        .groupBy("year")
        .agg(strict_sum("pred").alias("total_biom"), strict_sum_where(one, "pred").alias("stratum_biom"))
    )
    return sums.withColumn("p", ratio("stratum_biom", "total_biom"))


def index_correlation(years: DataFrame, biomass: DataFrame, index: DataFrame, z: float = Z_EXACT) -> DataFrame:
    """Pearson correlation of biomass and index over common years, with its test.

    t has n-2 degrees of freedom; the interval is Fisher's.
    """
    pairs = years.join(index.select("year", "cpue"), "year", "left").join(
        biomass.select("year", "biomass"), "year", "left"
    )
    both = F.col("cpue").isNotNull() & F.col("biomass").isNotNull()
    r, n = F.col("r"), F.col("n")
    half = F.lit(z) / F.sqrt(n - 3)
    return (
        pairs.filter(both)
        .agg(F.corr("biomass", "cpue").alias("r"), F.count(F.lit(1)).alias("n"))
        .select(
            "r",
            "n",
            (n - 2).alias("df"),
            (r * F.sqrt(ratio(n - 2, 1 - r * r))).alias("t"),
            F.when(n > 3, F.tanh(F.atanh(r) - half)).alias("lci"),
            F.when(n > 3, F.tanh(F.atanh(r) + half)).alias("uci"),
        )
        .withColumn("p_value", F.when(F.col("df") > 0, t_two_sided(F.col("t"), F.col("df"))))
    )
