import math
import re

import pytest
from pyspark.sql import functions as F

import golden
from fathomline.plans import catch as c
from fathomline.plans import extraction as x
from fathomline.plans import lengths as g
from fathomline.plans import limits as l
from fathomline.plans import report
from fathomline.plans import survey as b
from fathomline.plans.labels import KEY_AREAS

CATCH = (
    "year INT, fmp STRING, fmp_subarea STRING, nmfs_area INT, gear STRING, retained_or_discarded STRING,"
    " target STRING, species_name STRING, tons DOUBLE"
)


@pytest.fixture(scope="module")
def catch(spark):
    data = [
        (2003, "BSAI", "AI", 541, "NPT", "R", "Rockfish", "thornyhead", 10.0),
        (2003, "BSAI", "EBS", 521, "HAL", "D", "Sablefish", "dusky", 5.0),
        (2004, "BSAI", "EBS", 517, "TRW", "R", "Pacific Cod", "harlequin", 2.5),
        (2004, "BSAI", "AI", 542, "JIG", "D", "Squid", "silvergray", 0.5),
        (2004, "BSAI", "AI", 543, "POT", "D", None, "thornyhead", 4.0),
    ]
    return spark.createDataFrame(data, CATCH)


@pytest.fixture(scope="module")
def prop(spark):
    return spark.createDataFrame([(2003, "AI", 0.75)], "year INT, fmp_subarea STRING, prop_sst DOUBLE")


@pytest.fixture(scope="module")
def split(catch, prop):
    return x.allocate_by_proportion(catch, prop)


# --- extraction --------------------------------------------------------------
def test_allocation_conserves_tons_where_known(catch, prop, split, rows):
    year = split.filter("year = 2003")
    assert year.agg(F.sum("tons")).first()[0] == 15.0
    assert rows(year.filter("species_name LIKE '%SST%'"), "species_name", "tons") == [("SST", 7.5)]
    lost = split.filter("year = 2004 AND species_name IN ('SST', 'other thornyheads')")
    assert rows(lost, "species_name", "tons") == [("SST", None), ("other thornyheads", None)]
    aggregated = x.allocate_by_proportion(catch, prop, aggregated=True)
    assert rows(aggregated) == rows(split)


def test_proportion_from_one_table_and_from_two(spark, rows):
    hauls = spark.createDataFrame(
        [(1, 540, 2003, "X"), (2, 541, 2003, "X"), (3, 499, 2003, "X"), (4, 541, 2004, "X")],
        "haul_join INT, nmfs_area INT, year INT, gear_type STRING",
    )
    parts = spark.createDataFrame(
        [(1, 350, 3.0), (1, 349, 1.0), (2, 350, 1.0), (2, 352, 1.0), (3, 350, 9.0), (4, 349, 2.0), (2, 1, 50.0)],
        "haul_join INT, species INT, extrapolated_weight DOUBLE",
    )
    one = x.class_proportion(x.observer_join(parts, hauls, [349, 350, 352], (500, 543)))
    two = x.class_proportion_of_hauls(parts, hauls, [349, 350, 352], (500, 543))
    # area 540 counts as EBS; a year without the species has no row
    assert rows(one) == rows(two) == [(2003, "AI", 0.5), (2003, "EBS", 0.75)]
    assert rows(x.haul_count_check(parts, hauls, 350, 1)) == [(2003, "X", 3)]


def test_line_index_skips_missing_values(spark, rows):
    lls = spark.createDataFrame(
        [
            ("NE Aleutians slope", "United States", 2000, 3.0, 9.0),
            ("SE Aleutians slope", "United States", 2000, None, None),
            ("NW Aleutians slope", "United States", 2000, 100.0, 1.0),
            (None, "United States", 2000, 2.0, 4.0),
            ("Bering 2 slope", "Japan", 2000, 50.0, 1.0),
        ],
        "geographic_area_name STRING, country STRING, year INT, rpw DOUBLE, rpw_var DOUBLE",
    )
    assert rows(x.lls_index(lls)) == [("EBS Slope", 2000, 2.0, 1.0), ("Eastern AI", 2000, 3.0, 1.0)]


def test_a_haul_with_a_third_of_all_rows(spark, rows):
    hauls = spark.range(40).selectExpr(
        "CAST(id AS INT) AS haul_join", "CAST(500 + id AS INT) AS nmfs_area", "2003 AS year", "'X' AS gear_type"
    )
    parts = spark.range(6000).selectExpr(
        "CAST(IF(id % 3 = 0, 7, id % 40) AS INT) AS haul_join", "CAST(349 + id % 2 AS INT) AS species",
        "CAST(id % 5 AS DOUBLE) AS extrapolated_weight",
    )
    one = x.class_proportion(x.observer_join(parts, hauls, [349, 350], (500, 543)))
    two = x.class_proportion_of_hauls(parts, hauls, [349, 350], (500, 543))
    assert rows(one) == rows(two) and len(rows(one)) == 1
    joined = x.class_proportion_of_hauls(parts, hauls, [349, 350], (500, 543))
    assert joined._jdf.queryExecution().executedPlan().toString().count("partial_sum") >= 2


# --- survey ------------------------------------------------------------------
def test_zero_biomass_and_cv(spark, rows):
    data = [
        ("AI", 2000, 30020, 4.0, 4.0, "Western AI"), ("AI", 2000, 30020, 6.0, 5.0, "Eastern AI"),
        ("AI", 2000, 1, 0.0, 0.0, "SBS"), ("EBS_SHELF", 2000, 1, None, 1.0, "EBS Shelf"),
    ]
    df = spark.createDataFrame(
        data, "survey STRING, year INT, species_code INT, biomass DOUBLE, var DOUBLE, area STRING"
    )
    assert rows(b.biomass_strata(df)) == [
        ("SST", "AI", 2000, 10.0, 9.0, 0.3), ("non-SST", "EBS_SHELF", 2000, None, 1.0, None),
        ("non-SST", "SBS", 2000, 0.0, 0.0, 0.0),
    ]
    assert ("non-SST", "SBS", 2000, 0.0, 0.0, None) in rows(b.biomass_strata(df, "area", "null"))
    ci = {r["region"]: r for r in b.survey_ci(b.biomass_strata(df)).collect()}
    assert ci["AI"]["lci"] == pytest.approx(10 - 1.96 * 3) and ci["EBS_SHELF"]["lci"] is None


# --- catch tables ------------------------------------------------------------
def test_percent_table_adds_up(split):
    known = split.filter("tons IS NOT NULL")
    got = {r["Target fishery"]: r for r in c.gear_target_pct(known).collect()}
    assert got["Total"]["Total"] == "100"
    assert got["Other"]["Jig"] == "2.8" and got["Rockfish"]["Bottom trawl"] == "55.6"
    assert got["Rockfish"]["Pot"] == "0"


def test_missing_tons_spread(split):
    wide = {r["Year"]: r for r in c.catch_by_fmp(split).collect()}
    assert wide[2003]["BSAI"] == 15.0 and wide[2004]["BSAI"] is None and wide[2004]["EBS"] == 2.5


def test_detail_table_has_a_total_row(split):
    known = split.filter("tons IS NOT NULL")
    got = c.detailed_catch_byarea(known, [541, 521, 517, 542]).collect()
    assert got[-1]["Gear"] == "Total (t)" and got[-1]["Target fishery"] is None
    assert (got[-1]["541"], got[-1]["Total (t)"], got[-1]["% of total"]) == ("10", "18", "100")
    assert got[0]["Total (t)"] == "10" and got[0]["Gear"] == "Bottom trawl"


def test_discards_need_both_parts(catch):
    got = {(r["Area"], r["Year"]): r for r in c.discard_table(catch).collect()}
    assert got["AI", 2003]["Total catch"] == "NA" and got["AI", 2003]["Percent discarded"] == "NA%"
    assert got["AI", 2003]["Discarded"] == "NA"


def test_classes(catch):
    got = {r["species_name"] + str(r["year"]): r for r in c.classify_fishery(catch).collect()}
    assert got["silvergray2004"]["target_fishery"] == "Other"
    assert got["thornyhead2004"]["target_fishery"] == "Other"
    assert got["harlequin2004"]["gear_name"] == "Bottom trawl"


def test_top_fisheries_keep_ties(spark):
    gears = ["NPT", "PTR", "POT", "HAL", "JIG"]
    data = [(2000, "AI", g, t, "dusky", v) for g, t, v in zip(
        gears + gears, ["Rockfish"] * 5 + ["Halibut"] * 5, [9, 8, 7, 6, 5, 5, 5, 1, 1, 1]
    )]
    df = spark.createDataFrame(data, "year INT, fmp_subarea STRING, gear STRING, target STRING, species_name STRING, tons INT")
    got = {r["fishery"]: r for r in c.top_fisheries(df).collect()}
    assert sum(r["top"] == "top" for r in got.values()) == 7
    assert got["Halibut Pot"]["plot_fishery"] == "Other fixed gear"


def test_area_grid_has_both_groups(catch):
    only = catch.filter("species_name = 'dusky'")
    got = c.catch_complex_area(only).collect()
    assert {(r["nmfs_area2"], r["complex"], r["catch"]) for r in got} == {
        (KEY_AREAS[521], "SST", 0.0), (KEY_AREAS[521], "non-SST", 5.0),
    }


def test_rescale_of_a_constant_series(spark, rows):
    schema = "year INT, fmp_subarea STRING, nmfs_area INT, species_name STRING, tons DOUBLE"
    bycatch = spark.createDataFrame([(2000, "AI", 541, "dusky", 1.0), (2001, "AI", 541, "dusky", 3.0)], schema)
    directed = spark.createDataFrame([(2000, "AI", 541, "atka", 4.0), (2001, "AI", 541, "atka", 4.0)], schema)
    got = {(r["complex"], r["year"]): r["norm_catch"] for r in c.normalized_catch_relation(directed, bycatch).collect()}
    assert got["non-SST", 2000] == -1.0 and got["non-SST", 2001] == 1.0 and got["Atka mackerel", 2000] == 0.0


def test_positions(spark, rows):
    data = [(1, 2015, 170.0, 50.0, 610, 1.0), (2, 2015, -170.0, 51.0, 541, 2.0), (3, 2015, None, 5.0, 541, 3.0)]
    df = spark.createDataFrame(
        data,
        "haul_join INT, year INT, londd_start DOUBLE, latdd_start DOUBLE, nmfs_area INT, extrapolated_weight DOUBLE",
    )
    assert rows(c.observer_points(df, [2015]), "lon", "fmp") == [(-170.0, 4), (-190.0, 2)]
    assert rows(c.observer_points(df, [2015], "east"), "lon", "fmp") == [(170.0, 4), (190.0, 6)]


def test_catch_report(catch, prop, split):
    known = split.filter("tons IS NOT NULL")
    lines = report.catch_report(known, prop, [541, 521, 517, 542], "source", "2022-10-03")
    got = [r["line"] for r in lines.orderBy("section", "row_no").collect()]
    assert got[1].endswith("queried 2022-10-03") and "Year,BSAI,AI,EBS" in got
    assert "2003,15,10,5" in got and any(re.match(r"Total,.*,100$", line) for line in got)
    assert sum(line.startswith("Sum of total catch") for line in got) == 4


def test_observer_years_and_columns(spark, rows):
    composition = spark.createDataFrame(
        [(1, 350, 5.0, 2002), (1, 349, 5.0, 2003), (2, 350, 1.0, 2003)],
        "HAUL_JOIN LONG, SPECIES INT, EXTRAPOLATED_WEIGHT DOUBLE, YEAR INT",
    )
    hauls = spark.createDataFrame([(1, 541, 2003), (2, 541, 2003)], "haul_join LONG, nmfs_area INT, year INT")
    joined = x.observer_join(composition, hauls, [349, 350], first_year=2003, columns=["haul_join", "year", "nmfs_area"])
    assert rows(joined) == [(1, 2003, 541), (2, 2003, 541)]
    share = x.class_proportion_of_hauls(composition, hauls, [349, 350], (500, 543), first_year=2003)
    assert rows(share) == [(2003, "AI", pytest.approx(1 / 6))]


def test_biomass_report(spark):
    survey = spark.createDataFrame(
        [("SST", "AI", 2000, 10.0, 4.0, 6.08, 13.92), ("SST", "SBS, west", 2000, None, None, None, None)],
        "species STRING, region STRING, year INT, biomass DOUBLE, var DOUBLE, lci DOUBLE, uci DOUBLE",
    )
    model = spark.createDataFrame(
        [("SST", "AI", 2000, 10.5, 2.35, 0.1), ("SST", "SBS", 2000, 2.0, 0.69, 0.2), ("non-SST", "SBS", 2000, 4.0, 1.39, 0.2)],
        "species STRING, region STRING, year INT, re_est DOUBLE, biomsd DOUBLE, biomsd_sd DOUBLE",
    )
    regions = model.select("species", "region", "year", "re_est")
    lines = report.biomass_report(survey, regions, l.combine_ci(model), "surveys", "2022-10-03")
    got = [r["line"] for r in lines.orderBy("section", "row_no").collect()]
    assert got[:2] == ["Biomass tables", "Surveys from surveys, queried 2022-10-03"]
    at = got.index("species,region,year,biomass,var,lci,uci")
    assert got[at + 1 : at + 3] == ["SST,AI,2000,10,4,6.08,13.92", 'SST,"SBS, west",2000,NA,NA,NA,NA']
    at = got.index("species,region,year,re_est")
    assert got[at + 1 : at + 4] == ["SST,AI,2000,10.5", "SST,SBS,2000,2", "non-SST,SBS,2000,4"]
    assert [line.split(",")[1] for line in got[got.index("year,est,lci,uci") + 1 :]] == ["16.5"]


def test_report_ties_do_not_hang_on_the_order_of_a_sum(spark):
    # 594668.3285 as three orders of the same sum give it
    sums = [594668.3284999998, 594668.3285, 594668.3285000001, -594668.3284999998, 0.12349, None]
    df = spark.createDataFrame(list(enumerate(sums)), "k INT, est DOUBLE").orderBy("k")
    got = [r["line"] for r in report.table_section(1, "t", df, 3).filter("block = 1").collect()]
    assert got == ["0,594668.329", "1,594668.329", "2,594668.329", "3,-594668.329", "4,0.123", "5,NA"]


def test_report_numbers_near_a_tie_are_not_ties(spark):
    # variances at sf0.1 and at 60 times that: below a tie by more than the last digits of a sum
    values = [227068565.53349668, 1861795907.26447, 123456789012.345, -227068565.53349668, 0.0, float("inf"), float("nan")]
    df = spark.createDataFrame(list(enumerate(values)), "k INT, var DOUBLE").orderBy("k")
    got = [r["line"].split(",")[1] for r in report.table_section(1, "t", df, 3).filter("block = 1").collect()]
    assert got == ["227068565.533", "1861795907.264", "123456789012.345", "-227068565.533", "0", "Infinity", "NaN"]


# --- lengths -----------------------------------------------------------------
def test_compositions_sum_to_one(spark, rows):
    schema = "source STRING, fmp_subarea STRING, species_code INT, year INT, length DOUBLE, frequency DOUBLE"
    data = [("S", "AI", 1, 2000, float(i % 7), 10.0) for i in range(20)] + [("S", "AI", 1, 2001, 5.0, 50.0)]
    species = spark.createDataFrame([(1, "one")], "species_code INT, common_name STRING")
    comps = g.length_comps(spark.createDataFrame(data, schema), species)
    assert [r["tst"] for r in g.length_comps_check(comps).collect()] == [pytest.approx(1.0)]
    assert {(r["n_label"], r["common_name"]) for r in comps.collect()} == {("N = 200", "one")}


# --- limits ------------------------------------------------------------------
TOTAL = "species_group STRING, model_name STRING, year INT, pred DOUBLE"


@pytest.fixture(scope="module")
def by_group(spark):
    one, two = golden.TOTALS[2023]
    totals = spark.createDataFrame(
        [
            ("SST", "Model 20", 2023, one), ("SST", "Model 22", 2023, two), ("SST", "Model 22", 2022, 1.0),
            ("non-SST", "Model 20", 2023, golden.NON_SST_2023), ("non-SST", "Model 22", 2023, golden.NON_SST_2023),
        ],
        TOTAL,
    )
    return l.abc_ofl_by_group(totals)


def test_published_limits(by_group):
    got = {r["model_name"]: r for r in l.abc_ofl_summary(by_group, "Model 20").collect()}
    assert got["Model 20"]["OFL"] == pytest.approx(1625.3050077386824)
    assert got["Model 20"]["maxABC"] == pytest.approx(1218.9787558040118)
    assert got["Model 22"]["OFL"] == pytest.approx(1680.1179998163966)
    assert got["Model 22"]["OFL_maxABC_percent_change"] == pytest.approx(3.3724742012563245)
    assert got["Model 22"]["biomass_percent_change"] == pytest.approx(3.589136425005605)
    fixed = {r["model_name"]: r for r in l.abc_ofl_summary(by_group, "Model 20", {"Model 20": 53248}).collect()}
    assert fixed["Model 20"]["biomass"] == 53248 and fixed["Model 20"]["OFL"] == got["Model 20"]["OFL"]


def test_published_specs(spark):
    total = spark.createDataFrame([("SST", 2020, 50693.5), ("non-SST", 2020, 2553.91)], "species STRING, year INT, re_est DOUBLE")
    fmp = spark.createDataFrame(
        [("SST", 2020, "AI", 14608.8), ("SST", 2020, "EBS", 36084.69), ("non-SST", 2020, "AI", 967.284),
         ("non-SST", 2020, "EBS", 1586.63)],
        "species STRING, year INT, FMP STRING, fmp_est DOUBLE",
    )
    specs = l.tier5_specs(total, fmp, 2020)
    got = {(r["Species"], r["Variable"]): r["Value"] for r in l.specs_long(specs).collect()}
    assert got["SST", "OFL"] == pytest.approx(1520.805) and got["SST", "AI ABC"] == pytest.approx(328.698)
    assert got["non-SST", "AI ABC"] == pytest.approx(65.29167)
    assert got["All Other Rockfish", "OFL"] == pytest.approx(1750.6569)
    assert got["All Other Rockfish", "EBS ABC"] == pytest.approx(919.00305, abs=1e-3)
    assert got["All Other Rockfish", "M"] is None and len(got) == 30
    assert [r["Species"] for r in l.specs_long(specs).collect()][::10] == ["SST", "non-SST", "All Other Rockfish"]


def test_shares_sum_to_one(spark):
    data = [("SST", "Model 22", s, 2023, v) for s, v in (("AI", 3.0), ("SBS", 1.0), ("EBS Slope", 4.0))]
    biomass = spark.createDataFrame(data, "species_group STRING, model_name STRING, strata STRING, year INT, pred DOUBLE")
    got = l.apportionment(biomass).collect()
    assert sum(r["prop_biomass"] for r in got) == pytest.approx(1) and len(got) == 2
    wide = l.apportionment_pct(l.apportionment(biomass)).first()
    assert wide["AI"] == pytest.approx(37.5) and wide["EBS"] == pytest.approx(62.5)


def test_one_region_keeps_its_interval(spark):
    mean, sd = math.log(100.0), 0.3
    states = spark.createDataFrame(
        [("SST", 2000, "AI", 100.0, mean, sd)],
        "species STRING, year INT, region STRING, re_est DOUBLE, biomsd DOUBLE, biomsd_sd DOUBLE",
    )
    got = l.combine_ci(states).collect()
    assert {r["level"] for r in got} == {"fmp", "species", "total"}
    for r in got:
        assert r["sd"] == pytest.approx(sd) and r["lci"] == pytest.approx(math.exp(mean - 1.96 * sd))


def test_weighted_mortality(spark):
    totals = spark.createDataFrame([("SST", 2023, 51098.265841378336), ("non-SST", 2023, golden.NON_SST_2023)],
                                   "species_group STRING, year INT, pred DOUBLE")
    assert l.sara_biomass(totals).first()["weighted_M"] == pytest.approx(0.031860551, abs=1e-9)


def test_correlation_of_complete_pairs(spark):
    years = spark.createDataFrame([(y,) for y in range(2000, 2007)], "year INT")
    biomass = spark.createDataFrame([(2000, 1.0), (2001, 2.0), (2002, 4.0), (2003, 3.0)], "year INT, biomass DOUBLE")
    index = spark.createDataFrame(
        [(2000, 1.0), (2001, 3.0), (2002, 5.0), (2003, 2.0), (2005, 9.0)], "year INT, cpue DOUBLE"
    )
    r = l.index_correlation(years, biomass, index).first()
    assert r["n"] == 4 and r["df"] == 2 and r["r"] == pytest.approx(0.8315218406)
    assert r["lci"] < r["r"] < r["uci"]


def test_rounding_is_to_even(spark, rows):
    df = spark.createDataFrame([(2000, 2.5), (2001, 3.5)], "year INT, tons DOUBLE")
    assert rows(l.sara_annual_catch(df)) == [(2000, 2.0), (2001, 4.0)]


def test_cells_equal_the_split_of_all_records(spark, prop, rows):
    raw = spark.createDataFrame(
        [
            (2003, "BSAI", "AI", "rockfish, thornyhead (idiots)", 4.0), (2003, "BSAI", "AI", "thornyhead", 6.0),
            (2003, "BSAI", "BS", "rockfish, dusky", 1.0), (2003, "BSAI", "BS", "rockfish, dusky", None),
        ],
        "YEAR INT, FMP_AREA STRING, FMP_SUBAREA STRING, SPECIES_NAME STRING, WEIGHT_POSTED DOUBLE",
    )
    cells = c.catch_cells(raw, prop, ["fmp"])
    assert rows(c.catch_complex_subarea(cells)) == [
        (2003, "AI", "SST", 7.5), (2003, "AI", "non-SST", 2.5), (2003, "EBS", "non-SST", None),
    ]
