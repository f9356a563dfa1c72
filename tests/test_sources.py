import os

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fathomline.operators import clean_names
from fathomline.plans import report
from fathomline.sources import files, model_reports, schemas

BOM = "\ufeff"


def test_dashboard_file(spark, tmp_path):
    names = [c.split("`")[1] if c.startswith("`") else c.split()[0] for c in schemas.NONCOMMERCIAL.split(", ")]
    names = [n.strip("`") for n in names]
    row = ["2016", "ADFG", "Trawl", "6", "BS", "519", "W", "655406", "AKR", "172", "ROCK", "Other", "23", "9.87",
           "1", '"A, b. C, d"', "2020-10-18 19:00:01"]
    other = [*row[:13], "NA", *row[14:]]
    path = tmp_path / "dash.csv"
    path.write_text(BOM + "\n".join([",".join(names), ",".join(row), ",".join(other)]) + "\n", encoding="utf-8")
    df = clean_names(files.read_csv(spark, str(path), schemas.NONCOMMERCIAL))
    got = df.orderBy("weight").collect()
    assert df.columns[:2] == ["collection_year", "collection_agency"] and len(df.columns) == 17
    assert got[0]["weight"] is None and got[1]["weight"] == 9.87
    assert got[1]["contact"] == "A, b. C, d" and got[1]["collection_year"] == 2016


def test_header_only_file(spark, tmp_path):
    path = tmp_path / "empty.csv"
    path.write_text("SURVEY,YEAR,STRATUM,LENGTH,SPECIES_CODE,FREQUENCY\n")
    assert files.read_csv(spark, str(path), schemas.SURVEY_LENGTHS_RAW).count() == 0


def test_csv_round_trip_hands_back_what_it_wrote(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, None, "a,b"), (2, 2.5, "c")], "i INT, v DOUBLE, s STRING")
    written = files.write_csv(df, str(tmp_path / "out"))
    assert rows(written) == rows(df) and len(written.inputFiles()) > 0
    back = files.read_csv(spark, str(tmp_path / "out"), "i INT, v DOUBLE, s STRING")
    assert rows(back) == rows(df)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert "NA" in text and '"a,b"' in text


def test_yearly_output(spark, tmp_path, rows):
    df = spark.createDataFrame([(1,)], "i INT")
    files.write_yearly(df, str(tmp_path / "d"), 2020)
    files.write_yearly(df, str(tmp_path / "d"), 2022)
    assert os.path.isdir(tmp_path / "d" / "assessment_year=2022")
    assert rows(files.read_yearly(spark, str(tmp_path / "d"))) == [(1, 2020), (1, 2022)]


def test_database_options():
    plain = files.jdbc_options("jdbc:x", "select 1")
    assert plain["query"] == "select 1" and "numPartitions" not in plain
    split = files.jdbc_options("jdbc:x", "select 1", "year", 2003, 2023, 8)
    assert split["dbtable"] == "(select 1) source" and "query" not in split
    assert (split["lowerBound"], split["upperBound"], split["numPartitions"]) == ("2003", "2023", "8")
    known = files.jdbc_options("jdbc:x", "select 1", properties={"user": "u", "driver": "d"})
    assert known["user"] == "u" and known["driver"] == "d" and known["url"] == "jdbc:x"
    with pytest.raises(ValueError):
        files.jdbc_options("jdbc:x", "select 1", "year")
    assert files.quoted_list([350, "o'x"]) == "'350', 'o''x'"


def test_wide_haul_keys(spark):
    df = spark.createDataFrame([("24213002718000001024",), ("7",)], "k STRING")
    df = df.select(df["k"].cast("decimal(20,0)").alias("haul_join"))
    assert files.wide_key_filter(df, "haul_join", "24213002718000001024").count() == 1


REPORT = """yrs_srv
 1982 1983
yrs
 1982 1983
biom_TOT
 10.5 11
SD_biom_TOT
 0.1 0.2
biom_TOT_UCI
 12 13
biom_TOT_LCI
 9 1e1
yrs
 1982 1983
LCI
 1 2 3
 4 5 6
biomA
 1.5 2.5 nan
 4.5 -5.5 6.5
UCI
 2 3 4
 5 6 7
biomsd
 0.4 0.9 1.2
 1.5 1.7 1.9
biomsd.sd
 0.1 0.2 0.3
 0.4 0.5 0.6
"""
PAR = "# Number of parameters = 1 Objective function value = 11.25776  Maximum gradient component = 4.79e-06\n# x:\n 1\n"
COR = """ The logarithm of the determinant of the hessian = 2.88361
 index   name       value      std.dev       1       2
     1   logSdLam -2.1095e+00 2.3650e-01   1.0000
     2   biom      8.7928e+00 4.0340e-01  -0.0846  1.0000
"""


def test_report_file_keeps_ties(spark, tmp_path):
    sums = spark.createDataFrame([(1, 594668.3284999998), (2, 594668.3285)], "k INT, est DOUBLE").orderBy("k")
    lines = report.stack_sections([report.table_section(1, "t", sums, 3)])
    written = files.write_report(lines, str(tmp_path / "report")).collect()
    assert [r["line"] for r in written] == ["", "t", "k,est", "1,594668.329", "2,594668.329"]


def test_report_file_rounds_up_only_ties(spark, tmp_path):
    variances = spark.createDataFrame([(1, 227068565.53349668), (2, 123456789012.345)], "k INT, var DOUBLE").orderBy("k")
    lines = report.stack_sections([report.table_section(1, "t", variances, 3)])
    written = files.write_report(lines, str(tmp_path / "report")).collect()
    assert [r["line"] for r in written] == ["", "t", "k,var", "1,227068565.533", "2,123456789012.345"]


def test_model_report(spark, tmp_path, rows):
    for run in ("RE_a", "RE_b"):
        (tmp_path / f"{run}_rwout.rep").write_text(REPORT)
        (tmp_path / f"{run}.par").write_text(PAR)
        (tmp_path / f"{run}.cor").write_text(COR)
    texts = model_reports.read_text(spark, str(tmp_path / "*.rep"), "_rwout.rep")
    found = model_reports.report_rows(texts)
    assert found.filter("run = 'RE_a'").select("block").distinct().count() == 12
    assert found.filter("run = 'RE_a' AND name = 'yrs'").select("block").distinct().count() == 2
    area = rows(model_reports.area_estimates(found, {"RE_a": ["AI", "SLOPE", "SBS"]}).filter("run = 'RE_a'"))
    assert ("RE_a", 1982, "AI", 1.5, 1.0, 2.0, 0.4, 0.1) in area
    assert ("RE_a", 1982, "SBS", None, 3.0, 4.0, 1.2, 0.3) in area and len(area) == 6
    total = rows(model_reports.total_estimates(found).filter("run = 'RE_b'"))
    assert total == [("RE_b", 1982, "TOTAL", 10.5, 9.0, 12.0, 0.1), ("RE_b", 1983, "TOTAL", 11.0, 10.0, 13.0, 0.2)]
    par = model_reports.read_text(spark, str(tmp_path / "*.par"), ".par")
    cor = model_reports.read_text(spark, str(tmp_path / "*.cor"), ".cor")
    numbers = rows(model_reports.fit_numbers(par, cor))
    assert numbers[0] == ("RE_a", 1, 11.25776, 4.79e-06, 2.88361, True)
    estimates = rows(model_reports.estimates_with_correlations(cor).filter("run = 'RE_a'"))
    assert estimates[1] == ("RE_a", 2, "biom", 8.7928, 0.4034, [-0.0846, 1.0])


def test_whole_correlation_and_covariance_matrices(spark, tmp_path):
    (tmp_path / "RE_a.cor").write_text(COR + "     3   biom      9.7750e+00 nan  -0.0267  0.0023  1.0000\n")
    estimates = model_reports.estimates_with_correlations(model_reports.read_text(spark, str(tmp_path / "*.cor"), ".cor"))
    cells = {(r["i"], r["j"]): r for r in model_reports.correlation_matrix(estimates).collect()}
    assert len(cells) == 9 and (cells[2, 1]["name_i"], cells[2, 1]["name_j"]) == ("biom", "logSdLam")
    assert cells[1, 2]["cor"] == cells[2, 1]["cor"] == -0.0846 and cells[1, 2]["cov"] == cells[2, 1]["cov"]
    assert cells[2, 2]["cov"] == pytest.approx(0.4034**2) and cells[1, 2]["cov"] == pytest.approx(-0.0846 * 0.2365 * 0.4034)
    assert cells[3, 1]["cor"] == -0.0267 and cells[3, 3]["cov"] is None
    # written and read again
    again = model_reports.estimates_with_correlations(model_reports.correlation_text(estimates, 2.88361))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, estimates.collect()))
    numbers = model_reports.fit_numbers(spark.createDataFrame([("RE_a", PAR)], "run STRING, text STRING"), model_reports.correlation_text(estimates, 2.88361))
    assert numbers.first()["log_det_hess"] == 2.88361


def test_model_input_text(spark, tmp_path):
    seen = [("SST", "AI", 1982, 6153.3, 0.2394), ("SST", "SBS", 1982, 0.0, 0.0), ("SST", "AI", 1983, None, None), ("SST", "SBS", 1983, 451.0, 0.7677)]
    grid = spark.createDataFrame(seen, "species STRING, region STRING, year INT, biomass DOUBLE, cv DOUBLE")
    text = model_reports.input_text(grid, {"SBS": 2}).first()
    assert text["run"] == "SST" and text["text"].split("\n") == [
        "# Model start and end years ", " 1982 1983 ", " # Number of survey indices fit (i.e., regions/depth strata) ", " 2 ",
        " # Number or process error parameters ", " 2 ", " # Process error index ", " 1 2 ", " # Number of surveys ", " 2 ",
        " # Survey years ", " 1982 1983 ", " # AI SBS ", " # Survey biomass ", "6153.3 -9", "-9 451", "# Survey biomass SE", "0.2394 -9", "-9 0.7677",
    ]
    (tmp_path / "RE_SST.dat").write_text(text["text"] + "\n")
    read = model_reports.input_rows(model_reports.read_text(spark, str(tmp_path / "*.dat"), ".dat"))
    assert sorted(map(tuple, read.collect())) == [
        ("RE_SST", "AI", 1982, 1, 6153.3, 0.2394), ("RE_SST", "AI", 1983, 1, None, None),
        ("RE_SST", "SBS", 1982, 2, None, None), ("RE_SST", "SBS", 1983, 2, 451.0, 0.7677),
    ]


def test_numbers_and_fields_as_report_text(spark):
    values = [1e-11, 1.5, 1e7, 123456789.125, 0.1 + 0.2, 1e300, None, -2.0, 0.0]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k INT, v DOUBLE").orderBy("k")
    got = [r["t"] for r in df.select(report.plain_double(F.col("v")).alias("t")).collect()]
    assert got == ["0.00000000001", "1.5", "10000000", "123456789.125", "0.3", "1.0E300", None, "-2", "0"]
    fields = spark.createDataFrame([("a,b",), ('say "x"',), ("plain",)], "s STRING")
    assert [r["t"] for r in fields.select(report.quoted(F.col("s")).alias("t")).collect()] == ['"a,b"', '"say ""x"""', "plain"]


def test_sectioned_report_keeps_its_order(spark, tmp_path):
    one = spark.createDataFrame([(2, 0.5), (1, None), (3, 12345678.25)], "a INT, b DOUBLE").orderBy("a")
    lines = report.stack_sections(
        [
            report.table_section(2, "Second", one.limit(1)),
            report.text_section(spark, 0, ["Head", "by x"]),
            report.table_section(1, "First", one),
        ]
    )
    files.write_report(lines, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert text.splitlines() == [
        "Head", "by x", "", "First", "a,b", "1,NA", "2,0.5", "3,12345678.25", "", "Second", "a,b", "1,NA",
    ]


def test_archive_export(spark):
    biomass = spark.createDataFrame([(2000, 10.4), (2001, 11.6)], "year INT, total DOUBLE")
    catch = spark.createDataFrame([(2001, 3.0)], "year INT, catch DOUBLE")
    survey = spark.createDataFrame([(2000, 7.0)], "year INT, AI DOUBLE")
    lines = report.archive_export({"STOCK": "X", "YEAR": 2022, "AGE": None}, biomass, catch, survey)
    got = [r["line"] for r in lines.orderBy("section", "row_no").collect()]
    assert got == [
        "#STOCK", '"X"', "#YEAR", "2022", "#AGE", '"NA"', "#FISHERYYEAR", "2000 2001", "#TOTALBIOMASS", "10 12",
        "#TOTALCATCH", "NA 3", "#SURVEYYEAR", "2000", "#SURVEY_AI", "7",
    ]


def test_older_archive_export(spark):
    catch = spark.createDataFrame([(2001, 3.2), (2000, 2.5)], "year INT, catch DOUBLE")
    biomass = spark.createDataFrame([(2000, 10.4)], "year INT, total DOUBLE")
    survey = spark.createDataFrame([(2000, 7.0, None), (2002, 8.0, 1.0)], "year INT, AI DOUBLE, SBS DOUBLE")
    lines = report.archive_export_short({"STOCK": "X", "TIER": 5}, catch, biomass, survey)
    got = [r["line"] for r in lines.orderBy("section", "row_no").collect()]
    assert got == [
        "X   #STOCK", "5   #TIER", "#TOTALCATCH", "1", "2000 2001", "2 3", "#ABUNDANCE", "1", "2000", "10",
        "#SURVEYNAMES   AI   SBS", "1 1", "#SURVEY1", "2000 2002", "7 8", "#SURVEY2", "2002", "1",
    ]


@pytest.mark.parametrize(
    "values, rows",
    [
        ([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 3),
        ([None, None, 5], 1),
        ([None], 10),
        ([], 10),
        ([7] * 20, 2),
        ([-5, -1, 0, 1, 400], 1),
        ([0.25, 0.75, 1.5, None], 1),
        ([24213002718000001024, 24213002718000001024 - 10**6, None], 1),
    ],
)
def test_split_of_a_database_read_by_its_own_bounds(values, rows):
    duck = duckdb.connect()
    duck.execute("CREATE TABLE t (k DECIMAL(38, 4), n INTEGER)")
    if values:
        duck.executemany("INSERT INTO t VALUES (?, ?)", [(v, i) for i, v in enumerate(values)])
    bounds = duck.sql(files.bounds_query("SELECT * FROM t", "k")).fetchall()[0]
    conditions = files.split_predicates("k", *bounds, rows=rows)
    assert conditions == files.split_predicates("k", *bounds, rows=rows) and len(conditions) <= 1025
    duck.executemany("INSERT INTO t VALUES (?, ?)", [(-10**9, 1000), (10**9, 1001), (None, 1002)])  # written since
    met = [duck.sql(f"SELECT n FROM t WHERE {c}").fetchall() for c in conditions]
    everything = sorted(n for part in met for (n,) in part)
    assert everything == sorted(n for (n,) in duck.sql("SELECT n FROM t").fetchall())
    whole = [len([1 for (n,) in part if n < 1000]) for part in met]
    assert sum(whole) == len(values)
    if len(set(values) - {None}) == len(values) == 10:
        assert max(whole) <= rows + 1


def test_split_read_asks_the_source_first():
    asked = {}

    class Reader:
        def format(self, kind):
            asked["format"] = kind
            return self

        def options(self, **options):
            asked["bounds"] = options
            return self

        def load(self):
            return self

        def first(self):
            return Row(LOWEST=1, HIGHEST=10, TOTAL=10, ABSENT=1)

        def jdbc(self, url, table, predicates, properties):
            asked["read"] = (url, table, predicates, properties)
            return "rows"

    class Session:
        read = Reader()

    assert files.read_database_split(Session(), "jdbc:x", "SELECT k FROM t", "k", rows=5, properties={"user": "u"}) == "rows"
    assert asked["bounds"]["query"].startswith("SELECT MIN(k)") and asked["bounds"]["user"] == "u"
    assert asked["read"] == ("jdbc:x", "(SELECT k FROM t) source", ["k IS NULL", "k < 5", "k >= 5"], {"user": "u"})
