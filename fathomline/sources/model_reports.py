"""Text reports of model runs as rows.

A report is a list of blocks: a name line, then one numeric line for a vector or
several for a matrix. A name may occur twice, so a block is known by its number.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|nan|inf)$"


def read_text(spark: SparkSession, paths, suffix: str) -> DataFrame:
    """One row (run, text) per file; the run is the file name without ``suffix``."""
    name = F.regexp_extract("_metadata.file_name", rf"^(.*){suffix}$", 1)
    return spark.read.text(paths, wholetext=True).select(name.alias("run"), F.col("value").alias("text"))


def report_rows(reports: DataFrame) -> DataFrame:
    """(run, block, name, row, col, value) of every number in the reports.

    Files are spread over the cluster; the window orders the lines of one file.
    """
    lines = reports.select("run", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    lines = lines.select("run", "pos", F.trim("line").alias("line")).filter(F.col("line") != "")
    first = F.split("line", r"\s+")[0]
    titled = lines.select("run", "pos", "line", (~F.lower(first).rlike(NUMBER)).alias("title"))
    order = W.partitionBy("run").orderBy("pos")
    sofar = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = titled.select(
        "*",
        F.count(F.when(F.col("title"), 1)).over(sofar).alias("block"),
        F.last(F.when(F.col("title"), F.col("line")), ignorenulls=True).over(sofar).alias("name"),
        F.max(F.when(F.col("title"), F.col("pos"))).over(sofar).alias("start"),
    )
    values = numbered.filter(~F.col("title") & (F.col("block") > 0)).select(
        "run",
        "block",
        "name",
        (F.col("pos") - F.col("start")).cast("int").alias("row"),
        F.posexplode(F.split("line", r"\s+")).alias("c", "text"),
    )
    number = F.expr("try_cast(text AS DOUBLE)")
    return values.select(
        "run",
        F.col("block").cast("int").alias("block"),
        "name",
        "row",
        (F.col("c") + 1).cast("int").alias("col"),
        F.when(~F.isnan(number), number).alias("value"),
    )


def _years(rows: DataFrame) -> DataFrame:
    """Year of each row number; the first block of that name counts."""
    found = rows.filter((F.col("name") == "yrs") & (F.col("row") == 1))
    return found.groupBy("run", F.col("col").alias("row")).agg(
        F.min_by("value", "block").cast("int").alias("year")
    )


# fixed values: block names and the columns they become
AREA_BLOCKS = {"biomA": "re_est", "LCI": "re_lci", "UCI": "re_uci", "biomsd": "biomsd", "biomsd.sd": "biomsd_sd"}
TOTAL_BLOCKS = {"biom_TOT": "re_est", "biom_TOT_LCI": "re_lci", "biom_TOT_UCI": "re_uci", "SD_biom_TOT": "sd"}


def area_estimates(rows: DataFrame, regions: dict[str, list[str]] | None = None) -> DataFrame:
    """Estimates by run, year and region column; ``regions`` names the columns of a run."""
    columns = [
        F.max(F.when(F.col("name") == name, F.col("value"))).alias(column) for name, column in AREA_BLOCKS.items()
    ]
    wide = rows.filter(F.col("name").isin(list(AREA_BLOCKS))).groupBy("run", "row", "col").agg(*columns)
    named = [(run, place, name) for run, names in (regions or {}).items() for place, name in enumerate(names, 1)]
    known = rows.sparkSession.createDataFrame(named, "run STRING, col INT, known STRING")
    wide = wide.join(known, ["run", "col"], "left")
    region = F.coalesce("known", F.col("col").cast("string"))
    return wide.join(_years(rows), ["run", "row"]).select(
        "run", "year", region.alias("region"), *AREA_BLOCKS.values()
    )


def total_estimates(rows: DataFrame) -> DataFrame:
    """Estimates over all regions by run and year."""
    columns = [
        F.max(F.when(F.col("name") == name, F.col("value"))).alias(column) for name, column in TOTAL_BLOCKS.items()
    ]
    wide = (
        rows.filter(F.col("name").isin(list(TOTAL_BLOCKS)) & (F.col("row") == 1))
        .groupBy("run", F.col("col").alias("row"))
        .agg(*columns)
    )
    return wide.join(_years(rows), ["run", "row"]).select(
        "run", "year", F.lit("TOTAL").alias("region"), *TOTAL_BLOCKS.values()
    )


def fit_numbers(par: DataFrame, cor: DataFrame) -> DataFrame:
    """Objective, gradient, number of parameters and log det Hessian of each run."""

    def after(words: str):
        text = F.regexp_extract("text", words + r"\s*=\s*([-+0-9.eE]+)", 1)
        return F.nullif(text, F.lit("")).try_cast("double")

    heads = par.select(
        "run",
        after("Number of parameters").cast("int").alias("n_par"),
        after("Objective function value").alias("nll"),
        after("Maximum gradient component").alias("mgc"),
    )
    hessians = cor.select("run", after("determinant of the hessian").alias("log_det_hess"))
    return heads.join(hessians, "run", "left").withColumn(
        "converged", (F.col("mgc") < 0.001) & (F.col("log_det_hess") > 0)
    )


def estimates_with_correlations(cor: DataFrame) -> DataFrame:
    """(run, index, name, value, std, correlations with parameters 1..index)."""
    lines = cor.select("run", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line")).filter(F.col("pos") >= 2)
    parts = lines.select("run", F.split(F.trim("line"), r"\s+").alias("p")).filter(F.size("p") >= 4)

    def number(text: Column) -> Column:
        found = text.try_cast("double")
        return F.when(~F.isnan(found), found)

    return parts.select(
        "run",
        F.col("p")[0].cast("int").alias("index"),
        F.col("p")[1].alias("name"),
        number(F.col("p")[2]).alias("value"),
        number(F.col("p")[3]).alias("std"),
        F.transform(F.slice("p", 5, F.size("p")), number).alias("correlations"),
    )


def correlation_matrix(estimates: DataFrame) -> DataFrame:
    """(run, i, j, name_i, name_j, cor, cov): the whole symmetric matrices of a fit, a row per cell.

    ``estimates`` has the lower triangles as ``estimates_with_correlations`` gives them; the rest mirrors
    them. A covariance is the correlation times both standard errors; a missing number makes its
    cells missing.
    """
    known = estimates.select("run", F.col("index").alias("j"), F.col("name").alias("name_j"), F.col("std").alias("std_j"))
    row = estimates.select("run", F.col("index").alias("i"), F.col("name").alias("name_i"), "std", F.posexplode("correlations").alias("at", "cor"))
    cells = row.withColumn("j", F.col("at") + 1).filter("j <= i").join(known, ["run", "j"])
    cov = (F.col("cor") * F.col("std") * F.col("std_j")).alias("cov")
    lower = cells.select("run", "i", "j", "name_i", "name_j", "cor", cov)
    mirrored = [F.struct("i", "j", "name_i", "name_j"), F.struct(*[F.col(b).alias(a) for a, b in (("i", "j"), ("j", "i"), ("name_i", "name_j"), ("name_j", "name_i"))])]
    both = F.when(F.col("i") == F.col("j"), F.array(mirrored[0])).otherwise(F.array(*mirrored))
    return lower.select("run", F.explode(both).alias("at"), "cor", "cov").select("run", "at.*", "cor", "cov")


def correlation_text(estimates: DataFrame, log_det_hess: float | None = None) -> DataFrame:
    """(run, text): estimates with their triangles of correlations as text in the layout that is read.

    A run's parameters come together in one row, as they do in its file.
    """

    def number(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("nan"))

    fields = F.array(F.col("index").cast("string"), F.col("name"), number(F.col("value")), number(F.col("std")))
    line = F.concat(F.lit(" "), F.array_join(F.concat(fields, F.transform("correlations", number)), " "))
    lines = estimates.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("index", line.alias("line")))).alias("lines"))
    places = F.array_join(F.transform("lines", lambda x: x["index"].cast("string")), " ")
    head = F.lit(f" The logarithm of the determinant of the hessian = {log_det_hess if log_det_hess is not None else 'nan'}")
    titles = F.concat(F.lit(" index name value std.dev "), places)
    return lines.select("run", F.array_join(F.concat(F.array(head, titles), F.transform("lines", lambda x: x["line"])), "\n").alias("text"))


# fixed values: the comment lines of a model's input text, in order; areas stand in a comment of their own
INPUT_TITLES = (
    "# Model start and end years", "# Number of survey indices fit (i.e., regions/depth strata)",
    "# Number or process error parameters", "# Process error index", "# Number of surveys", "# Survey years",
    "# Survey biomass", "# Survey biomass SE",
)
UNSEEN = "-9"


def input_text(grid: DataFrame, process: Mapping[str, int] | None = None) -> DataFrame:
    """(run, text): the model's commented input text of each species, written as the published ones are.

    ``grid`` has species, region, year, biomass and cv, a row per region and year (``model_input_grid``); zero
    and missing values are written as -9. ``process`` gives regions the number of their process error, 1 unless given.
    A species is one file, so its numbers come together in one row.
    """

    def number(value: Column) -> Column:
        short = F.regexp_replace(value.cast("string"), r"\.0$", "")
        return F.when((value != 0) & ~F.isnan(value), short).otherwise(F.lit(UNSEEN))

    group = F.lit(1)
    for region, index in (process or {}).items():
        group = F.when(F.col("region") == region, index).otherwise(group)
    cell = F.struct("region", group.alias("process"), number(F.col("biomass")).alias("mu"), number(F.col("cv")).alias("cv"))
    years = grid.groupBy("species", "year").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    runs = years.groupBy("species").agg(F.array_sort(F.collect_list(F.struct("year", "cells"))).alias("rows"))

    def spaced(values: Column) -> Column:
        return F.concat(F.lit(" "), F.array_join(values, " "), F.lit(" "))

    def text(name: str, lead: str = " ") -> Column:
        return F.lit(f"{lead}{name} ")

    first = F.col("rows")[0]["cells"]
    all_years = F.transform("rows", lambda r: r["year"].cast("string"))
    groups = F.transform(first, lambda c: c["process"].cast("string"))
    size = F.size("rows").cast("string")

    def matrix(field: str) -> Column:
        return F.transform("rows", lambda r: F.array_join(F.transform(r["cells"], lambda c: c[field]), " "))

    lines = F.flatten(
        F.array(
            F.array(
                text(INPUT_TITLES[0], ""), spaced(F.array(F.array_min(all_years), F.array_max(all_years))),
                text(INPUT_TITLES[1]), spaced(F.array(F.size(first).cast("string"))),
                text(INPUT_TITLES[2]), spaced(F.array(F.size(F.array_distinct(groups)).cast("string"))),
                text(INPUT_TITLES[3]), spaced(groups),
                text(INPUT_TITLES[4]), spaced(F.array(size)),
                text(INPUT_TITLES[5]), spaced(all_years),
                F.concat(F.lit(" #"), spaced(F.transform(first, lambda c: c["region"]))),
                text(INPUT_TITLES[6]),
            ),
            matrix("mu"),
            F.array(F.lit(INPUT_TITLES[7])),
            matrix("cv"),
        )
    )
    return runs.select(F.col("species").alias("run"), F.array_join(lines, "\n").alias("text"))


def input_rows(texts: DataFrame) -> DataFrame:
    """(run, region, year, process, biomass, cv) of model input texts (run, text); -9 is a missing value.

    The numbers are known by the comment above them; a title that is not one of the known ones names
    the regions, a blank between names. Lines of one text are ordered by a window over its run.
    """
    lines = texts.select("run", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line")).select("run", "pos", F.trim("line").alias("line"))
    order = W.partitionBy("run").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    is_title = F.col("line").startswith("#")
    named = lines.filter("line != ''").select(
        "run",
        "line",
        F.last(F.when(is_title, F.col("line")), ignorenulls=True).over(order).alias("title"),
        F.max(F.when(is_title, F.col("pos"))).over(order).alias("start"),
        "pos",
        is_title.alias("is_title"),
    )
    words = F.split(F.col("line"), r"\s+")
    known = list(INPUT_TITLES)
    regions = named.filter(F.col("is_title") & ~F.col("title").isin(known)).select("run", F.slice(words, 2, F.size(words)).alias("regions"))
    spans = named.filter(~F.col("is_title") & (F.col("title") == known[5])).select("run", words.alias("years"))
    groups = named.filter(~F.col("is_title") & (F.col("title") == known[3])).select("run", words.alias("groups"))
    cells = named.filter(~F.col("is_title") & F.col("title").isin(known[6], known[7])).select(
        "run", "title", (F.col("pos") - F.col("start") - 1).alias("row"), F.posexplode(words).alias("col", "text")
    )
    seen = F.when(F.col("text") != UNSEEN, F.col("text").try_cast("double"))
    wide = cells.groupBy("run", "row", "col").agg(
        F.max(F.when(F.col("title") == known[6], seen)).alias("biomass"), F.max(F.when(F.col("title") == known[7], seen)).alias("cv")
    )
    heads = regions.join(spans, "run").join(groups, "run")
    return wide.join(heads, "run").select(
        "run",
        F.get("regions", F.col("col")).alias("region"),
        F.get("years", F.col("row")).cast("int").alias("year"),
        F.get("groups", F.col("col")).cast("int").alias("process"),
        "biomass",
        "cv",
    )


def report_text(states: DataFrame) -> DataFrame:
    """Reports (run, text) in the same layout from model states on a full grid.

    One run is one file, so its numbers come together in one row.
    """

    def number(value):
        return F.coalesce(value.cast("string"), F.lit("nan"))

    years = states.groupBy("run", "year").agg(
        F.array_sort(
            F.collect_list(F.struct("region", number(F.col("re_est")).alias("est"), number(F.col("biomsd")).alias("sd")))
        ).alias("cells")
    )
    per_run = years.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("year", "cells"))).alias("rows"))

    def block(field):
        lines = F.transform(
            "rows", lambda r: F.concat(F.lit(" "), F.array_join(F.transform(r["cells"], lambda c: c[field]), " "))
        )
        return F.array_join(lines, "\n")

    year_line = F.array_join(F.transform("rows", lambda r: r["year"].cast("string")), " ")
    text = F.concat_ws(
        "\n", F.lit("yrs"), F.concat(F.lit(" "), year_line), F.lit("biomA"), block("est"), F.lit("yrs"),
        F.concat(F.lit(" "), year_line), F.lit("biomsd"), block("sd"),
    )
    return per_run.select("run", text.alias("text"))
