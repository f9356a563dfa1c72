"""Report files: titled tables in one text, and the results-archive export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import drop_trailing_zeros, fixed, or_na
from fathomline.operators import dense_numbers
from fathomline.plans import catch as tables
from fathomline.session import settled


def rounded(value: Column, digits: int) -> Column:
    """A double with ``digits`` decimals, halves away from zero, a tie being seen within 1e-15 of the value.

    A sum of doubles hangs on their order in its last digits. A tie that it misses by them is
    still one, so that a printed number does not hang on the partitions. What is looked over is never
    more than a thousandth of the last decimal: a larger value, or one further from a tie, is rounded as it is.
    """
    missed = F.least(F.abs(value) * 1e-15, F.lit(10.0 ** -(digits + 3)))
    return F.round(value + F.signum(value) * missed, digits)


def plain_double(value: Column) -> Column:
    """A double with 15 significant digits and without exponent, where 38 digits can hold it so."""
    short = F.format_string("%.14e", value).try_cast("double")
    small = F.abs(short) < 1
    wide = F.when(small, short.try_cast("decimal(38,37)").cast("string")).otherwise(
        short.try_cast("decimal(38,15)").cast("string")
    )
    text = F.coalesce(drop_trailing_zeros(wide), short.cast("string"))
    # beyond the digits that a decimal has after the point
    return F.when((short != 0) & (F.abs(short) < 1e-22), short.cast("string")).otherwise(text)


def _printed(df: DataFrame) -> list[Column]:
    """Columns as report text: doubles without exponent, missing as NA, quotes where a comma or quote stands."""
    texts = []
    for name, kind in df.dtypes:
        value = F.col(f"`{name}`")
        value = plain_double(value) if kind == "double" else value.cast("string")
        texts.append(or_na(quoted(value)))
    return texts


def quoted(text: Column) -> Column:
    """A CSV field: in quotes, those inside doubled, if it has a comma, a quote or a line end."""
    inside = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\\n\\r]'), inside).otherwise(text)


def _lines(df: DataFrame, number: int, row_no: Column, line: Column, block: int = 0) -> DataFrame:
    """Lines of a section with their place in a block of it; ``stack_sections`` numbers them through."""
    return df.select(
        F.lit(number).alias("section"), F.lit(block).alias("block"), row_no.cast("bigint").alias("row_no"), line.alias("line")
    )


def text_section(spark, number: int, lines: Sequence[str]) -> DataFrame:
    """Free text lines as a section."""
    items = F.array(*[F.lit(line) for line in lines])
    return _lines(spark.range(1).select(F.posexplode(items).alias("p", "l")), number, F.col("p"), F.col("l"))


def table_section(number: int, title: str, df: DataFrame, digits: int | None = None) -> DataFrame:
    """Title, header and rows of a table, which keeps the order it comes in.

    ``digits`` rounds the doubles that are printed, see ``rounded``.
    """
    head = text_section(df.sparkSession, number, ["", title, ",".join(df.columns)])
    if digits is not None:
        df = df.select(*[(rounded(F.col(f"`{c}`"), digits) if k == "double" else F.col(f"`{c}`")).alias(c) for c, k in df.dtypes])
    rows = _lines(df, number, F.monotonically_increasing_id(), F.concat_ws(",", *_printed(df)), block=1)
    return head.unionByName(rows)


def stack_sections(sections: Sequence[DataFrame]) -> DataFrame:
    """All sections as (section, row_no, line), the lines of each numbered from 0 without gaps.

    The lines are written once; their numbers come from counts per section, block and partition, so
    they do not hang on how many partitions a table had.
    """
    lines = settled(reduce(DataFrame.unionByName, sections))
    by_block = dense_numbers(lines, "row_no", "place", ["section", "block"])
    sizes = lines.groupBy("section", "block").agg(F.count(F.lit(1)).alias("n"))
    first = sizes.filter("block = 0").select("section", F.col("n").alias("first"))
    shift = F.when(F.col("block") == 0, F.lit(0)).otherwise(F.coalesce("first", F.lit(0)))
    return by_block.join(first, "section", "left").select("section", (F.col("place") + shift).alias("row_no"), "line")


def catch_report(
    catch: DataFrame, proportion: DataFrame, areas: Sequence[int], source: str, access_date: str, digits: int | None = None
) -> DataFrame:
    """All catch tables as (section, row_no, line); ``digits`` rounds the doubles that are printed.

    ``catch`` is the cube of sums over all columns used here. It is settled once
    and every section reads it.
    """
    cube = settled(catch)
    spark = cube.sparkSession
    detail = settled(
        tables.detailed_catch_byarea(
            cube.filter(F.col("species_name").isin("dusky", "SST")), areas, ["species_name", "fmp_subarea"]
        )
    )
    sections = [
        text_section(spark, 0, ["Catch tables", f"Catch from {source}, queried {access_date}"]),
        table_section(1, "Total catch (t) by FMP and FMP subarea", tables.catch_by_fmp(cube).orderBy("Year"), digits),
        table_section(
            2,
            "Catch (t) by species and percent shortspine thornyhead in the thornyhead catch",
            tables.catch_by_species(cube, proportion),
        ),
        table_section(
            3, "Percentage of the total catch by target fishery and gear type", tables.gear_target_pct(cube)
        ),
    ]
    subsets = [(s, a) for s in ("dusky", "SST") for a in ("EBS", "AI")]
    for number, (species, subarea) in enumerate(subsets, 4):
        hit = (F.col("species_name") == species) & (F.col("fmp_subarea") == subarea)
        part = detail.filter(hit).drop("species_name", "fmp_subarea")
        total = F.col("`Total (t)`").cast("double")
        part = part.orderBy(F.col("Gear") == "Total (t)", total.desc(), "Gear", "Target fishery")
        title = f"Sum of total catch (t) of {subarea} {species} by target fishery and gear type"
        sections.append(table_section(number, title, part))
    sections.append(
        table_section(8, "Retained and discarded catch by area and year", tables.discard_table(cube))
    )
    return stack_sections(sections)


def biomass_report(
    survey: DataFrame, regions: DataFrame, combined: DataFrame, source: str, access_date: str, digits: int | None = None
) -> DataFrame:
    """All biomass tables as (section, row_no, line); ``digits`` rounds the doubles that are printed.

    ``survey`` has the survey estimates by species, region and year with their limits,
    ``regions`` the model's estimates (species, region, year and what else is to be
    shown), ``combined`` their sums by level as ``combine_ci`` gives them.
    """
    spark = survey.sparkSession
    combined = settled(combined)
    keys = ["species", "region", "year"]

    def level(name, *columns):
        rows = combined.filter(F.col("level") == name)
        return rows.select(*columns, "year", "est", "lci", "uci").orderBy(*columns, "year")

    shown = ["biomass", "var", "lci", "uci"]
    sections = [
        text_section(spark, 0, ["Biomass tables", f"Surveys from {source}, queried {access_date}"]),
        table_section(1, "Survey biomass (t) by region with 95% limits", survey.select(*keys, *shown).orderBy(*keys), digits),
        table_section(2, "Model biomass (t) by region", regions.orderBy(*keys), digits),
        table_section(3, "Model biomass (t) by FMP with 95% limits", level("fmp", "species", "FMP"), digits),
        table_section(4, "Model biomass (t) by species with 95% limits", level("species", "species"), digits),
        table_section(5, "Model biomass (t) of all species with 95% limits", level("total"), digits),
    ]
    return stack_sections(sections)


def archive_export(
    fields: Mapping[str, object],
    biomass: DataFrame,
    catch: DataFrame,
    survey: DataFrame | None = None,
) -> DataFrame:
    """Results archive as (section, row_no, line): a #FIELD line, then its value.

    Text values are quoted. Series are one line each, with NA for years without a
    value; a line holds one number per year. ``biomass`` has year and total, ``catch``
    year and catch, ``survey`` year and a column per survey.
    """
    spark = biomass.sparkSession
    lines = []
    for name, value in fields.items():
        shown = f'"{value}"' if isinstance(value, str) else ("\"NA\"" if value is None else str(value))
        lines += [f"#{name}", shown]
    sections = [text_section(spark, 1, lines)]

    yearly = biomass.select("year", "total").join(catch.select("year", "catch"), "year", "left")
    names = {"FISHERYYEAR": F.col("year").cast("string"), "TOTALBIOMASS": fixed(F.col("total"), 0),
             "TOTALCATCH": fixed(F.col("catch"), 0)}
    sections.append(_series(yearly, names, 2))
    if survey is not None:
        columns = [c for c in survey.columns if c != "year"]
        values = {f"SURVEY_{c}": fixed(F.col(f"`{c}`"), 0) for c in columns}
        sections.append(_series(survey, {"SURVEYYEAR": F.col("year").cast("string"), **values}, 3))
    return stack_sections(sections)


def _series(df: DataFrame, names: Mapping[str, Column], number: int) -> DataFrame:
    """Each named text column as a title line and a line of its values by year."""
    pieces = [
        F.struct(F.lit(place).alias("place"), F.lit(name).alias("name"), text.alias("text"))
        for place, (name, text) in enumerate(names.items())
    ]
    long = df.select("year", F.inline(F.array(*pieces)))
    joined = long.groupBy("place", "name").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("year", "text"))), lambda s: s["text"]), " "
        ).alias("values")
    )
    both = F.array(F.concat(F.lit("#"), F.col("name")), F.col("values"))
    rows = joined.select("place", F.posexplode(both).alias("p", "line"))
    return _lines(rows, number, F.col("place") * 2 + F.col("p"), F.col("line"))


def archive_export_short(
    fields: Mapping[str, object], catch: DataFrame, biomass: DataFrame, survey: DataFrame
) -> DataFrame:
    """The older archive layout as (section, row_no, line): 'value   #FIELD' lines, then series.

    A series is a title, its years and its values; years without a value are left out.
    ``catch`` has year and catch, ``biomass`` year and total, ``survey`` year and a
    column per survey.
    """
    spark = catch.sparkSession
    names = [c for c in survey.columns if c != "year"]
    heads = [f"{value}   #{name}" for name, value in fields.items()]
    surveys = ["#SURVEYNAMES   " + "   ".join(names), " ".join("1" for _ in names)]
    sections = [
        text_section(spark, 1, heads),
        _own_years(catch, "catch", ["#TOTALCATCH", "1"], 2),
        _own_years(biomass, "total", ["#ABUNDANCE", "1"], 3),
        text_section(spark, 4, surveys),
    ]
    for place, name in enumerate(names, 1):
        sections.append(_own_years(survey, name, [f"#SURVEY{place}"], 4 + place))
    return stack_sections(sections)


def _own_years(df: DataFrame, column: str, titles: Sequence[str], number: int) -> DataFrame:
    """Titles, then the years of a series and its values in whole numbers."""
    value = F.col(f"`{column}`")
    pair = F.struct(F.col("year").cast("string").alias("year"), fixed(value, 0).alias("text"))
    series = df.filter(value.isNotNull()).agg(F.array_sort(F.collect_list(pair)).alias("pairs"))

    def joined(part):
        return F.array_join(F.transform("pairs", lambda p: p[part]), " ")

    lines = F.array(*[F.lit(t) for t in titles], joined("year"), joined("text"))
    return _lines(series.select(F.posexplode(lines).alias("p", "l")), number, F.col("p"), F.col("l"))
