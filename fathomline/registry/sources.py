"""Tables that were written to files and read again, and texts that lists become."""

import uuid

from pyspark.sql import functions as F

from fathomline.operators import clean_names
from fathomline.plans import report
from fathomline.registry import ALL, register
from fathomline.registry.shared import CLEAN_SQL, clean
from fathomline.session import settled, work_folder
from fathomline.sources import files


def _path(t) -> str:
    """A new path in the shared work folder."""
    return f"{work_folder(t.spark)}/{uuid.uuid4().hex}"


def _points(t):
    """Positions, some of them missing, and a text with commas and quotes."""
    text = F.concat(F.lit('area "'), F.col("nmfs_area").cast("string"), F.lit('", year '), F.col("year").cast("string"))
    return t["obs_points"].select("haul_join", "year", "londd_start", "latdd_start", text.alias("label"))


_POINTS = """
SELECT haul_join, year, londd_start, latdd_start, 'area "' || nmfs_area || '", year ' || year AS label FROM obs_points"""

register(
    "csv_round_trip",
    lambda t: files.write_csv(_points(t), _path(t)),
    _POINTS,
    uses=("obs_points",),
)


def _untidy(t):
    """A file whose headers have blanks and points, read by its schema and tidied."""
    titles = {"haul_join": "Haul Join", "year": "YEAR", "londd_start": "Lon.Start", "latdd_start": "Lat. Start", "label": "Label"}
    titled = _points(t).withColumnsRenamed(titles)
    return clean_names(files.write_csv(titled, _path(t)))


register("csv_untidy_headers", _untidy, _POINTS.replace("londd_start, latdd_start", "londd_start AS lon_start, latdd_start AS lat__start"), uses=("obs_points",))


def _yearly(t):
    """Outputs of two assessment years, each in its own partition."""
    path = _path(t)
    points = settled(_points(t))
    for year in (1996, 1997):
        files.write_yearly(points.filter(F.col("year") == year), path, year)
    return files.read_yearly(t.spark, path)


register(
    "yearly_round_trip",
    _yearly,
    _POINTS.replace(" FROM obs_points", ", CAST(year AS INTEGER) AS assessment_year FROM obs_points WHERE year IN (1996, 1997)"),
    uses=("obs_points",),
)

register(
    "biomass_report_file",
    lambda t: files.write_report(ALL["biomass_report"].build(t), _path(t)),
    f"SELECT line FROM ({ALL['biomass_report'].sql}) r",
    uses=ALL["biomass_report"].uses,
    extra=ALL["biomass_report"].extra,
)


def _listed(t):
    """Sums of the species that a list of names, made by an earlier query, asks for."""
    catch = settled(clean(t).select("species_code", "species_name", "tons"))
    # the names of a species list: few, whatever the catch
    names = [r["species_name"] for r in catch.filter(F.col("species_code") % 3 == 0).select("species_name").distinct().orderBy("species_name").collect()]
    wanted = catch.filter(f"species_name IN ({files.quoted_list(names)})")
    title = report.quoted(F.lit(", ".join(names)))
    return wanted.groupBy("species_name").agg(F.sum("tons").alias("tons")).withColumn("asked", title)


register(
    "listed_species",
    _listed,
    """
SELECT c.species_name, round(sum(tons), 4) AS tons, any_value(l.asked) AS asked
FROM clean c JOIN (SELECT DISTINCT species_name FROM clean WHERE species_code % 3 = 0) n ON n.species_name = c.species_name
CROSS JOIN (SELECT '"' || string_agg(species_name, ', ' ORDER BY species_name) || '"' AS asked
            FROM (SELECT DISTINCT species_name FROM clean WHERE species_code % 3 = 0) d) l
GROUP BY c.species_name""",
    uses=("catch_raw",),
    extra=CLEAN_SQL,
    digits={"tons": 4},
)
