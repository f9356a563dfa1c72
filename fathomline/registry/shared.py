"""Inputs and SQL fragments that several queries share."""

from __future__ import annotations

from fathomline.plans import catch as tables
from fathomline.plans import extraction
from fathomline.sources.bindings import Bound

THORNYHEADS = [349, 350, 352]
HAUL_AREAS = (500, 543)
ALL_AREAS = [541, 542, 543, *range(503, 525)]


def clean(t: Bound):
    return extraction.catch_clean(t["catch_raw"])


def proportion(t: Bound):
    return extraction.class_proportion_of_hauls(t["obs_spcomp"], t["obs_haul"], THORNYHEADS, HAUL_AREAS)


def cells(t: Bound, *keys: str, species=None):
    return tables.catch_cells(t["catch_raw"], proportion(t), keys, species)


def atka(t: Bound):
    return extraction.target_catch_filter(t["catch_raw"], "Atka Mackerel", ["greenling, "])


CATCH_USES = ("catch_raw", "obs_haul", "obs_spcomp")

CLEAN_SQL = {
    "clean": """
SELECT year, catch_activity_date AS date, fmp_area AS fmp,
       CASE WHEN fmp_subarea = 'BS' THEN 'EBS' ELSE fmp_subarea END AS fmp_subarea,
       reporting_area_code AS nmfs_area, agency_gear_code AS gear, retained_or_discarded,
       trip_target_name AS target, agency_species_code AS species_code, species_group_name AS species_group,
       replace(replace(replace(species_name, 'rockfish, ', ''), ' (red snapper)', ''), ' (idiots)', '')
       AS species_name, weight_posted AS tons
FROM catch_raw"""
}

PROPORTION_SQL = {
    "prop": """
SELECT year, fmp_subarea, w / total AS prop_sst
FROM (SELECT year, fmp_subarea, thorny, w, sum(w) OVER (PARTITION BY year, fmp_subarea) AS total
      FROM (SELECT h.year, CASE WHEN h.nmfs_area BETWEEN 500 AND 540 THEN 'EBS' ELSE 'AI' END AS fmp_subarea,
                   CASE WHEN s.species = 350 THEN 'sst' ELSE 'other' END AS thorny,
                   sum(s.extrapolated_weight) AS w
            FROM obs_spcomp s JOIN obs_haul h ON s.haul_join = h.haul_join
            WHERE s.species IN (349, 350, 352) AND h.nmfs_area BETWEEN 500 AND 543
            GROUP BY 1, 2, 3) a) b
WHERE thorny = 'sst'"""
}

SPLIT_SQL = {
    **CLEAN_SQL,
    **PROPORTION_SQL,
    "catch": """
SELECT c.year, c.date, c.fmp, c.fmp_subarea, c.nmfs_area, c.gear, c.retained_or_discarded, c.target,
       c.species_code, c.species_group, 'SST' AS species_name, c.tons * p.prop_sst AS tons
FROM clean c LEFT JOIN prop p ON c.year = p.year AND c.fmp_subarea = p.fmp_subarea
WHERE c.species_name = 'thornyhead'
UNION ALL
SELECT c.year, c.date, c.fmp, c.fmp_subarea, c.nmfs_area, c.gear, c.retained_or_discarded, c.target,
       c.species_code, c.species_group, 'other thornyheads' AS species_name, c.tons * (1 - p.prop_sst) AS tons
FROM clean c LEFT JOIN prop p ON c.year = p.year AND c.fmp_subarea = p.fmp_subarea
WHERE c.species_name = 'thornyhead'
UNION ALL
SELECT * FROM clean WHERE species_name <> 'thornyhead'""",
    "complexes": """
SELECT *, CASE WHEN species_name = 'SST' THEN 'SST' ELSE 'non-SST' END AS complex FROM catch""",
}


# --- report lines -----------------------------------------------------------
def text_lines(section: int, lines: list[str]) -> str:
    """SQL of given lines of a section."""
    return "\nUNION ALL ".join(
        f"SELECT {section} AS section, CAST({k} AS BIGINT) AS row_no, '{line}' AS line" for k, line in enumerate(lines)
    )


def table_lines(section: int, title: str, fields: dict[str, str], source: str, order: str) -> str:
    """SQL of a printed table: blank line, title, header, then rows of text fields in order."""
    values = ", ".join(f"coalesce({text}, 'NA')" for text in fields.values())
    return (
        text_lines(section, ["", title, ",".join(fields)])
        + f"\nUNION ALL SELECT {section}, 2 + row_number() OVER (ORDER BY {order}), concat_ws(',', {values}) FROM {source}"
    )


def number_text(value: str, digits: int) -> str:
    """SQL of a double rounded and printed without zeros at its end."""
    return f"regexp_replace(printf('%.{digits}f', round({value}, {digits})), '\\.?0+$', '')"
