"""Queries for the catch tables."""

from fathomline.operators import numbered
from fathomline.plans import catch as c
from fathomline.plans import report
from fathomline.plans.labels import COMMON_SPECIES, GEARS
from fathomline.registry import ALL, register
from fathomline.registry.shared import (
    ALL_AREAS,
    CATCH_USES,
    CLEAN_SQL,
    SPLIT_SQL,
    atka,
    cells,
    clean,
    number_text,
    proportion,
    table_lines,
    text_lines,
)
from fathomline.session import settled

DIGITS = {"catch": 4}

register(
    "noncommercial_catch",
    lambda t: c.noncommercial_catch(t["noncomm"], ["ADFG", "IPHC", "NMFS"]),
    """
SELECT collection_year AS year,
       round(sum(CASE WHEN collection_agency = 'ADFG' THEN weight END) / 1000, 3) AS "ADFG",
       round(sum(CASE WHEN collection_agency = 'IPHC' THEN weight END) / 1000, 3) AS "IPHC",
       round(sum(CASE WHEN collection_agency = 'NMFS' THEN weight END) / 1000, 3) AS "NMFS",
       round(sum(weight) / 1000, 3) AS "Total (t)"
FROM noncomm GROUP BY 1""",
    uses=("noncomm",),
    digits={n: 3 for n in ("ADFG", "IPHC", "NMFS", "Total (t)")},
)

register(
    "catch_by_fmp",
    lambda t: c.catch_by_fmp(cells(t, "fmp")),
    """
SELECT year AS "Year", round(sum(tons), 4) AS "BSAI",
       round(sum(CASE WHEN fmp_subarea = 'AI' THEN tons END), 4) AS "AI",
       round(sum(CASE WHEN fmp_subarea = 'EBS' THEN tons END), 4) AS "EBS"
FROM catch GROUP BY year""",
    uses=CATCH_USES,
    extra=SPLIT_SQL,
    digits={"BSAI": 4, "AI": 4, "EBS": 4},
)

_NAMES = ", ".join(f"'{s}'" for s in COMMON_SPECIES)
_WIDE = {
    "lumped": f"""
SELECT year, fmp_subarea, CASE WHEN species_name IN ({_NAMES}) THEN species_name ELSE 'other' END AS species_name,
       tons FROM catch""",
    "wide": "SELECT l.year, l.fmp_subarea,\n"
    + ",\n".join(
        f"       coalesce(sum(CASE WHEN species_name = '{s}' THEN tons END), 0) AS \"{s}\"" for s in COMMON_SPECIES
    )
    + ',\n       sum(tons) AS total, max(p.prop_sst) * 100 AS perc_sst\n'
    "FROM lumped l LEFT JOIN prop p ON l.year = p.year AND l.fmp_subarea = p.fmp_subarea\n"
    "GROUP BY l.year, l.fmp_subarea",
    "rows": "SELECT * FROM (SELECT CAST(year AS VARCHAR) AS y, * EXCLUDE (year) FROM wide)\nUNION ALL\n"
    "SELECT 'Average', fmp_subarea, "
    + ", ".join(f'avg("{s}")' for s in [*COMMON_SPECIES, "total", "perc_sst"])
    + " FROM wide GROUP BY fmp_subarea",
}

register(
    "catch_by_species",
    lambda t: c.catch_by_species(cells(t), proportion(t)),
    'SELECT y AS "Year", fmp_subarea AS "Area",\n'
    + ",\n".join(
        f"       printf('%.1f', \"{s}\")" + (" || '%'" if s == "perc_sst" else "") + f' AS "{title}"'
        for s, title in c.SPECIES_TITLES.items()
    )
    + "\nFROM rows",
    uses=CATCH_USES,
    extra={**SPLIT_SQL, **_WIDE},
)

_KEY = """
CASE nmfs_area WHEN 543 THEN '543 (WAI)' WHEN 542 THEN '542 (CAI)' WHEN 541 THEN '541 (EAI)'
     WHEN 517 THEN '517 (SBS)' WHEN 519 THEN '519 (SBS)' WHEN 521 THEN '521 (EBS Slope)' END AS nmfs_area2,
CASE nmfs_area WHEN 543 THEN 1 WHEN 542 THEN 2 WHEN 541 THEN 3 WHEN 517 THEN 4 WHEN 519 THEN 5
     WHEN 521 THEN 6 END AS area_order"""
_ORDER = "CASE complex WHEN 'SST' THEN 1 WHEN 'non-SST' THEN 2 END AS complex_order"


def _complete(table: str, keys: list[str], source: str) -> str:
    """SQL of a full grid of observed values with 0 for absent rows."""
    letters = [f"k{i}" for i in range(len(keys))]
    grid = " CROSS JOIN ".join(f"(SELECT DISTINCT {k} FROM {source}) {a}" for k, a in zip(keys, letters))
    on = " AND ".join(f"g.{k} = s.{k}" for k in keys)
    return (
        f"SELECT {', '.join('g.' + k for k in keys)}, coalesce(s.catch, 0) AS catch\n"
        f"FROM (SELECT * FROM {grid}) g LEFT JOIN {table} s ON {on}"
    )


register(
    "catch_complex_area",
    lambda t: c.catch_complex_area(cells(t, "nmfs_area")),
    f"""
SELECT nmfs_area, year, complex, round(catch, 4) AS catch, {_KEY}, {_ORDER}
FROM ({_complete("sums", ["year", "nmfs_area", "complex"], "complexes")}) f
WHERE nmfs_area IN (517, 519, 521, 541, 542, 543)""",
    uses=CATCH_USES,
    extra={
        **SPLIT_SQL,
        "sums": "SELECT year, nmfs_area, complex, sum(tons) AS catch FROM complexes GROUP BY 1, 2, 3",
    },
    digits=DIGITS,
)

register(
    "catch_complex_subarea",
    lambda t: c.catch_complex_subarea(cells(t)),
    """
SELECT year, fmp_subarea, complex, round(sum(tons), 4) AS catch
FROM complexes GROUP BY year, fmp_subarea, complex""",
    uses=CATCH_USES,
    extra=SPLIT_SQL,
    digits=DIGITS,
)

register(
    "nonsst_share",
    lambda t: c.nonsst_share(cells(t)),
    """
SELECT year, round(s, 4) AS "SST", round(n, 4) AS "non-SST", round(n / (n + s) * 100, 6) AS prop_nonsst,
       round(avg(n / (n + s) * 100) OVER (), 6) AS mean_prop
FROM (SELECT year, coalesce(sum(CASE WHEN complex = 'SST' THEN tons END), 0) AS s,
             coalesce(sum(CASE WHEN complex = 'non-SST' THEN tons END), 0) AS n
      FROM complexes GROUP BY year) w""",
    uses=CATCH_USES,
    extra=SPLIT_SQL,
    digits={"SST": 4, "non-SST": 4},
)

_LUMPED = {"lumped": _WIDE["lumped"]}

register(
    "catch_major_species",
    lambda t: c.catch_major_species(cells(t)),
    f"SELECT * REPLACE (round(catch, 4) AS catch) FROM "
    f"({_complete('sums', ['year', 'species_name2', 'fmp_subarea'], 'sums')}) f",
    uses=CATCH_USES,
    extra={
        **SPLIT_SQL,
        **_LUMPED,
        "sums": """
SELECT year, fmp_subarea, CASE WHEN species_name IN ('dusky', 'SST', 'other thornyheads') THEN species_name
       ELSE 'other' END AS species_name2, sum(tons) AS catch FROM lumped GROUP BY 1, 2, 3""",
    },
    digits=DIGITS,
)

register(
    "catch_other_species",
    lambda t: c.catch_other_species(cells(t)),
    f"SELECT * REPLACE (round(catch, 4) AS catch) FROM "
    f"({_complete('sums', ['year', 'species_name', 'fmp_subarea'], 'sums')}) f",
    uses=CATCH_USES,
    extra={
        **SPLIT_SQL,
        **_LUMPED,
        "sums": """
SELECT year, fmp_subarea, species_name, sum(tons) AS catch FROM lumped
WHERE species_name NOT IN ('dusky', 'SST', 'other thornyheads') GROUP BY 1, 2, 3""",
    },
    digits=DIGITS,
)

# --- fisheries ---------------------------------------------------------------
_TARGET = """CASE WHEN target = 'Atka Mackerel' THEN 'Atka mackerel'
     WHEN target IN ('Greenland Turbot - BSAI', 'Kamchatka Flounder - BSAI', 'Rock Sole - BSAI', 'Flathead Sole',
                     'Other Flatfish - BSAI', 'Yellowfin Sole - BSAI') THEN 'Flatfish'
     WHEN target = 'Pacific Cod' THEN 'Pacific cod'
     WHEN target IN ('Pollock - midwater', 'Pollock - bottom') THEN 'Pollock'
     WHEN target IN ('Rockfish', 'Halibut', 'Sablefish') THEN target ELSE 'Other' END AS target_fishery"""
_GEAR = """CASE WHEN gear IN ('NPT', 'TRW') THEN 'Bottom trawl' WHEN gear = 'PTR' THEN 'Pelagic trawl'
     WHEN gear = 'POT' THEN 'Pot' WHEN gear = 'HAL' THEN 'Longline' WHEN gear = 'JIG' THEN 'Jig' END AS gear_name"""
_CLASSED = {"classed": f"SELECT *, {_TARGET}, {_GEAR} FROM complexes"}

register(
    "classify_fishery",
    lambda t: c.classify_fishery(clean(t)).select("year", "gear", "target", "target_fishery", "gear_name", "tons"),
    f"SELECT year, gear, target, {_TARGET}, {_GEAR}, tons FROM clean",
    uses=("catch_raw",),
    extra=CLEAN_SQL,
)

_TOP = {
    **SPLIT_SQL,
    **_CLASSED,
    "fisheries": "SELECT *, target_fishery || ' ' || gear_name AS fishery FROM classed",
    "ranked": """
SELECT fishery, complex, sum(tons) AS catch, rank() OVER (ORDER BY sum(tons) DESC) AS place
FROM fisheries GROUP BY fishery, complex""",
    "shown": """
SELECT fishery, complex, catch, CASE WHEN place <= 5 THEN 'top' END AS top,
       CASE WHEN place <= 5 THEN fishery WHEN fishery LIKE '%trawl%' THEN 'Other trawl'
            ELSE 'Other fixed gear' END AS plot_fishery
FROM ranked""",
}

register(
    "top_fisheries",
    lambda t: c.top_fisheries(cells(t, "target", "gear")),
    "SELECT * REPLACE (round(catch, 4) AS catch) FROM shown",
    uses=CATCH_USES,
    extra=_TOP,
    digits=DIGITS,
)


def _shown(keys: str) -> dict[str, str]:
    return {
        **_TOP,
        "sums": f"""
SELECT {keys}, s.plot_fishery, f.complex, sum(f.tons) AS catch
FROM fisheries f JOIN shown s ON f.fishery = s.fishery AND f.complex = s.complex
GROUP BY ALL""",
    }


register(
    "catch_fishery_subarea",
    lambda t: c.catch_fishery_subarea(cells(t, "target", "gear")),
    f"SELECT * REPLACE (round(catch, 4) AS catch), {_ORDER} FROM "
    f"({_complete('sums', ['year', 'fmp_subarea', 'plot_fishery', 'complex'], 'sums')}) f",
    uses=CATCH_USES,
    extra=_shown("f.year, f.fmp_subarea"),
    digits=DIGITS,
)

register(
    "catch_fishery_area",
    lambda t: c.catch_fishery_area(cells(t, "nmfs_area", "target", "gear")),
    f"SELECT * REPLACE (round(catch, 4) AS catch), {_KEY}, {_ORDER} FROM "
    f"({_complete('sums', ['year', 'nmfs_area', 'plot_fishery', 'complex'], 'sums')}) f\n"
    "WHERE nmfs_area IN (517, 519, 521, 541, 542, 543)",
    uses=CATCH_USES,
    extra=_shown("f.year, f.nmfs_area"),
    digits=DIGITS,
)

register(
    "catch_fishery_region",
    lambda t: c.catch_fishery_region(cells(t, "nmfs_area", "target", "gear")),
    f"SELECT * REPLACE (round(catch, 4) AS catch), "
    "CASE region2 WHEN 'AI' THEN 1 WHEN 'SBS' THEN 2 ELSE 3 END AS region_order FROM "
    f"({_complete('regions', ['year', 'region2', 'plot_fishery', 'complex'], 'regions')}) f",
    uses=CATCH_USES,
    extra={
        **_shown("f.year, f.nmfs_area"),
        "regions": """
SELECT year, CASE WHEN nmfs_area > 540 THEN 'AI' WHEN nmfs_area = 521 THEN 'EBS Slope' ELSE 'SBS' END AS region2,
       plot_fishery, complex, sum(catch) AS catch
FROM sums WHERE nmfs_area IN (517, 519, 521, 541, 542, 543) GROUP BY ALL""",
    },
    digits=DIGITS,
)


def _drop0(expression: str) -> str:
    return f"regexp_replace(printf('%.1f', {expression}), '\\.0$', '')"


register(
    "gear_target_pct",
    lambda t: c.gear_target_pct(cells(t, "target", "gear")),
    'SELECT "Target fishery",\n'
    + ",\n".join(f'       {_drop0(chr(34) + g + chr(34))} AS "{g}"' for g in [*GEARS, "Total"])
    + "\nFROM (SELECT * FROM percents UNION ALL SELECT 'Total', "
    + ", ".join(f'sum("{g}")' for g in [*GEARS, "Total"])
    + " FROM percents) p",
    uses=CATCH_USES,
    extra={
        **SPLIT_SQL,
        **_CLASSED,
        "percents": 'SELECT target_fishery AS "Target fishery",\n'
        + ",\n".join(
            f"       coalesce(sum(CASE WHEN gear_name = '{g}' THEN tons END), 0) "
            f'/ (SELECT sum(tons) FROM catch) * 100 AS "{g}"'
            for g in GEARS
        )
        + ',\n       sum(tons) / (SELECT sum(tons) FROM catch) * 100 AS "Total"\nFROM classed GROUP BY 1',
    },
)

register(
    "catch_gear_trend",
    lambda t: c.catch_gear_trend(cells(t, "gear", "target")),
    f"SELECT * REPLACE (round(catch, 4) AS catch) FROM "
    f"({_complete('sums', ['year', 'gear_name', 'fmp_subarea'], 'sums')}) f",
    uses=CATCH_USES,
    extra={
        **SPLIT_SQL,
        **_CLASSED,
        "sums": "SELECT year, gear_name, fmp_subarea, sum(tons) AS catch FROM classed GROUP BY ALL",
    },
    digits=DIGITS,
)

register(
    "catch_target_trend",
    lambda t: c.catch_target_trend(cells(t, "gear", "target")),
    f"SELECT * REPLACE (round(catch, 4) AS catch) FROM "
    f"({_complete('sums', ['year', 'target2', 'fmp_subarea'], 'sums')}) f",
    uses=CATCH_USES,
    extra={
        **SPLIT_SQL,
        **_CLASSED,
        "sums": """
SELECT year, CASE WHEN target_fishery IN ('Pollock', 'Halibut') THEN 'Other' ELSE target_fishery END AS target2,
       fmp_subarea, sum(tons) AS catch FROM classed GROUP BY ALL""",
    },
    digits=DIGITS,
)


def _subsets(t):
    rows = cells(t, "nmfs_area", "target", "gear", species=("dusky", "SST"))
    return c.detailed_catch_byarea(rows, ALL_AREAS, ["species_name", "fmp_subarea"])


_AREA_COLUMNS = [str(a) for a in ALL_AREAS]
_DETAIL_COLUMNS = [*_AREA_COLUMNS, "Total (t)", "% of total"]

register(
    "detailed_catch_byarea",
    _subsets,
    'SELECT species_name, fmp_subarea, "Gear", "Target fishery",\n'
    + ",\n".join(f'       {_drop0(chr(34) + n + chr(34))} AS "{n}"' for n in _DETAIL_COLUMNS)
    + "\nFROM (SELECT * FROM parts UNION ALL SELECT species_name, fmp_subarea, 'Total (t)', NULL, "
    + ", ".join(f'sum("{n}")' for n in _DETAIL_COLUMNS)
    + " FROM parts GROUP BY 1, 2) p",
    uses=CATCH_USES,
    extra={
        **SPLIT_SQL,
        **_CLASSED,
        "parts": 'SELECT species_name, fmp_subarea, gear_name AS "Gear", target_fishery AS "Target fishery",\n'
        + ",\n".join(
            f'       coalesce(sum(CASE WHEN nmfs_area = {a} THEN tons END), 0) AS "{a}"' for a in _AREA_COLUMNS
        )
        + ',\n       sum(tons) AS "Total (t)",\n'
        '       sum(tons) / sum(sum(tons)) OVER (PARTITION BY species_name, fmp_subarea) * 100 AS "% of total"\n'
        "FROM classed WHERE species_name IN ('dusky', 'SST') GROUP BY 1, 2, 3, 4",
    },
)

# --- discards ----------------------------------------------------------------
register(
    "discard_table",
    lambda t: c.discard_table(cells(t, "retained_or_discarded")),
    """
SELECT fmp_subarea AS "Area", year AS "Year", printf('%.0f', d) AS "Discarded", printf('%.0f', r) AS "Retained",
       printf('%.0f', r + d) AS "Total catch", printf('%.1f', d / (r + d) * 100) || '%' AS "Percent discarded"
FROM (SELECT fmp_subarea, year, sum(CASE WHEN retained_or_discarded = 'R' THEN tons END) AS r,
             sum(CASE WHEN retained_or_discarded <> 'R' THEN tons END) AS d
      FROM catch GROUP BY 1, 2) w""",
    uses=CATCH_USES,
    extra=SPLIT_SQL,
)

_RATE = {
    **SPLIT_SQL,
    "rates": """
SELECT complex, year, sum(CASE WHEN retained_or_discarded = 'D' THEN tons ELSE 0 END) / sum(tons) AS discard_rate
FROM complexes GROUP BY 1, 2""",
}

register(
    "discard_rate",
    lambda t: c.discard_rate(cells(t, "retained_or_discarded")),
    "SELECT complex, year, round(discard_rate, 6) AS discard_rate FROM rates",
    uses=CATCH_USES,
    extra=_RATE,
)

register(
    "discard_rate_summary",
    lambda t: c.discard_rate_summary(cells(t, "retained_or_discarded")),
    """
SELECT complex, round(avg(discard_rate), 6) AS mean_discard_rate,
       round(stddev_samp(discard_rate), 6) AS sd_discard_rate FROM rates GROUP BY complex""",
    uses=CATCH_USES,
    extra=_RATE,
)

register(
    "discard_complete",
    lambda t: c.discard_complete(cells(t, "retained_or_discarded")),
    f"SELECT * REPLACE (round(catch, 4) AS catch), {_ORDER} FROM "
    f"({_complete('sums', ['year', 'fmp_subarea', 'complex', 'retained_or_discarded'], 'sums')}) f",
    uses=CATCH_USES,
    extra={
        **SPLIT_SQL,
        "sums": """
SELECT fmp_subarea, complex, year,
       CASE WHEN retained_or_discarded = 'D' THEN 'Discarded' ELSE 'Retained' END AS retained_or_discarded,
       sum(tons) AS catch FROM complexes GROUP BY 1, 2, 3, 4""",
    },
    digits=DIGITS,
)

# --- relations, maps, extracts -----------------------------------------------
_RELATION = {
    **SPLIT_SQL,
    "sums": """
SELECT complex, year, '541 (EAI)' AS nmfs_area2, sum(tons) AS catch
FROM (SELECT 'Atka mackerel' AS complex, year, reporting_area_code AS nmfs_area, weight_posted AS tons
      FROM catch_raw WHERE trip_target_name = 'Atka Mackerel'
      UNION ALL
      SELECT complex, year, nmfs_area, tons FROM complexes WHERE fmp_subarea = 'AI' AND complex = 'non-SST') b
WHERE nmfs_area = 541 GROUP BY 1, 2""",
    "relation": f"""
SELECT *, CASE WHEN max(catch) OVER w = min(catch) OVER w THEN 0
               ELSE (catch - min(catch) OVER w) / (max(catch) OVER w - min(catch) OVER w) * 2 - 1 END AS norm_catch
FROM ({_complete("sums", ["year", "nmfs_area2", "complex"], "sums")}) f
WINDOW w AS (PARTITION BY complex, nmfs_area2)""",
}


def _relation(t):
    return c.normalized_catch_relation(atka(t), cells(t, "nmfs_area"))


register(
    "normalized_catch_relation",
    _relation,
    """
SELECT year, nmfs_area2, complex, round(catch, 4) AS catch, round(norm_catch, 6) + 0.0 AS norm_catch FROM relation""",
    uses=CATCH_USES,
    extra=_RELATION,
    digits=DIGITS,
)

register(
    "normalized_catch_correlation",
    lambda t: c.normalized_catch_correlation(_relation(t)),
    """
SELECT nmfs_area2, round(corr(a, b), 6) AS correlation
FROM (SELECT nmfs_area2, year, max(CASE WHEN complex = 'Atka mackerel' THEN norm_catch END) AS a,
             max(CASE WHEN complex = 'non-SST' THEN norm_catch END) AS b FROM relation GROUP BY 1, 2) w
GROUP BY nmfs_area2""",
    uses=CATCH_USES,
    extra=_RELATION,
)

register(
    "catch_export",
    lambda t: c.catch_export(clean(t)),
    f"SELECT year, date, nmfs_area, {_TARGET} FROM clean",
    uses=("catch_raw",),
    extra=CLEAN_SQL,
)



def _by_map_area(t):
    """The areas are those of the settled sums, so that the landings are read once."""
    summed = settled(cells(t, "nmfs_area"))
    return c.catch_by_map_area(summed, summed.select("nmfs_area"))


register(
    "catch_by_map_area",
    _by_map_area,
    """
SELECT a.nmfs_area AS "REP_AREA", m.map, round(sum(CASE WHEN m.map = 'All Other Rockfish' OR m.map = k.label
       THEN k.tons END), 4) AS catch
FROM (SELECT DISTINCT nmfs_area FROM catch) a
CROSS JOIN (VALUES ('All Other Rockfish'), ('Non-SST'), ('SST')) m(map)
LEFT JOIN (SELECT nmfs_area, tons, CASE WHEN complex = 'SST' THEN 'SST' ELSE 'Non-SST' END AS label
           FROM complexes) k ON k.nmfs_area = a.nmfs_area
GROUP BY 1, 2""",
    uses=CATCH_USES,
    extra=SPLIT_SQL,
    digits=DIGITS,
)

_POINT = """
SELECT {lon} AS lon, latdd_start AS lat, haul_join, extrapolated_weight AS catch, year, nmfs_area, {fmp} AS fmp
FROM obs_points
WHERE year IN (1996, 1997, 1998, 1999, 2000) AND londd_start IS NOT NULL AND latdd_start IS NOT NULL"""

register(
    "observer_points",
    lambda t: c.observer_points(t["obs_points"], range(1996, 2001)),
    _POINT.format(
        lon="CASE WHEN londd_start > 0 THEN londd_start - 360 ELSE londd_start END",
        fmp="CASE WHEN nmfs_area > 600 THEN 2 ELSE 4 END",
    ),
    uses=("obs_points",),
)

register(
    "observer_points_east",
    lambda t: c.observer_points(t["obs_points"], range(1996, 2001), "east"),
    _POINT.format(
        lon="CASE WHEN londd_start < 0 THEN londd_start + 360 ELSE londd_start END",
        fmp="CASE WHEN nmfs_area = 610 THEN 4 ELSE 6 END",
    ),
    uses=("obs_points",),
)

# --- tables in print order ---------------------------------------------------
_PERCENTS = {**ALL["gear_target_pct"].extra}
_GEAR_ROWS = (
    "(SELECT * FROM percents UNION ALL SELECT 'Total', " + ", ".join(f'sum("{g}")' for g in [*GEARS, "Total"]) + " FROM percents) p"
)
_GEAR_ORDER = "\"Target fishery\" = 'Total', \"Total\" DESC, \"Target fishery\""
_GEAR_FIELDS = {"Target fishery": '"Target fishery"', **{g: _drop0(f'"{g}"') for g in [*GEARS, "Total"]}}
_SPECIES_FIELDS = {"Year": "y", "Area": "fmp_subarea"} | {
    title: f"coalesce(printf('%.1f', \"{s}\"), 'NA')" + (" || '%'" if s == "perc_sst" else "")
    for s, title in c.SPECIES_TITLES.items()
}
_SPECIES_ORDER = "fmp_subarea, y = 'Average', y"


def _in_order(fields, source, order):
    """SQL of text fields with their place in print order."""
    columns = ", ".join(f'{text} AS "{name}"' for name, text in fields.items())
    return f"SELECT {columns}, CAST(row_number() OVER (ORDER BY {order}) - 1 AS BIGINT) AS row_no FROM {source}"


register(
    "gear_target_in_order",
    lambda t: numbered(c.gear_target_pct(cells(t, "target", "gear"))),
    _in_order(_GEAR_FIELDS, _GEAR_ROWS, _GEAR_ORDER),
    uses=CATCH_USES,
    extra=_PERCENTS,
)
register(
    "catch_by_species_in_order",
    lambda t: numbered(c.catch_by_species(cells(t), proportion(t))),
    _in_order(_SPECIES_FIELDS, "rows", _SPECIES_ORDER),
    uses=CATCH_USES,
    extra={**SPLIT_SQL, **_WIDE},
)

_DETAIL_FIELDS = {"Gear": '"Gear"', "Target fishery": '"Target fishery"', **{n: _drop0(f'"{n}"') for n in _DETAIL_COLUMNS}}
_FMP_FIELDS = {"Year": 'CAST("Year" AS VARCHAR)', **{n: number_text(f'"{n}"', 4) for n in ("BSAI", "AI", "EBS")}}
_DISCARD_FIELDS = {"Area": '"Area"', "Year": 'CAST("Year" AS VARCHAR)'} | {
    n: f'"{n}"' for n in ("Discarded", "Retained", "Total catch", "Percent discarded")
}
_SUBSETS = [(s, a) for s in ("dusky", "SST") for a in ("EBS", "AI")]

register(
    "catch_report",
    lambda t: report.catch_report(
        cells(t, "fmp", "nmfs_area", "target", "gear", "retained_or_discarded"),
        proportion(t),
        ALL_AREAS,
        "catch_raw",
        "10/03/2022",
        digits=4,
    ),
    "\nUNION ALL ".join(
        [
            text_lines(0, ["Catch tables", "Catch from catch_raw, queried 10/03/2022"]),
            table_lines(1, "Total catch (t) by FMP and FMP subarea", _FMP_FIELDS, "by_fmp", '"Year"'),
            table_lines(
                2, "Catch (t) by species and percent shortspine thornyhead in the thornyhead catch", _SPECIES_FIELDS, "rows", _SPECIES_ORDER
            ),
            table_lines(3, "Percentage of the total catch by target fishery and gear type", _GEAR_FIELDS, _GEAR_ROWS, _GEAR_ORDER),
            *[
                table_lines(
                    number,
                    f"Sum of total catch (t) of {area} {species} by target fishery and gear type",
                    _DETAIL_FIELDS,
                    f"(SELECT * FROM detail WHERE species_name = '{species}' AND fmp_subarea = '{area}') d",
                    f"\"Gear\" = 'Total (t)', CAST({_drop0(chr(34) + 'Total (t)' + chr(34))} AS DOUBLE) DESC, \"Gear\", \"Target fishery\"",
                )
                for number, (species, area) in enumerate(_SUBSETS, 4)
            ],
            table_lines(8, "Retained and discarded catch by area and year", _DISCARD_FIELDS, "discards", '"Area", "Year"'),
        ]
    ),
    uses=CATCH_USES,
    extra={
        **SPLIT_SQL,
        **_WIDE,
        **_PERCENTS,
        "parts": ALL["detailed_catch_byarea"].extra["parts"],
        "detail": "SELECT * FROM parts UNION ALL SELECT species_name, fmp_subarea, 'Total (t)', NULL, "
        + ", ".join(f'sum("{n}")' for n in _DETAIL_COLUMNS)
        + " FROM parts GROUP BY 1, 2",
        "by_fmp": ALL["catch_by_fmp"].sql,
        "discards": ALL["discard_table"].sql,
    },
)
