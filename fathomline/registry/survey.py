"""Queries for survey biomass."""

from fathomline.operators import grid
from fathomline.plans import survey as b
from fathomline.registry import register

_SPECIES = "CASE WHEN species_code = 30020 THEN 'SST' ELSE 'non-SST' END AS species"
_REGION = """CASE WHEN survey = 'AI' AND area = 'SBS' THEN 'SBS' WHEN survey = 'AI' AND area LIKE '%AI%' THEN 'AI'
     ELSE survey END AS region"""
_AREA = "CASE WHEN area IN ('Eastern AI', 'Central AI', 'Western AI') THEN 'AI' ELSE area END AS region"

STRATA_SQL = {
    "strata": f"""
SELECT species, region, year, biomass, var, CASE WHEN biomass = 0 THEN 0 ELSE sqrt(var) / biomass END AS cv
FROM (SELECT {_SPECIES}, {_REGION}, year, sum(biomass) AS biomass, sum(var) AS var
      FROM survey_zeros GROUP BY 1, 2, 3) s""",
    "areas": f"""
SELECT species, region, year, biomass, var, sqrt(var) / nullif(biomass, 0) AS cv
FROM (SELECT {_SPECIES}, {_AREA}, year, sum(biomass) AS biomass, sum(var) AS var
      FROM survey_zeros GROUP BY 1, 2, 3) s""",
}
_ROUND = "round(biomass, 6) AS biomass, round(var, 2) AS var, round(cv, 6) AS cv"
DIGITS = {"biomass": 6, "var": 2, "lci": 3, "uci": 3}
USES = ("survey_zeros",)


def strata(t):
    return b.biomass_strata(t["survey_zeros"])


def areas(t):
    return b.biomass_strata(t["survey_zeros"], "area", "null")


register(
    "biomass_strata",
    strata,
    f"SELECT species, region, year, {_ROUND} FROM strata",
    uses=USES,
    extra=STRATA_SQL,
    digits=DIGITS,
)

register(
    "biomass_strata_area",
    areas,
    f"SELECT species, region, year, {_ROUND} FROM areas",
    uses=USES,
    extra=STRATA_SQL,
    digits=DIGITS,
)

register(
    "biomass_complex_all",
    lambda t: b.biomass_complex_all(t["survey_zeros"], "complex"),
    """
SELECT 'complex' AS species, survey AS region, year, round(sum(biomass), 6) AS biomass, round(sum(var), 2) AS var,
       round(CASE WHEN sum(biomass) = 0 THEN 0 ELSE sqrt(sum(var)) / sum(biomass) END, 6) AS cv
FROM survey_zeros GROUP BY survey, year""",
    uses=USES,
    digits=DIGITS,
)

register(
    "biomass_complex_folded",
    lambda t: b.biomass_complex_all(t["survey_zeros"], "complex", b.folded_area()),
    """
SELECT 'complex' AS species, region, year, round(sum(biomass), 6) AS biomass, round(sum(var), 2) AS var,
       round(CASE WHEN sum(biomass) = 0 THEN 0 ELSE sqrt(sum(var)) / sum(biomass) END, 6) AS cv
FROM (SELECT *, CASE WHEN area LIKE '%AI' OR area = 'SBS' THEN 'AI' ELSE area END AS region FROM survey_zeros) s
GROUP BY region, year""",
    uses=USES,
    digits=DIGITS,
)


def _grid(table: str, measures: list[str]) -> str:
    values = ", ".join(f"round(coalesce(s.{m}, 0), {DIGITS[m]}) AS {m}" for m in measures)
    return f"""
SELECT g.species, g.region, g.year, {values}
FROM (SELECT * FROM (SELECT DISTINCT species FROM {table}) a CROSS JOIN (SELECT DISTINCT region FROM {table}) b
      CROSS JOIN (SELECT DISTINCT year FROM {table}) c) g
LEFT JOIN {table} s ON s.species = g.species AND s.region = g.region AND s.year = g.year"""


register(
    "biomass_species_complete",
    lambda t: b.biomass_species_complete(t["survey_zeros"]),
    f"""
SELECT *, CASE region WHEN 'AI' THEN 1 WHEN 'EBS_SHELF' THEN 2 WHEN 'SBS' THEN 3 WHEN 'EBS_SLOPE' THEN 4 END
       AS region_order FROM ({_grid("merged", ["biomass", "var"])}) f""",
    uses=USES,
    extra={
        "merged": f"""
SELECT CASE common_name WHEN 'dusky and dark rockfishes unid.' THEN 'dusky rockfish'
            WHEN 'broadfin thornyhead' THEN 'other thornyhead' WHEN 'longspine thornyhead' THEN 'other thornyhead'
            ELSE common_name END AS species, {_REGION}, year, sum(biomass) AS biomass, sum(var) AS var
FROM survey_zeros WHERE common_name <> 'shortspine thornyhead' GROUP BY 1, 2, 3"""
    },
    digits=DIGITS,
)

register(
    "biomass_species_complete_area",
    lambda t: b.biomass_species_complete(t["survey_zeros"], "area"),
    f"""
SELECT *, CASE region WHEN 'AI' THEN 1 WHEN 'EBS Shelf' THEN 2 WHEN 'SBS' THEN 3 WHEN 'EBS Slope' THEN 4 END
       AS region_order FROM ({_grid("merged", ["biomass", "var"])}) f""",
    uses=USES,
    extra={
        "merged": f"""
SELECT CASE WHEN common_name IN ('dusky and dark rockfishes unid.', 'dusky rockfish') THEN 'dusky and dark rockfish'
            WHEN common_name IN ('broadfin thornyhead', 'longspine thornyhead') THEN 'other thornyhead'
            ELSE common_name END AS species, {_AREA}, year, sum(biomass) AS biomass, sum(var) AS var
FROM survey_zeros WHERE species_code <> 30020 GROUP BY 1, 2, 3"""
    },
    digits=DIGITS,
)

register(
    "biomass_group_complete",
    lambda t: b.biomass_group_complete(t["survey_zeros"]),
    _grid("strata", ["biomass"]),
    uses=USES,
    extra=STRATA_SQL,
    digits=DIGITS,
)

register(
    "species_label",
    lambda t: b.species_label(t["survey_zeros"]),
    f"""
SELECT species, common_name, CASE WHEN region = 'AI' THEN 'AI' ELSE 'EBS' END AS fmp_subarea, region, year,
       round(biomass, 6) AS biomass, label AS species_name,
       CASE WHEN label IN ('dusky', 'SST', 'other thornyheads') THEN label ELSE 'other' END AS species_name2
FROM (SELECT *, {_SPECIES}, {_REGION},
             CASE WHEN common_name = 'shortspine thornyhead' THEN 'SST' WHEN common_name LIKE 'dusky%' THEN 'dusky'
                  WHEN common_name LIKE '%thornyhead' THEN 'other thornyheads'
                  WHEN common_name = 'redbanded rockfish' THEN 'redbanded' END AS label
      FROM survey_zeros) s""",
    uses=USES,
    digits=DIGITS,
)

register(
    "survey_ci",
    lambda t: b.survey_ci(strata(t)),
    f"""
SELECT species, region, year, {_ROUND}, round(greatest(biomass - 1.96 * sqrt(var), 0), 3) AS lci,
       round(biomass + 1.96 * sqrt(var), 3) AS uci FROM strata""",
    uses=USES,
    extra=STRATA_SQL,
    digits=DIGITS,
)

NULL_GRID_SQL = {
    **STRATA_SQL,
    "full_grid": """
SELECT a.species, b.region, c.year, s.biomass, s.var, s.cv
FROM (SELECT DISTINCT species FROM strata) a CROSS JOIN (SELECT DISTINCT region FROM strata) b
CROSS JOIN (SELECT DISTINCT year FROM strata) c
LEFT JOIN strata s ON s.species = a.species AND s.region = b.region AND s.year = c.year
WHERE NOT (a.species = 'SST' AND b.region = 'EBS_SHELF')""",
}

register(
    "survey_grid_nulls",
    lambda t: b.survey_grid_nulls(b.survey_ci(strata(t))),
    f"""
SELECT species, region, year, {_ROUND}, round(greatest(biomass - 1.96 * sqrt(var), 0), 3) AS lci,
       round(biomass + 1.96 * sqrt(var), 3) AS uci FROM full_grid""".replace(
        "greatest(biomass - 1.96 * sqrt(var), 0)",
        "CASE WHEN biomass - 1.96 * sqrt(var) < 0 THEN 0 ELSE biomass - 1.96 * sqrt(var) END",
    ),
    uses=USES,
    extra=NULL_GRID_SQL,
    digits=DIGITS,
)

_REGIONS = ["AI", "EBS_SHELF", "SBS", "EBS_SLOPE"]
register(
    "biomass_cv_table",
    lambda t: b.biomass_cv_table(b.survey_grid_nulls(strata(t))),
    "SELECT species, year,\n"
    + ",\n".join(f"       max(CASE WHEN region = '{r}' THEN cell END) AS \"{r}\"" for r in _REGIONS)
    + """
FROM (SELECT species, year, region, CASE WHEN cv IS NULL OR round_even(cv, 2) = 0 THEN amount
             ELSE amount || ' (' || printf('%.2f', cv) || ')' END AS cell
      FROM (SELECT *, coalesce(format('{:,.0f}', biomass), '') AS amount FROM full_grid) a) c
GROUP BY species, year""",
    uses=USES,
    extra=NULL_GRID_SQL,
)


def _na_cell(value: str, table: str, column: str, names: list[str], where: str = "") -> str:
    """SQL of a year by stratum table of 'value (cv)' text."""
    return (
        "SELECT year,\n"
        + ",\n".join(f"       max(CASE WHEN {column} = '{n}' THEN cell END) AS \"{n}\"" for n in names)
        + f"""
FROM (SELECT year, {column}, format('{{:,.0f}}', {value}) || ' (' ||
             coalesce(regexp_replace(regexp_replace(printf('%.2f', round_even(cv, 2)), '0+$', ''), '\\.$', ''), 'NA')
             || ')' AS cell
      FROM {table} {where}) c
GROUP BY year"""
    )


_AREAS = ["EBS Shelf", "AI", "SBS", "EBS Slope"]
register(
    "biomass_cv_table_na",
    lambda t: b.cv_table(
        areas(t).filter("species = 'non-SST'"), _AREAS, grid(t.spark, year=range(1990, 2003)), "region"
    ),
    f"""
SELECT CAST(y.year AS INTEGER) AS year, {", ".join(f'w."{a}"' for a in _AREAS)}
FROM range(1990, 2003) y(year)
LEFT JOIN ({_na_cell("biomass", "areas", "region", _AREAS, "WHERE species = 'non-SST'")}) w ON w.year = y.year""",
    uses=USES,
    extra=STRATA_SQL,
)


def _index(t):
    from fathomline.plans.extraction import lls_index

    return lls_index(t["lls"])


LLS_SQL = {
    "line_index": """
SELECT strata, year, cpue, sqrt(v) / cpue AS cv
FROM (SELECT CASE WHEN geographic_area_name IN ('NE Aleutians slope', 'SE Aleutians slope')
                  THEN 'Eastern AI' ELSE 'EBS Slope' END AS strata, year, sum(rpw) AS cpue, sum(rpw_var) AS v
      FROM lls WHERE country = 'United States' AND geographic_area_name <> 'NW Aleutians slope' GROUP BY 1, 2) s"""
}
register(
    "line_index_table",
    lambda t: b.cv_table(_index(t), ["Eastern AI", "EBS Slope"], value="cpue"),
    _na_cell("cpue", "line_index", "strata", ["Eastern AI", "EBS Slope"]),
    uses=("lls",),
    extra=LLS_SQL,
)

register(
    "zero_obs_flag",
    lambda t: b.drop_years_before(
        b.zero_obs_flag(strata(t)), {"EBS_SLOPE": 1997, "AI": 1996, "SBS": 1996}
    ),
    f"""
SELECT species, region, year, {_ROUND}, biomass = 0 AS zero_obs FROM strata
WHERE NOT (region = 'EBS_SLOPE' AND year < 1997) AND NOT (region IN ('AI', 'SBS') AND year < 1996)""",
    uses=USES,
    extra=STRATA_SQL,
    digits=DIGITS,
)
