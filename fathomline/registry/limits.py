"""Queries for combined uncertainty, limits, apportionment and model comparison."""

from pyspark.sql import functions as F

from fathomline.operators import grid, numbered
from fathomline.plans import limits as l
from fathomline.plans import report
from fathomline.plans.survey import survey_ci, survey_grid_nulls
from fathomline.registry import ALL, register
from fathomline.registry.shared import CATCH_USES, SPLIT_SQL, cells, number_text, table_lines, text_lines
from fathomline.registry.survey import LLS_SQL, NULL_GRID_SQL, STRATA_SQL, _index, areas, strata
from fathomline.session import settled

YEAR = 2001
MODELS = ["Model 20", "Model 22"]


def _combined(t):
    return l.combine_ci(t["model_output"])


def _specs(t):
    combined = settled(_combined(t))
    return settled(l.tier5_specs(l.species_estimates(combined), l.fmp_estimates(combined), YEAR))


def _totals(t):
    return settled(l.totals_by_model(t["model_biomass"]))


def _biomass(t):
    return settled(t["model_biomass"])


def _one_model(df):
    return df.filter(F.col("model_name") == "Model 22")


_FMP = "CASE WHEN region = 'AI' THEN 'AI' ELSE 'EBS' END"
_SPREAD = """sqrt(ln(sum(exp(2 * biomsd + biomsd_sd * biomsd_sd) * (exp(biomsd_sd * biomsd_sd) - 1))
       / (sum(exp(biomsd + 0.5 * biomsd_sd * biomsd_sd)) * sum(exp(biomsd + 0.5 * biomsd_sd * biomsd_sd))) + 1))"""
register(
    "combine_ci",
    _combined,
    """
SELECT level, species, year, "FMP", round(est, 6) AS est, round(sd, 6) AS sd, round(exp(ln(est) - 1.96 * sd), 3) AS lci,
       round(exp(ln(est) + 1.96 * sd), 3) AS uci FROM combined""",
    uses=("model_output",),
    extra={
        "combined": f"""
SELECT 'fmp' AS level, species, year, {_FMP} AS "FMP", sum(re_est) AS est, {_SPREAD} AS sd
FROM model_output GROUP BY species, year, {_FMP}
UNION ALL
SELECT 'species', species, year, NULL, sum(re_est), {_SPREAD} FROM model_output GROUP BY species, year
UNION ALL
SELECT 'total', 'Total Other Rockfish', year, NULL, sum(re_est), {_SPREAD} FROM model_output GROUP BY year"""
    },
    digits={"lci": 3, "uci": 3},
)

_SPECS = {
    "specs": f"""
SELECT t.species, f."FMP", t.m AS "M", t.est AS "Biomass", t.m AS "F_OFL", 0.75 * t.m AS "maxF_ABC",
       0.75 * t.m AS "F_ABC", t.est * t.m AS "OFL", t.est * (0.75 * t.m) AS "maxABC", t.est * (0.75 * t.m) AS "ABC",
       f.est / t.est * (t.est * (0.75 * t.m)) AS "FMP_ABC", f.est / t.est * (t.est * t.m) AS "FMP_OFL"
FROM (SELECT species, sum(re_est) AS est, CAST(CASE species WHEN 'SST' THEN 0.03 ELSE 0.09 END AS DOUBLE) AS m
      FROM model_output WHERE year = {YEAR} GROUP BY species) t
LEFT JOIN (SELECT species, {_FMP} AS "FMP", sum(re_est) AS est FROM model_output WHERE year = {YEAR}
           GROUP BY 1, 2) f ON t.species = f.species"""
}
_MONEY = {n: 3 for n in ("OFL", "maxABC", "ABC", "FMP_ABC", "FMP_OFL", "Value", "AI ABC", "EBS ABC")}
_RATES = ["M", "Biomass", "F_OFL", "maxF_ABC", "F_ABC", "OFL", "maxABC", "ABC"]

register(
    "tier5_specs",
    _specs,
    """
SELECT species, "FMP", "M", round("Biomass", 6) AS "Biomass", "F_OFL", round("maxF_ABC", 6) AS "maxF_ABC",
       round("F_ABC", 6) AS "F_ABC", round("OFL", 3) AS "OFL", round("maxABC", 3) AS "maxABC",
       round("ABC", 3) AS "ABC", round("FMP_ABC", 3) AS "FMP_ABC", round("FMP_OFL", 3) AS "FMP_OFL" FROM specs""",
    uses=("model_output",),
    extra=_SPECS,
    digits=_MONEY,
)

_LONG = {
    **_SPECS,
    "long": "\nUNION ALL\n".join(
        f"SELECT DISTINCT species, '{v}' AS variable, \"{v}\" AS value FROM specs" for v in _RATES
    )
    + '\nUNION ALL\nSELECT species, "FMP" || \' ABC\', "FMP_ABC" FROM specs',
    "with_total": """
SELECT species, variable, value FROM long
UNION ALL
SELECT 'All Other Rockfish', variable, CASE WHEN variable IN ('M', 'F_OFL', 'maxF_ABC', 'F_ABC') THEN NULL
       ELSE sum(value) END FROM long GROUP BY variable""",
}

register(
    "specs_long",
    lambda t: l.specs_long(_specs(t)),
    """
SELECT species AS "Species", variable AS "Variable", round(value, 3) AS "Value",
       CASE species WHEN 'SST' THEN 1 WHEN 'non-SST' THEN 2 ELSE 3 END AS species_order,
       CAST(list_position(['M', 'Biomass', 'F_OFL', 'maxF_ABC', 'F_ABC', 'OFL', 'maxABC', 'ABC', 'AI ABC', 'EBS ABC'],
                     variable) AS INTEGER) AS variable_order
FROM with_total""",
    uses=("model_output",),
    extra=_LONG,
    digits=_MONEY,
)

register(
    "specs_in_order",
    lambda t: numbered(l.specs_long(_specs(t))).drop("species_order", "variable_order"),
    """
SELECT species AS "Species", variable AS "Variable", round(value, 3) AS "Value", CAST(row_number() OVER (
  ORDER BY CASE species WHEN 'SST' THEN 1 WHEN 'non-SST' THEN 2 ELSE 3 END,
           list_position(['M', 'Biomass', 'F_OFL', 'maxF_ABC', 'F_ABC', 'OFL', 'maxABC', 'ABC', 'AI ABC', 'EBS ABC'], variable)) - 1 AS BIGINT) AS row_no
FROM with_total""",
    uses=("model_output",),
    extra=_LONG,
    digits=_MONEY,
)

register(
    "specs_crossfoot",
    lambda t: l.specs_crossfoot(l.fmp_estimates(_combined(t)), YEAR),
    f"""
SELECT species, year, "FMP", round(biom, 6) AS biom, round(sum(biom) OVER (PARTITION BY species), 6) AS species_biomass,
       round(sum(biom) OVER (PARTITION BY "FMP"), 6) AS fmp_biomass,
       round(biom / sum(biom) OVER (PARTITION BY species), 6) AS fmp_share
FROM (SELECT species, year, {_FMP} AS "FMP", sum(re_est) AS biom FROM model_output
      WHERE year = {YEAR} GROUP BY 1, 2, 3) f""",
    uses=("model_output",),
)

register(
    "specs_ofl_check",
    lambda t: l.specs_ofl_check(_specs(t)),
    """
SELECT "FMP", round(sum("FMP_OFL"), 3) AS "OFL" FROM specs GROUP BY "FMP"
UNION ALL SELECT NULL, round(sum("FMP_OFL"), 3) FROM specs""",
    uses=("model_output",),
    extra=_SPECS,
    digits=_MONEY,
)

# --- limits by model ---------------------------------------------------------
_TOTALS = {
    "totals": """
SELECT species_group, model_name, year, sum(pred) AS pred FROM model_biomass GROUP BY 1, 2, 3""",
    "by_group": """
SELECT species_group, model_name, year, pred AS biomass, m AS "M", pred * m AS "OFL", pred * (0.75 * m) AS "maxABC"
FROM (SELECT *, CAST(CASE species_group WHEN 'SST' THEN 0.03 ELSE 0.09 END AS DOUBLE) AS m FROM totals
      WHERE year = (SELECT max(year) FROM totals)) t""",
}
_USES = ("model_biomass",)
_BIG = {"biomass": 7, "total_biomass": 7, "species_fmp_ABC": 3, "species_fmp_OFL": 3, **_MONEY}

register(
    "abc_ofl_by_group",
    lambda t: l.abc_ofl_by_group(_totals(t)),
    """
SELECT species_group, model_name, year, round(biomass, 7) AS biomass, "M", round("OFL", 3) AS "OFL",
       round("maxABC", 3) AS "maxABC" FROM by_group""",
    uses=_USES,
    extra=_TOTALS,
    digits=_BIG,
)

_SUMMARY = """
SELECT model_name, year, round(biomass, 7) AS biomass, round(ofl, 3) AS "OFL", round(abc, 3) AS "maxABC",
       round((biomass - base_b) / base_b * 100, 6) AS biomass_percent_change,
       round((ofl - base_o) / base_o * 100, 6) AS "OFL_maxABC_percent_change"
FROM (SELECT *, (SELECT biomass FROM sums WHERE model_name = 'Model 20') AS base_b,
             (SELECT ofl FROM sums WHERE model_name = 'Model 20') AS base_o FROM sums) s"""
_SUMS = """
SELECT model_name, year, {biomass} AS biomass, sum("OFL") AS ofl, sum("maxABC") AS abc
FROM by_group GROUP BY model_name, year"""

register(
    "abc_ofl_summary",
    lambda t: l.abc_ofl_summary(l.abc_ofl_by_group(_totals(t)), "Model 20"),
    _SUMMARY,
    uses=_USES,
    extra={**_TOTALS, "sums": _SUMS.format(biomass="sum(biomass)")},
    digits=_BIG,
)

register(
    "abc_ofl_summary_override",
    lambda t: l.abc_ofl_summary(l.abc_ofl_by_group(_totals(t)), "Model 20", {"Model 20": 53248}),
    _SUMMARY,
    uses=_USES,
    extra={
        **_TOTALS,
        "sums": _SUMS.format(
            biomass="CAST(CASE WHEN model_name = 'Model 20' THEN 53248 ELSE sum(biomass) END AS DOUBLE)"
        ),
    },
    digits=_BIG,
)

_SHARES = {
    "shares": """
SELECT *, sum(biomass) OVER (PARTITION BY model_name, species_group) AS total_biomass
FROM (SELECT species_group, model_name, fmp, biomass, m AS "M", biomass * (0.75 * m) AS species_fmp_ABC,
             biomass * m AS species_fmp_OFL
      FROM (SELECT species_group, model_name, CASE WHEN strata = 'AI' THEN 'AI' ELSE 'EBS' END AS fmp,
                   CAST(CASE species_group WHEN 'SST' THEN 0.03 ELSE 0.09 END AS DOUBLE) AS m, sum(pred) AS biomass
            FROM model_biomass WHERE year = (SELECT max(year) FROM model_biomass) GROUP BY 1, 2, 3, 4) a) b"""
}

register(
    "apportionment",
    lambda t: l.apportionment(_biomass(t)),
    """
SELECT species_group, model_name, fmp, round(biomass, 7) AS biomass, "M", round(species_fmp_ABC, 3) AS species_fmp_ABC,
       round(species_fmp_OFL, 3) AS species_fmp_OFL, round(total_biomass, 7) AS total_biomass,
       round(biomass / total_biomass, 6) AS prop_biomass FROM shares""",
    uses=_USES,
    extra=_SHARES,
    digits=_BIG,
)

register(
    "apportionment_pct",
    lambda t: l.apportionment_pct(l.apportionment(_biomass(t))),
    """
SELECT model_name, round(sum(CASE WHEN fmp = 'AI' THEN species_fmp_ABC END) / sum(species_fmp_ABC) * 100, 6) AS "AI",
       round(sum(CASE WHEN fmp = 'EBS' THEN species_fmp_ABC END) / sum(species_fmp_ABC) * 100, 6) AS "EBS"
FROM shares GROUP BY model_name""",
    uses=_USES,
    extra=_SHARES,
)

# --- catch against limits ----------------------------------------------------
_AGAINST = {**SPLIT_SQL, **_TOTALS, **_SHARES}
_BOTH = (*CATCH_USES, "model_biomass")
_NAMES = "CASE name WHEN 'Catch' THEN 1 WHEN '{abc}' THEN 2 ELSE 3 END AS name_order"


def _long_sql(ids: str, wide: str, abc: str = "ABC", ofl: str = "OFL") -> str:
    parts = [f"SELECT {ids}, '{n}' AS name, \"{n}\" AS value FROM w" for n in (abc, ofl, "Catch")]
    return (
        f"SELECT {ids}, name, round(value, 3) AS value, {_NAMES.format(abc=abc)}\n"
        f"FROM (WITH w AS ({wide}) " + " UNION ALL ".join(parts) + ") u"
    )


register(
    "catch_vs_limits_fmp",
    lambda t: l.catch_vs_limits_fmp(_one_model(l.apportionment(_biomass(t))), cells(t)),
    _long_sql(
        'species, "FMP", year',
        """
SELECT a.species_group AS species, a.fmp AS "FMP", c.year, a.species_fmp_ABC AS "ABC*", a.species_fmp_OFL AS "OFL*",
       c.tons AS "Catch"
FROM shares a LEFT JOIN (SELECT year, fmp_subarea, complex, sum(tons) AS tons FROM complexes GROUP BY 1, 2, 3) c
  ON c.fmp_subarea = a.fmp AND c.complex = a.species_group
WHERE a.model_name = 'Model 22'""",
        "ABC*",
        "OFL*",
    ),
    uses=_BOTH,
    extra=_AGAINST,
    digits={"value": 3},
)

register(
    "catch_vs_limits_species",
    lambda t: l.catch_vs_limits_species(_one_model(l.abc_ofl_by_group(_totals(t))), cells(t)),
    _long_sql(
        "species, year",
        """
SELECT a.species_group AS species, c.year, a."maxABC" AS "ABC", a."OFL", c.tons AS "Catch"
FROM by_group a LEFT JOIN (SELECT year, complex, sum(tons) AS tons FROM complexes GROUP BY 1, 2) c
  ON c.complex = a.species_group
WHERE a.model_name = 'Model 22'""",
    ),
    uses=_BOTH,
    extra=_AGAINST,
    digits={"value": 3},
)

register(
    "catch_vs_limits_total",
    lambda t: l.catch_vs_limits_total(_one_model(l.abc_ofl_by_group(_totals(t))), cells(t)),
    _long_sql(
        "species, year",
        """
SELECT 'All Other Rockfish' AS species, c.year, a.abc AS "ABC", a.ofl AS "OFL", c.tons AS "Catch"
FROM (SELECT sum("maxABC") AS abc, sum("OFL") AS ofl FROM by_group WHERE model_name = 'Model 22') a
CROSS JOIN (SELECT year, sum(tons) AS tons FROM catch GROUP BY year) c""",
    ),
    uses=_BOTH,
    extra=_AGAINST,
    digits={"value": 3},
)

_PERCENT = """
SELECT year, round(amount, 3) AS amount, round(total, 3) AS total, round(percent, 6) AS percent,
       round(avg(percent) OVER (), 6) AS mean_percent, round(min(percent) OVER (), 6) AS min_percent,
       round(max(percent) OVER (), 6) AS max_percent
FROM (SELECT year, amount, total, 100 * amount / total AS percent
      FROM (SELECT year, grp, amount, sum(amount) OVER (PARTITION BY year) AS total FROM sums) s
      WHERE grp = 'SST' AND {years}) p"""

register(
    "group_percent",
    lambda t: l.group_percent(
        cells(t).withColumn("grp", l.complex_of_name()), "grp", "tons", before=2001
    ),
    _PERCENT.format(years="year < 2001"),
    uses=CATCH_USES,
    extra={**SPLIT_SQL, "sums": "SELECT year, complex AS grp, sum(tons) AS amount FROM complexes GROUP BY 1, 2"},
    digits={"amount": 3, "total": 3},
)

register(
    "group_percent_biomass",
    lambda t: l.group_percent(_one_model(_totals(t)), "species_group", "pred", first=1996, before=2001),
    _PERCENT.format(years="year < 2001 AND year >= 1996"),
    uses=_USES,
    extra={
        **_TOTALS,
        "sums": "SELECT year, species_group AS grp, pred AS amount FROM totals WHERE model_name = 'Model 22'",
    },
    digits={"amount": 3, "total": 3},
)

_RATIO = {
    **_AGAINST,
    "ratios": """
SELECT a.species_group AS species, a.fmp AS "FMP", a."M" AS "F_OFL", c.year, c.tons AS catch, b.biomass,
       c.tons / b.biomass AS ratio
FROM shares a
LEFT JOIN (SELECT year, fmp_subarea, complex, sum(tons) AS tons FROM complexes GROUP BY 1, 2, 3) c
  ON c.fmp_subarea = a.fmp AND c.complex = a.species_group
LEFT JOIN (SELECT species_group, year, CASE WHEN strata = 'AI' THEN 'AI' ELSE 'EBS' END AS fmp, sum(pred) AS biomass
           FROM model_biomass WHERE model_name = 'Model 22' GROUP BY 1, 2, 3) b
  ON b.species_group = a.species_group AND b.year = c.year AND b.fmp = a.fmp
WHERE a.model_name = 'Model 22'""",
}


def _ratios(t):
    biomass = _one_model(_biomass(t))
    return l.catch_biomass_ratio(l.apportionment(biomass), cells(t), biomass)


register(
    "catch_biomass_ratio",
    _ratios,
    """
SELECT species, "FMP", "F_OFL", year, round(catch, 3) AS "Catch", round(biomass, 7) AS biomass,
       round(ratio, 6) AS ratio FROM ratios""",
    uses=_BOTH,
    extra=_RATIO,
    digits={"Catch": 3, "biomass": 7},
)

register(
    "catch_biomass_mean_ratio",
    lambda t: l.mean_ratio(_ratios(t)),
    'SELECT "FMP", species, round(avg(ratio), 6) AS mean_ratio FROM ratios GROUP BY "FMP", species',
    uses=_BOTH,
    extra=_RATIO,
)

register(
    "catch_biomass_pooled",
    lambda t: l.pooled_ratio(_ratios(t)),
    """
SELECT species, year, round(sum(catch) / sum(biomass) * 100, 6) AS ratio FROM ratios GROUP BY species, year""",
    uses=_BOTH,
    extra=_RATIO,
)

# --- archive -----------------------------------------------------------------
_SARA = {
    **_TOTALS,
    "sara": """
SELECT year, s AS "SST", n AS "non-SST", s + n AS total, s / (s + n) AS p_SST
FROM (SELECT year, max(CASE WHEN species_group = 'SST' THEN pred END) AS s,
             max(CASE WHEN species_group = 'non-SST' THEN pred END) AS n
      FROM totals WHERE model_name = 'Model 22' AND year >= 1991 GROUP BY year) w""",
}


def _sara(t):
    return l.sara_biomass(_one_model(_totals(t)))


register(
    "sara_biomass",
    _sara,
    """
SELECT year, round("SST", 7) AS "SST", round("non-SST", 7) AS "non-SST", round(total, 7) AS total,
       round(p_SST, 6) AS "p_SST", CAST(0.03 AS DOUBLE) AS "SST_M", CAST(0.09 AS DOUBLE) AS "nonSST_M",
       round(0.03 * p_SST + 0.09 * (1 - p_SST), 6) AS "weighted_M" FROM sara""",
    uses=_USES,
    extra=_SARA,
    digits={"SST": 7, "non-SST": 7, "total": 7},
)

_REGIONS = ["AI", "EBS Shelf", "SBS", "EBS Slope"]
register(
    "sara_survey",
    lambda t: l.sara_survey(areas(t), _REGIONS),
    "SELECT year,\n"
    + ",\n".join(f"       round(sum(CASE WHEN region = '{r}' THEN biomass END), 6) AS \"{r}\"" for r in _REGIONS)
    + "\nFROM areas WHERE year >= 1991 GROUP BY year",
    uses=("survey_zeros",),
    extra=STRATA_SQL,
)

register(
    "sara_survey_by_area",
    lambda t: l.sara_survey_by_area(areas(t), range(1995, 2002)),
    "SELECT area,\n"
    + ",\n".join(f'       round(sum(CASE WHEN year = {y} THEN biomass END), 6) AS "{y}"' for y in range(1995, 2002))
    + "\nFROM (SELECT *, CASE WHEN region = 'SBS' THEN 'AI' ELSE region END AS area FROM areas) a GROUP BY area",
    uses=("survey_zeros",),
    extra=STRATA_SQL,
)

register(
    "sara_exploitation",
    lambda t: l.sara_exploitation(cells(t), _sara(t)),
    """
SELECT c.year, round(c.tons, 3) AS catch, round(s.total, 7) AS biomass, round(c.tons / s.total, 6) AS exploitation
FROM (SELECT year, sum(tons) AS tons FROM catch GROUP BY year) c LEFT JOIN sara s ON s.year = c.year""",
    uses=_BOTH,
    extra={**SPLIT_SQL, **_SARA},
    digits={"catch": 3, "biomass": 7},
)

register(
    "sara_annual_catch",
    lambda t: l.sara_annual_catch(cells(t)),
    "SELECT year, round_even(round(sum(tons), 6), 0) AS catch FROM catch GROUP BY year",
    uses=CATCH_USES,
    extra=SPLIT_SQL,
)

_KEYS, _KEY_ORDER, _EST = ["species", "region", "year"], "species, region, year", ["est", "lci", "uci"]


def _shown_fields(keys: list[str], numbers: list[str]) -> dict[str, str]:
    """Printed keys and numbers of a biomass table."""
    return {k: f'CAST("{k}" AS VARCHAR)' for k in keys} | {n: number_text(f'"{n}"', 3) for n in numbers}


def _at_level(level: str) -> str:
    return f"(SELECT * FROM levels WHERE level = '{level}') x"


register(
    "biomass_report",
    lambda t: report.biomass_report(
        survey_grid_nulls(survey_ci(strata(t))),
        t["model_output"].select("species", "region", "year", "re_est"),
        _combined(t),
        "survey_zeros",
        "10/03/2022",
        digits=3,
    ),
    "\nUNION ALL ".join(
        [
            text_lines(0, ["Biomass tables", "Surveys from survey_zeros, queried 10/03/2022"]),
            table_lines(1, "Survey biomass (t) by region with 95% limits", _shown_fields(_KEYS, ["biomass", "var", "lci", "uci"]), "limits", _KEY_ORDER),
            table_lines(2, "Model biomass (t) by region", _shown_fields(_KEYS, ["re_est"]), "model_output", _KEY_ORDER),
            table_lines(3, "Model biomass (t) by FMP with 95% limits", _shown_fields(["species", "FMP", "year"], _EST), _at_level("fmp"), 'species, "FMP", year'),
            table_lines(4, "Model biomass (t) by species with 95% limits", _shown_fields(["species", "year"], _EST), _at_level("species"), "species, year"),
            table_lines(5, "Model biomass (t) of all species with 95% limits", _shown_fields(["year"], _EST), _at_level("total"), "year"),
        ]
    ),
    uses=("survey_zeros", "model_output"),
    extra={
        **NULL_GRID_SQL,
        "limits": """
SELECT species, region, year, biomass, var, CASE WHEN biomass - 1.96 * sqrt(var) < 0 THEN 0 ELSE biomass - 1.96 * sqrt(var) END AS lci,
       biomass + 1.96 * sqrt(var) AS uci FROM full_grid""",
        **ALL["combine_ci"].extra,
        "levels": """
SELECT level, species, year, "FMP", est, exp(ln(est) - 1.96 * sd) AS lci, exp(ln(est) + 1.96 * sd) AS uci FROM combined""",
    },
)

_WHOLE = "coalesce(format('{{:.0f}}', {0}), 'NA')"
_YEARLY = "FROM (SELECT s.year, s.total, c.catch FROM sara s LEFT JOIN annual c ON s.year = c.year) y"
_SURVEYED = {
    "annual": "SELECT year, round_even(round(sum(tons), 6), 0) AS catch FROM catch GROUP BY year",
    "surveyed": "SELECT year, "
    + ", ".join(f"sum(CASE WHEN region = '{r}' THEN biomass END) AS \"{r}\"" for r in _REGIONS)
    + " FROM areas WHERE year >= 1991 GROUP BY year",
}
_EXPORT_EXTRA = {**SPLIT_SQL, **_SARA, **STRATA_SQL, **_SURVEYED}
_EXPORT_USES = tuple(dict.fromkeys((*_BOTH, "survey_zeros")))


def _fixed_lines(section: int, lines: list[str]) -> str:
    """Rows of given lines."""
    return "\nUNION ALL ".join(
        f"SELECT {section} AS section, CAST({k} AS BIGINT) AS row_no, '{line}' AS line" for k, line in enumerate(lines)
    )


def _series_lines(section: int, names: dict[str, str], source: str) -> str:
    """For each name a title and a line of its text by year."""
    rows = []
    for place, (name, text) in enumerate(names.items()):
        rows.append(f"SELECT {section}, {2 * place}, '#{name}'")
        rows.append(f"SELECT {section}, {2 * place + 1}, string_agg({text}, ' ' ORDER BY year) {source}")
    return "\nUNION ALL ".join(rows)


def _own_year_lines(section: int, titles: list[str], column: str, source: str) -> str:
    """Titles, then the years that have a value and their values."""
    n = len(titles)
    known = f"FROM {source} WHERE {column} IS NOT NULL"
    return "\nUNION ALL ".join(
        [f"SELECT {section}, {k}, '{title}'" for k, title in enumerate(titles)]
        + [
            f"SELECT {section}, {n}, coalesce(string_agg(CAST(year AS VARCHAR), ' ' ORDER BY year), '') {known}",
            f"SELECT {section}, {n + 1}, coalesce(string_agg({_WHOLE.format(column)}, ' ' ORDER BY year), '') {known}",
        ]
    )


register(
    "sara_export",
    lambda t: report.archive_export(
        {"STOCK": "COMPLEX", "TIER": "5", "ASMT_YEAR": YEAR, "NUM_SEXES": None},
        _sara(t),
        l.sara_annual_catch(cells(t)),
        l.sara_survey(areas(t), _REGIONS),
    ),
    "\nUNION ALL ".join(
        [
            _fixed_lines(1, ["#STOCK", '"COMPLEX"', "#TIER", '"5"', "#ASMT_YEAR", str(YEAR), "#NUM_SEXES", '"NA"']),
            _series_lines(
                2,
                {
                    "FISHERYYEAR": "CAST(year AS VARCHAR)",
                    "TOTALBIOMASS": _WHOLE.format("total"),
                    "TOTALCATCH": _WHOLE.format("catch"),
                },
                _YEARLY,
            ),
            _series_lines(
                3,
                {"SURVEYYEAR": "CAST(year AS VARCHAR)", **{f"SURVEY_{r}": _WHOLE.format(f'"{r}"') for r in _REGIONS}},
                "FROM surveyed",
            ),
        ]
    ),
    uses=_EXPORT_USES,
    extra=_EXPORT_EXTRA,
)

register(
    "sara_export_short",
    lambda t: report.archive_export_short(
        {"STOCK": "COMPLEX", "TIER": 5, "ASSESSYEAR": YEAR},
        l.sara_annual_catch(cells(t)),
        _sara(t),
        settled(l.sara_survey(areas(t), _REGIONS)),
    ),
    "\nUNION ALL ".join(
        [
            _fixed_lines(1, ["COMPLEX   #STOCK", "5   #TIER", f"{YEAR}   #ASSESSYEAR"]),
            _own_year_lines(2, ["#TOTALCATCH", "1"], "catch", "annual"),
            _own_year_lines(3, ["#ABUNDANCE", "1"], "total", "sara"),
            _fixed_lines(4, ["#SURVEYNAMES   " + "   ".join(_REGIONS), " ".join("1" for _ in _REGIONS)]),
            *[_own_year_lines(4 + k, [f"#SURVEY{k}"], f'"{r}"', "surveyed") for k, r in enumerate(_REGIONS, 1)],
        ]
    ),
    uses=_EXPORT_USES,
    extra=_EXPORT_EXTRA,
)

# --- model comparison --------------------------------------------------------
_PCT = {
    "pct": """
SELECT species_group, strata, year, a AS "Model 20", b AS "Model 22", (b - a) / a * 100 AS d
FROM (SELECT species_group, strata, year, max(CASE WHEN model_name = 'Model 20' THEN pred END) AS a,
             max(CASE WHEN model_name = 'Model 22' THEN pred END) AS b
      FROM model_biomass GROUP BY 1, 2, 3) w"""
}


def _pct(t, signed=False):
    return l.model_compare_pct(t["model_biomass"], *MODELS, signed)


for _key, _signed, _value in (("model_compare_pct", False, "abs(d)"), ("model_compare_signed", True, "d")):
    register(
        _key,
        lambda t, signed=_signed: _pct(t, signed),
        f"""
SELECT species_group, strata, year, round("Model 20", 7) AS "Model 20", round("Model 22", 7) AS "Model 22",
       round({_value}, 6) AS percent_difference FROM pct""",
        uses=_USES,
        extra=_PCT,
        digits={m: 7 for m in MODELS},
    )

register(
    "model_compare_summary",
    lambda t: l.five_numbers(_pct(t), "percent_difference"),
    """
SELECT unnest(['min', 'q1', 'median', 'mean', 'q3', 'max']) AS statistic,
       unnest([round(min(abs(d)), 6), round(quantile_cont(abs(d), 0.25), 6), round(quantile_cont(abs(d), 0.5), 6),
               round(avg(abs(d)), 6), round(quantile_cont(abs(d), 0.75), 6), round(max(abs(d)), 6)]) AS value
FROM pct""",
    uses=_USES,
    extra=_PCT,
)

# the same summary over as many values as there are records
register(
    "five_number_summary",
    lambda t: l.five_numbers(t["noncomm"], "weight"),
    """
SELECT unnest(['min', 'q1', 'median', 'mean', 'q3', 'max']) AS statistic,
       unnest([round(min(weight), 4), round(quantile_cont(weight, 0.25), 4), round(quantile_cont(weight, 0.5), 4),
               round(avg(weight), 4), round(quantile_cont(weight, 0.75), 4), round(max(weight), 4)]) AS value
FROM noncomm""",
    uses=("noncomm",),
    digits={"value": 4},
)

register(
    "model_total_table",
    lambda t: l.model_total_table(_totals(t), MODELS),
    """
SELECT species_group, year, round(sum(CASE WHEN model_name = 'Model 20' THEN pred END), 7) AS "Model 20",
       round(sum(CASE WHEN model_name = 'Model 22' THEN pred END), 7) AS "Model 22"
FROM (SELECT * FROM totals UNION ALL SELECT 'Total', model_name, year, pred FROM totals) u
GROUP BY species_group, year""",
    uses=_USES,
    extra=_TOTALS,
    digits={m: 7 for m in MODELS},
)

register(
    "stratum_share",
    lambda t: l.stratum_share(t["model_biomass"], "Model 20", "SST", "EBS_SLOPE"),
    """
SELECT a.year, round(total, 7) AS total_biom, round(one, 7) AS stratum_biom, round(one / total, 6) AS p
FROM (SELECT year, sum(pred) AS total FROM model_biomass WHERE model_name = 'Model 20' GROUP BY year) a
LEFT JOIN (SELECT year, sum(pred) AS one FROM model_biomass
           WHERE model_name = 'Model 20' AND species_group = 'SST' AND strata = 'EBS_SLOPE' GROUP BY year) b
  ON a.year = b.year""",
    uses=_USES,
    digits={"total_biom": 7, "stratum_biom": 7},
)


def _correlation(t):
    slope = areas(t).filter((F.col("species") == "SST") & (F.col("region") == "EBS Slope"))
    index = _index(t).filter(F.col("strata") == "EBS Slope")
    return l.index_correlation(grid(t.spark, year=range(1995, 2003)), slope, index)


register(
    "index_correlation",
    _correlation,
    """
SELECT round(r, 6) AS r, n, n - 2 AS df, round(r * sqrt((n - 2) / (1 - r * r)), 5) AS t,
       -- the series of the t distribution for 5 degrees of freedom, which seven years give
       round(1 - 2 / pi() * (angle + sin(angle) * (cos(angle) + 2.0 / 3 * cos(angle) ** 3)), 6) AS p_value,
       round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS lci,
       round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS uci
FROM (SELECT *, atan(abs(r * sqrt((n - 2) / (1 - r * r))) / sqrt(n - 2)) AS angle FROM (
      SELECT corr(a.biomass, i.cpue) AS r, count(*) AS n
      FROM (SELECT year, biomass FROM areas WHERE species = 'SST' AND region = 'EBS Slope') a
      JOIN (SELECT year, cpue FROM line_index WHERE strata = 'EBS Slope') i ON a.year = i.year) c) d""",
    uses=("survey_zeros", "lls"),
    extra={**STRATA_SQL, **LLS_SQL},
    digits={"t": 5},
)
