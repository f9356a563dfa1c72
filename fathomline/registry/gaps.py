"""Catch tables over records with missing values and ties, where a missing value has to spread."""

from pyspark.sql import functions as F

from fathomline.plans import catch as c
from fathomline.plans import extraction
from fathomline.plans.labels import GEARS
from fathomline.registry import register
from fathomline.registry.catch import _CLASSED, _GEAR_FIELDS, _TOP
from fathomline.registry.shared import HAUL_AREAS, SPLIT_SQL, THORNYHEADS

USES = ("catch_gaps", "obs_haul_gaps", "obs_spcomp")


def _share(t):
    return extraction.class_proportion_of_hauls(t["obs_spcomp"], t["obs_haul_gaps"], THORNYHEADS, HAUL_AREAS)


def _cells(t, *keys):
    # as a table: nested CASEs inside the name clean-up would outgrow generated code
    t.settle("catch_gaps")
    return c.catch_cells(t["catch_gaps"], _share(t), keys)


def _over(extra: dict[str, str], raw: str, hauls: str = "obs_haul_gaps") -> dict[str, str]:
    """The named queries over other records and hauls."""
    return {name: text.replace("FROM catch_raw", f"FROM {raw}").replace("JOIN obs_haul h", f"JOIN {hauls} h") for name, text in extra.items()}


def _sum(value: str, where: str = "true") -> str:
    """A sum that is missing as soon as one of its inputs is."""
    return f"CASE WHEN count(CASE WHEN {where} AND {value} IS NULL THEN 1 END) = 0 THEN sum(CASE WHEN {where} THEN {value} END) END"


_GAPS = _over(SPLIT_SQL, "catch_gaps")
_GAP_CLASSES = {**_GAPS, **_CLASSED}

register(
    "gaps_catch_by_species",
    lambda t: c.yearly(_cells(t), "year", "fmp_subarea", "species_name"),
    f"SELECT year, fmp_subarea, species_name, round({_sum('tons')}, 4) AS catch FROM catch GROUP BY 1, 2, 3",
    uses=USES,
    extra=_GAPS,
    digits={"catch": 4},
)
register(
    "gaps_catch_by_fmp",
    lambda t: c.catch_by_fmp(_cells(t, "fmp")),
    f"""
SELECT year AS "Year", round({_sum("tons", "fmp = 'BSAI'")}, 4) AS "BSAI", round({_sum("tons", "fmp_subarea = 'AI'")}, 4) AS "AI",
       round({_sum("tons", "fmp_subarea = 'EBS'")}, 4) AS "EBS"
FROM catch GROUP BY year""",
    uses=USES,
    extra=_GAPS,
    digits={"BSAI": 4, "AI": 4, "EBS": 4},
)
register(
    "gaps_discard_table",
    lambda t: c.discard_table(_cells(t, "retained_or_discarded")),
    f"""
SELECT fmp_subarea AS "Area", year AS "Year", coalesce(printf('%.0f', d), 'NA') AS "Discarded", coalesce(printf('%.0f', r), 'NA') AS "Retained",
       coalesce(printf('%.0f', r + d), 'NA') AS "Total catch", coalesce(printf('%.1f', d / (r + d) * 100), 'NA') || '%' AS "Percent discarded"
FROM (SELECT fmp_subarea, year, {_sum("tons", "retained_or_discarded = 'R'")} AS r, {_sum("tons", "retained_or_discarded <> 'R'")} AS d
      FROM catch GROUP BY 1, 2) w""",
    uses=USES,
    extra=_GAPS,
)
register(
    "gaps_discard_rate",
    lambda t: c.discard_rate(_cells(t, "retained_or_discarded")),
    f"""
SELECT complex, year, round(coalesce({_sum("tons", "retained_or_discarded = 'D'")},
         CASE WHEN count(CASE WHEN retained_or_discarded = 'D' AND tons IS NULL THEN 1 END) = 0 THEN 0 END) / {_sum("tons")}, 6) AS discard_rate
FROM complexes GROUP BY 1, 2""",
    uses=USES,
    extra=_GAPS,
)
register(
    "gaps_gear_target_pct",
    lambda t: c.gear_target_pct(_cells(t, "target", "gear").filter(F.col("year") > 1998)),
    "SELECT " + ", ".join(f'{text} AS "{name}"' for name, text in _GEAR_FIELDS.items())
    + " FROM (SELECT *, " + " + ".join(f'"{g}"' for g in GEARS) + ' AS "Total" FROM (SELECT * FROM parts UNION ALL SELECT \'Total\', '
    + ", ".join(f'sum("{g}")' for g in GEARS) + " FROM parts) x) p",
    uses=USES,
    extra={
        **_GAP_CLASSES,
        "later": "SELECT * FROM classed WHERE year > 1998",
        "parts": 'SELECT target_fishery AS "Target fishery", '
        + ", ".join(f"coalesce(sum(CASE WHEN gear_name = '{g}' THEN tons END), 0) / (SELECT sum(tons) FROM later) * 100 AS \"{g}\"" for g in GEARS)
        + " FROM later GROUP BY 1",
    },
)
register(
    "gaps_top_fisheries",
    lambda t: c.top_fisheries(_cells(t, "target", "gear")),
    "SELECT * REPLACE (round(catch, 4) AS catch) FROM shown",
    uses=USES,
    extra={
        **_over(_TOP, "catch_gaps"),
        "fisheries": "SELECT *, target_fishery || ' ' || coalesce(gear_name, 'NA') AS fishery FROM classed",
        "ranked": f"""
SELECT fishery, complex, catch, CASE WHEN catch IS NOT NULL THEN rank() OVER (ORDER BY catch DESC NULLS LAST) END AS place
FROM (SELECT fishery, complex, {_sum("tons")} AS catch FROM fisheries GROUP BY fishery, complex) s""",
    },
    digits={"catch": 4},
)
register(
    "ties_top_fisheries",
    lambda t: c.top_fisheries(c.catch_cells(t["catch_ties"], _share(t), ["target", "gear"])),
    "SELECT * REPLACE (round(catch, 4) AS catch) FROM shown",
    uses=("catch_ties", "obs_haul_gaps", "obs_spcomp"),
    extra=_over(_TOP, "catch_ties"),
    digits={"catch": 4},
)
