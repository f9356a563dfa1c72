"""Queries for length compositions."""

from fathomline.plans import lengths as g
from fathomline.registry import register

_COMPS = {
    "comps": """
SELECT source, fmp_subarea, species_code, year, length, n, n / total AS prop, common_name,
       'N = ' || CAST(CAST(total AS BIGINT) AS VARCHAR) AS n_label
FROM (SELECT c.*, sum(n) OVER (PARTITION BY source, fmp_subarea, species_code, year) AS total, s.common_name
      FROM (SELECT source, fmp_subarea, species_code, year, length, sum(frequency) AS n
            FROM lengths GROUP BY 1, 2, 3, 4, 5) c
      LEFT JOIN survey_species s USING (species_code)) w
WHERE total > 50"""
}
_USES = ("lengths", "survey_species")
LAST = 2001


def _comps(t):
    return g.length_comps(t["lengths"], t["survey_species"])


register(
    "length_comps",
    _comps,
    'SELECT source, fmp_subarea, species_code, year, length, n, round(prop, 6) AS prop, common_name, n_label FROM comps',
    uses=_USES,
    extra=_COMPS,
)

register(
    "length_comps_check",
    lambda t: g.length_comps_check(_comps(t)),
    """
SELECT source, fmp_subarea, species_code, year, round(sum(prop), 6) AS tst
FROM comps GROUP BY source, fmp_subarea, species_code, year""",
    uses=_USES,
    extra=_COMPS,
)


def _panel(name, species, sources, subareas, low, high, first, data_from=None) -> str:
    """SQL of one panel on its spine; sources maps data names to shown names."""
    listed = ", ".join(f"('{new}')" for new in sources.values())
    old = ", ".join(f"'{s}'" for s in sources)
    shown = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in sources.items())
    areas = ", ".join(f"'{s}'" for s in subareas)
    since = f" AND year >= {data_from}" if data_from else ""
    return f"""
SELECT '{name}' AS panel, s.source, CAST(y.year AS INTEGER) AS year, c.fmp_subarea, c.species_code, c.length, c.n,
       round(c.prop, 6) AS prop, c.common_name, c.n_label
FROM (VALUES {listed}) s(source) CROSS JOIN range({first}, {LAST + 1}) y(year)
LEFT JOIN (SELECT * EXCLUDE (source), CASE source {shown} END AS source FROM comps
           WHERE species_code = {species} AND length BETWEEN {low} AND {high}
             AND source IN ({old}) AND fmp_subarea IN ({areas}){since}) c
  ON c.source = s.source AND c.year = y.year"""


_SBS = {"AI BTS": "AI BTS in SBS"}
register(
    "length_year_spine",
    lambda t: g.length_year_spine(_comps(t), g.panels(), LAST),
    "\nUNION ALL\n".join(
        [
            _panel("AI dusky", 30152, {"AI fishery": "AI fishery", "AI BTS": "AI BTS"}, ["AI"], 20, 50, 1997),
            _panel("EBS dusky", 30152, {"EBS fishery": "EBS fishery", **_SBS}, ["EBS", "SBS"], 20, 50, 1997),
            _panel(
                "AI SST", 30020, {s: s for s in ("AI BTS", "AI fishery", "AI LLS")}, ["AI"], 10, 70, 1996, 1996
            ),
            _panel(
                "EBS SST", 30020, {**_SBS, "EBS LLS": "EBS LLS", "EBS fishery": "EBS fishery"}, ["EBS", "SBS"],
                10, 70, 1996, 1997,
            ),
        ]
    ),
    uses=_USES,
    extra=_COMPS,
)
