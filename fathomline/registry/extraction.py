"""Queries for the extraction and cleaning steps."""

from pyspark.sql import functions as F

from fathomline.operators import numbered
from fathomline.plans import extraction as x
from fathomline.registry import register
from fathomline.registry.shared import (
    CATCH_USES,
    CLEAN_SQL,
    HAUL_AREAS,
    PROPORTION_SQL,
    SPLIT_SQL,
    THORNYHEADS,
    atka,
    clean,
    proportion,
)

# the part names stand in for species names: listed ones, and a pattern
NAMES, PATTERN = ["small bolt", "red widget"], "ring"

register(
    "species_resolve",
    lambda t: x.agency_codes(
        t["agency_codes"], x.species_subset(t["species_lookup"], NAMES, PATTERN), pattern="RING|WIDGET"
    ),
    """
SELECT species_code, common_name, species_code_race FROM agency_codes
WHERE species_code_race IN (SELECT species_code FROM species_lookup
                            WHERE common_name IN ('small bolt', 'red widget') OR common_name LIKE '%ring%')
  AND (common_name LIKE '%RING%' OR common_name LIKE '%WIDGET%')""",
    uses=("agency_codes", "species_lookup"),
)

register(
    "species_subset",
    lambda t: x.species_subset(t["species_lookup"], NAMES, PATTERN),
    """
SELECT * FROM species_lookup
WHERE common_name IN ('small bolt', 'red widget') OR regexp_matches(common_name, 'ring')""",
    uses=("species_lookup",),
)


def _harmonized(t):
    """All three sources and both lookups come from one table, which is derived once."""
    t.settle("survey_biomass")
    return x.survey_harmonize(
        t["survey_ai_raw"], t["survey_areas"], t["survey_shelf_raw"], t["survey_slope_raw"], t["survey_species"]
    )


register(
    "survey_harmonize",
    _harmonized,
    """
SELECT s.survey, s.year, s.area_code, s.species_code, round(s.biomass, 6) AS biomass, round(s.var, 3) AS var,
       s.area, n.common_name
FROM (SELECT a.SURVEY AS survey, a.YEAR AS year, a.AREA_CODE AS area_code, a.SPECIES_CODE AS species_code,
             a.BIOMASS AS biomass, a.VAR AS var,
             CASE l.area WHEN 'Southern Bering Sea' THEN 'SBS' WHEN 'Eastern Aleutians' THEN 'Eastern AI'
                  WHEN 'Western Aleutians' THEN 'Western AI' WHEN 'Central Aleutians' THEN 'Central AI' END AS area
      FROM survey_ai_raw a LEFT JOIN survey_areas l ON a.SURVEY = l.survey AND a.AREA_CODE = l.area_code
      UNION ALL
      SELECT SURVEY, YEAR, NULL, SPECIES_CODE, BIOMASS, VAR, 'EBS Shelf' FROM survey_shelf_raw
      UNION ALL
      SELECT 'EBS_SLOPE', YEAR, NULL, SPECIES_CODE, BIOMASS, VAR, 'EBS Slope' FROM survey_slope_raw) s
LEFT JOIN survey_species n ON s.species_code = n.species_code""",
    uses=("survey_ai_raw", "survey_areas", "survey_shelf_raw", "survey_slope_raw", "survey_species"),
    digits={"var": 3},
)

register(
    "catch_clean",
    clean,
    "SELECT * FROM clean",
    uses=("catch_raw",),
    extra=CLEAN_SQL,
)

register(
    "catch_extract",
    lambda t: x.catch_clean(x.catch_extract(t["catch_raw"], range(130, 140), "BSAI", 1995)).select(
        "year", "species_code", "species_group", "nmfs_area", "tons"
    ),
    """
SELECT year, agency_species_code AS species_code, species_group_name AS species_group,
       reporting_area_code AS nmfs_area, weight_posted AS tons
FROM catch_raw
WHERE agency_species_code IN (130, 131, 132, 133, 134, 135, 136, 137, 138, 139)
  AND fmp_area = 'BSAI' AND year >= 1995""",
    uses=("catch_raw",),
)

register(
    "observer_join",
    lambda t: x.observer_join(t["obs_spcomp"], t["obs_haul"], THORNYHEADS, HAUL_AREAS),
    """
SELECT s.haul_join, s.species, s.extrapolated_weight, h.nmfs_area, h.gear_type, h.year
FROM obs_spcomp s JOIN obs_haul h ON s.haul_join = h.haul_join
WHERE s.species IN (349, 350, 352) AND h.nmfs_area BETWEEN 500 AND 543""",
    uses=("obs_spcomp", "obs_haul"),
)

# fixed values: reporting areas of the second observer query
LISTED_AREAS = [530, 550, 523, 518, 517, 513, 509, 516, 512, 508, 514, 524, 543, 542, 541, 610]

register(
    "observer_join_areas",
    lambda t: x.observer_join(t["obs_spcomp"], t["obs_haul"], THORNYHEADS, areas=LISTED_AREAS, first_year=1996),
    """
SELECT s.haul_join, s.species, s.extrapolated_weight, h.nmfs_area, h.gear_type, h.year
FROM obs_spcomp s JOIN obs_haul h ON s.haul_join = h.haul_join
WHERE s.species IN (349, 350, 352) AND h.year >= 1996
  AND h.nmfs_area IN (530, 550, 523, 518, 517, 513, 509, 516, 512, 508, 514, 524, 543, 542, 541, 610)""",
    uses=("obs_spcomp", "obs_haul"),
)

register(
    "class_proportion",
    proportion,
    "SELECT year, fmp_subarea, round(prop_sst, 6) AS prop_sst FROM prop",
    uses=("obs_spcomp", "obs_haul"),
    extra=PROPORTION_SQL,
)

register(
    "class_proportion_joined",
    lambda t: x.class_proportion(x.observer_join(t["obs_spcomp"], t["obs_haul"], THORNYHEADS, HAUL_AREAS)),
    "SELECT year, fmp_subarea, round(prop_sst, 6) AS prop_sst FROM prop",
    uses=("obs_spcomp", "obs_haul"),
    extra=PROPORTION_SQL,
)

register(
    "allocate_by_proportion",
    lambda t: x.allocate_by_proportion(clean(t), proportion(t)),
    "SELECT * REPLACE (round(tons, 6) AS tons) FROM catch",
    uses=CATCH_USES,
    extra=SPLIT_SQL,
)

register(
    "lls_index",
    lambda t: x.lls_index(t["lls"]),
    """
SELECT strata, year, round(cpue, 2) AS cpue, round(sqrt(v) / cpue, 6) AS cv
FROM (SELECT CASE WHEN geographic_area_name IN ('NE Aleutians slope', 'SE Aleutians slope')
                  THEN 'Eastern AI' ELSE 'EBS Slope' END AS strata, year,
             coalesce(sum(rpw), 0) AS cpue, coalesce(sum(rpw_var), 0) AS v
      FROM lls
      WHERE country = 'United States'
        AND geographic_area_name NOT IN ('NW Aleutians slope', 'SW Aleutians slope')
      GROUP BY 1, 2) s""",
    uses=("lls",),
    digits={"cpue": 2},
)

register(
    "lls_series",
    lambda t: x.lls_series(t["lls"]),
    """
SELECT geographic_area_name, country, year, round(rpw, 6) AS rpw, round(rpw_var, 6) AS rpw_var,
       round(rpn, 6) AS rpn FROM lls WHERE rpn IS NOT NULL""",
    uses=("lls",),
)

register(
    "lls_length_sum",
    lambda t: x.lls_length_sum(t["lls_len"]),
    """
SELECT year, council_sablefish_management_area, length, round(coalesce(sum(rpw), 0), 3) AS rpw
FROM lls_len
WHERE geographic_area_name LIKE '%Bering%' OR geographic_area_name LIKE '%Aleutians%'
GROUP BY year, council_sablefish_management_area, length""",
    uses=("lls_len",),
    digits={"rpw": 3},
)

register(
    "fishery_length_prep",
    lambda t: x.fishery_length_prep(t["fishery_len"], x.area_lookup(t["catch_raw"], "BSAI")),
    """
SELECT l.nmfs_area, l.year, CASE WHEN l.species_code = 350 THEN 30020 ELSE 30152 END AS species_code,
       l.length, l.frequency, a.fmp, CASE WHEN a.fmp_subarea = 'BS' THEN 'EBS' ELSE a.fmp_subarea END AS fmp_subarea
FROM fishery_len l LEFT JOIN (SELECT DISTINCT fmp_area AS fmp, fmp_subarea, reporting_area_code AS nmfs_area
                              FROM catch_raw WHERE fmp_area = 'BSAI') a ON l.nmfs_area = a.nmfs_area""",
    uses=("fishery_len", "catch_raw"),
)

register(
    "survey_length_prep",
    lambda t: x.survey_length_prep(t["survey_len"]),
    """
SELECT YEAR AS year, STRATUM AS stratum, LENGTH / 10 AS length, SPECIES_CODE AS species_code,
       FREQUENCY AS frequency FROM survey_len""",
    uses=("survey_len",),
)

register(
    "survey_length_in_order",
    lambda t: numbered(x.survey_length_prep(t["survey_len"])),
    """
SELECT YEAR AS year, STRATUM AS stratum, LENGTH / 10 AS length, SPECIES_CODE AS species_code, FREQUENCY AS frequency,
       CAST(row_number() OVER (ORDER BY SPECIES_CODE, YEAR, LENGTH / 10, STRATUM, FREQUENCY) - 1 AS BIGINT) AS row_no
FROM survey_len""",
    uses=("survey_len",),
)

register(
    "survey_length_strata",
    lambda t: x.survey_length_strata(t["survey_len"], t["survey_strata"]),
    """
SELECT l.STRATUM AS stratum, l.YEAR AS year, l.LENGTH / 10 AS length, l.SPECIES_CODE AS species_code,
       l.FREQUENCY AS frequency, CASE WHEN s.area LIKE '%Aleutians%' THEN 'AI' ELSE 'SBS' END AS area,
       s.description
FROM survey_len l
JOIN (SELECT DISTINCT area, stratum,
             CAST(min_depth AS VARCHAR) || '-' || CAST(max_depth AS VARCHAR) || ' m' AS description
      FROM survey_strata) s ON l.STRATUM = s.stratum
WHERE s.area <> 'Chirikof'""",
    uses=("survey_len", "survey_strata"),
)


def _union(t):
    return x.length_union(
        x.fishery_length_prep(t["fishery_len"], x.area_lookup(t["catch_raw"], "BSAI"), sort=False),
        x.survey_length_strata(t["survey_len"], t["survey_strata"], sort=False),
        x.survey_length_prep(t["survey_len"], sort=False),
        x.lls_length_sum(t["lls_len"]),
    )


register(
    "length_union",
    _union,
    """
SELECT CASE WHEN l.species_code = 350 THEN 30020 ELSE 30152 END AS species_code, l.year, l.length, l.frequency,
       CASE WHEN a.fmp_subarea = 'BS' THEN 'EBS' ELSE a.fmp_subarea END AS fmp_subarea,
       coalesce(CASE WHEN a.fmp_subarea = 'BS' THEN 'EBS' ELSE a.fmp_subarea END, 'NA') || ' fishery' AS source
FROM fishery_len l LEFT JOIN (SELECT DISTINCT fmp_subarea, reporting_area_code AS nmfs_area FROM catch_raw) a
     ON l.nmfs_area = a.nmfs_area
UNION ALL
SELECT l.SPECIES_CODE, l.YEAR, l.LENGTH / 10, l.FREQUENCY,
       CASE WHEN s.area LIKE '%Aleutians%' THEN 'AI' ELSE 'SBS' END, 'AI BTS'
FROM survey_len l JOIN survey_strata s ON l.STRATUM = s.stratum WHERE s.area <> 'Chirikof'
UNION ALL
SELECT SPECIES_CODE, YEAR, LENGTH / 10, FREQUENCY, 'EBS', 'EBS slope BTS' FROM survey_len
UNION ALL
SELECT 30020, year, length, round(coalesce(sum(rpw), 0), 3),
       CASE WHEN council_sablefish_management_area = 'Aleutians' THEN 'AI' ELSE 'EBS' END,
       CASE WHEN council_sablefish_management_area = 'Aleutians' THEN 'AI' ELSE 'EBS' END || ' LLS'
FROM lls_len
WHERE geographic_area_name LIKE '%Bering%' OR geographic_area_name LIKE '%Aleutians%'
GROUP BY year, council_sablefish_management_area, length""",
    uses=("fishery_len", "catch_raw", "survey_len", "survey_strata", "lls_len"),
    digits={"frequency": 3},
)

register(
    "target_catch_filter",
    atka,
    """
SELECT year, catch_activity_date AS date, fmp_area AS fmp,
       CASE WHEN fmp_subarea = 'BS' THEN 'EBS' ELSE fmp_subarea END AS fmp_subarea,
       reporting_area_code AS nmfs_area, agency_gear_code AS gear, retained_or_discarded,
       trip_target_name AS target, agency_species_code AS species_code, species_group_name AS species_group,
       replace(species_name, 'greenling, ', '') AS species_name, weight_posted AS tons
FROM catch_raw WHERE trip_target_name = 'Atka Mackerel'""",
    uses=("catch_raw",),
)

register(
    "strata_series_complete",
    lambda t: x.strata_series_complete(
        t["catch_raw"].withColumn("sampling_strata_name", F.col("agency_gear_code"))
    ),
    """
SELECT p.sampling_strata_name, p.reporting_area_code, y.year, coalesce(c.catch, 0) AS catch
FROM (SELECT DISTINCT agency_gear_code AS sampling_strata_name, reporting_area_code FROM catch_raw) p
CROSS JOIN (SELECT DISTINCT year FROM catch_raw) y
LEFT JOIN (SELECT year, agency_gear_code, reporting_area_code, sum(weight_posted) AS catch
           FROM catch_raw GROUP BY 1, 2, 3) c
  ON c.year = y.year AND c.agency_gear_code = p.sampling_strata_name
 AND c.reporting_area_code = p.reporting_area_code""",
    uses=("catch_raw",),
)

register(
    "area_lookup",
    lambda t: x.area_lookup(t["catch_raw"], "BSAI"),
    """
SELECT DISTINCT fmp_area AS fmp, fmp_subarea, reporting_area_code AS nmfs_area
FROM catch_raw WHERE fmp_area = 'BSAI' AND reporting_area_code IS NOT NULL""",
    uses=("catch_raw",),
)

register(
    "catch_species_list",
    lambda t: x.catch_species_list(t["catch_raw"], "Other Rockfish"),
    """
SELECT DISTINCT agency_species_code, species_name, species_group_name
FROM catch_raw WHERE species_group_name = 'Other Rockfish'""",
    uses=("catch_raw",),
)

register(
    "haul_count_check",
    lambda t: x.haul_count_check(t["obs_spcomp"], t["obs_haul"], 350, 3),
    """
SELECT year, gear_type, count(CASE WHEN n >= 3 THEN 1 END) AS n_hauls
FROM (SELECT h.year, h.gear_type, s.haul_join, count(*) AS n
      FROM obs_spcomp s JOIN obs_haul h ON s.haul_join = h.haul_join
      WHERE s.species = 350 GROUP BY 1, 2, 3) c
GROUP BY year, gear_type""",
    uses=("obs_spcomp", "obs_haul"),
)
