"""The domain tables, derived from the generic star-schema tables.

Each binding is one SELECT over ``{table}`` placeholders. Spark and the SQL check
run the same text; the operators on top are written twice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from fathomline.session import settled

# Column types of the parquet files, so that a scan needs no schema job.
TABLES = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
    " l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,"
    " l_shipdate TIMESTAMP_NTZ",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
}

BINDINGS = {
    # customer joins the orders, not the lines, so the lines are shuffled once per key
    "catch_raw": """
SELECT CAST(year(l.l_shipdate) AS INT) AS year,
       CAST(l.l_shipdate AS DATE) AS catch_activity_date,
       'BSAI' AS fmp_area,
       CASE WHEN t.c_nationkey < 3 THEN 'AI' ELSE 'BS' END AS fmp_subarea,
       CASE WHEN t.c_nationkey < 3 THEN 541 + t.c_nationkey ELSE 500 + t.c_nationkey END AS reporting_area_code,
       CASE t.o_orderpriority
            WHEN '1-URGENT' THEN CASE WHEN l.l_linestatus = 'F' THEN 'TRW' ELSE 'NPT' END
            WHEN '2-HIGH' THEN 'PTR' WHEN '3-MEDIUM' THEN 'HAL'
            WHEN '4-NOT SPECIFIED' THEN 'POT' WHEN '5-LOW' THEN 'JIG' END AS agency_gear_code,
       CASE l.l_returnflag WHEN 'R' THEN 'R' ELSE 'D' END AS retained_or_discarded,
       CASE p.p_size % 14
            WHEN 0 THEN 'Atka Mackerel' WHEN 1 THEN 'Greenland Turbot - BSAI'
            WHEN 2 THEN 'Kamchatka Flounder - BSAI' WHEN 3 THEN 'Rock Sole - BSAI'
            WHEN 4 THEN 'Flathead Sole' WHEN 5 THEN 'Other Flatfish - BSAI'
            WHEN 6 THEN 'Yellowfin Sole - BSAI' WHEN 7 THEN 'Pacific Cod'
            WHEN 8 THEN 'Pollock - midwater' WHEN 9 THEN 'Pollock - bottom'
            WHEN 10 THEN 'Rockfish' WHEN 11 THEN 'Halibut' WHEN 12 THEN 'Sablefish'
            ELSE 'Arrowtooth Flounder' END AS trip_target_name,
       CAST(130 + p.p_partkey % 10 AS INT) AS agency_species_code,
       CASE WHEN p.p_partkey % 10 = 9 THEN 'Northern Rockfish' ELSE 'Other Rockfish' END AS species_group_name,
       CASE p.p_partkey % 10
            WHEN 0 THEN 'rockfish, dusky' WHEN 1 THEN 'rockfish, thornyhead (idiots)'
            WHEN 2 THEN 'rockfish, harlequin' WHEN 3 THEN 'rockfish, sharpchin'
            WHEN 4 THEN 'rockfish, yelloweye (red snapper)' WHEN 5 THEN 'rockfish, redbanded'
            WHEN 6 THEN 'rockfish, redstripe' WHEN 7 THEN 'rockfish, black'
            WHEN 8 THEN 'rockfish, silvergray' ELSE 'rockfish, rosethorn' END AS species_name,
       l.l_quantity AS weight_posted
FROM {lineitem} l
JOIN {part} p ON l.l_partkey = p.p_partkey
JOIN (SELECT o.o_orderkey, o.o_orderpriority, c.c_nationkey
      FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey) t ON l.l_orderkey = t.o_orderkey""",
    # missing values of every kind: a gear without a name, tons, a species, and a year and area of one status only
    "catch_gaps": """
SELECT year, catch_activity_date, fmp_area, fmp_subarea, reporting_area_code,
       CASE WHEN reporting_area_code = 513 THEN 'OTH' ELSE agency_gear_code END AS agency_gear_code,
       CASE WHEN year = 1998 AND fmp_subarea = 'AI' THEN 'R' ELSE retained_or_discarded END AS retained_or_discarded,
       trip_target_name, agency_species_code, species_group_name,
       CASE WHEN reporting_area_code = 515 AND agency_species_code = 137 THEN NULL ELSE species_name END AS species_name,
       CASE WHEN year = 1995 AND trip_target_name = 'Halibut' THEN NULL ELSE weight_posted END AS weight_posted
FROM {catch_raw}""",
    # one ton for each target, gear and species: the fisheries of one gear and one target are equal
    "catch_ties": """
SELECT DISTINCT 2000 AS year, CAST('2000-01-01' AS DATE) AS catch_activity_date, fmp_area, 'AI' AS fmp_subarea,
       541 AS reporting_area_code, agency_gear_code, 'R' AS retained_or_discarded, trip_target_name, agency_species_code,
       species_group_name, species_name, CAST(1 AS DOUBLE) AS weight_posted
FROM {catch_raw}
WHERE agency_gear_code NOT IN ('POT', 'JIG') AND species_name NOT LIKE '%thornyhead%'""",
    "obs_haul_gaps": """
SELECT haul_join, nmfs_area, gear_type, year FROM {obs_haul} WHERE year <> 1997""",
    "obs_haul": """
SELECT o_orderkey AS haul_join, CAST(500 + o_custkey % 44 AS INT) AS nmfs_area,
       o_orderpriority AS gear_type, CAST(year(o_orderdate) AS INT) AS year
FROM {orders}""",
    "obs_spcomp": """
SELECT l_orderkey AS haul_join,
       CASE l_partkey % 3 WHEN 0 THEN 350 WHEN 1 THEN 349 ELSE 352 END AS species,
       l_quantity AS extrapolated_weight
FROM {lineitem}""",
    "obs_points": """
SELECT l_orderkey AS haul_join, CAST(year(l_shipdate) AS INT) AS year,
       CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_partkey % 360 - 180 AS DOUBLE) END AS londd_start,
       CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE CAST(50 + l_suppkey % 15 AS DOUBLE) END AS latdd_start,
       CAST(500 + l_partkey % 130 AS INT) AS nmfs_area, l_quantity AS extrapolated_weight
FROM {lineitem}""",
    "survey_biomass": """
SELECT survey, year, CASE area WHEN 'Western AI' THEN 299 WHEN 'Central AI' THEN 3499
       WHEN 'Eastern AI' THEN 5699 WHEN 'SBS' THEN 799 END AS area_code,
       species_code, sum(o_totalprice) / 1000 AS biomass,
       sum(o_totalprice * o_totalprice) / 1000000 AS var, area,
       CASE species_code WHEN 30020 THEN 'shortspine thornyhead' WHEN 30152 THEN 'dusky rockfish'
            WHEN 30150 THEN 'dusky and dark rockfishes unid.' WHEN 30025 THEN 'broadfin thornyhead'
            ELSE 'redbanded rockfish' END AS common_name
FROM (SELECT CASE WHEN c.c_mktsegment <> 'MACHINERY' THEN 'AI'
                  WHEN o.o_orderpriority < '3' THEN 'EBS_SLOPE' ELSE 'EBS_SHELF' END AS survey,
             CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Western AI' WHEN 'BUILDING' THEN 'Central AI'
                  WHEN 'FURNITURE' THEN 'Eastern AI' WHEN 'HOUSEHOLD' THEN 'SBS'
                  ELSE CASE WHEN o.o_orderpriority < '3' THEN 'EBS Slope' ELSE 'EBS Shelf' END END AS area,
             CAST(year(o.o_orderdate) AS INT) AS year,
             CASE o.o_custkey % 5 WHEN 0 THEN 30020 WHEN 1 THEN 30152 WHEN 2 THEN 30150
                  WHEN 3 THEN 30025 ELSE 30470 END AS species_code,
             o.o_totalprice
      FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey) s
GROUP BY survey, area, year, species_code""",
    # some true zeros and gaps, for the zero rules
    "survey_zeros": """
SELECT survey, year, area_code, species_code,
       CASE WHEN year % 4 = 0 AND area = 'EBS Shelf' THEN 0.0 ELSE biomass END AS biomass,
       CASE WHEN year % 4 = 0 AND area = 'EBS Shelf' THEN 0.0 ELSE var END AS var, area, common_name
FROM {survey_biomass}
WHERE NOT (species_code = 30020 AND area = 'EBS Shelf')""",
    "survey_ai_raw": """
SELECT survey AS SURVEY, year AS YEAR, area_code AS AREA_CODE, species_code AS SPECIES_CODE,
       biomass AS BIOMASS, var AS VAR
FROM {survey_biomass} WHERE survey = 'AI'""",
    "survey_shelf_raw": """
SELECT survey AS SURVEY, year AS YEAR, species_code AS SPECIES_CODE, biomass AS BIOMASS, var AS VAR
FROM {survey_biomass} WHERE survey = 'EBS_SHELF'""",
    "survey_slope_raw": """
SELECT year AS YEAR, species_code AS SPECIES_CODE, biomass AS BIOMASS, var AS VAR
FROM {survey_biomass} WHERE survey = 'EBS_SLOPE'""",
    "survey_areas": """
SELECT DISTINCT survey, CASE area WHEN 'SBS' THEN 'Southern Bering Sea'
       WHEN 'Eastern AI' THEN 'Eastern Aleutians' WHEN 'Western AI' THEN 'Western Aleutians'
       ELSE 'Central Aleutians' END AS area, area_code
FROM {survey_biomass} WHERE survey = 'AI'""",
    "survey_species": """
SELECT DISTINCT species_code, common_name FROM {survey_biomass}""",
    "lls": """
SELECT CASE o_custkey % 5 WHEN 0 THEN 'NE Aleutians slope' WHEN 1 THEN 'SE Aleutians slope'
            WHEN 2 THEN 'NW Aleutians slope' WHEN 3 THEN 'Bering 2 slope' ELSE 'Bering 4 slope' END
            AS geographic_area_name,
       CASE WHEN o_orderstatus = 'P' THEN 'Japan' ELSE 'United States' END AS country,
       CAST(year(o_orderdate) AS INT) AS year,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS rpw,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice * 100 END AS rpw_var,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice / 10 END AS rpn
FROM {orders}""",
    "lls_len": """
SELECT CASE o_custkey % 4 WHEN 0 THEN 'NE Aleutians slope' WHEN 1 THEN 'Bering 2 slope'
            WHEN 2 THEN 'Bering 4 slope' ELSE 'Spencer Gully' END AS geographic_area_name,
       CASE WHEN o_custkey % 4 = 0 THEN 'Aleutians' ELSE 'Bering Sea' END AS council_sablefish_management_area,
       CAST(year(o_orderdate) AS INT) AS year, CAST(20 + o_orderkey % 50 AS DOUBLE) AS length,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS rpw
FROM {orders}""",
    "lengths": """
SELECT CASE WHEN l.l_suppkey % 2 = 0 THEN 30020 ELSE 30152 END AS species_code,
       CAST(year(l.l_shipdate) AS INT) AS year, CAST(p.p_size AS DOUBLE) AS length, l.l_quantity AS frequency,
       CASE WHEN p.p_partkey % 4 = 1 THEN 'EBS' WHEN p.p_partkey % 8 = 2 THEN 'SBS' ELSE 'AI' END AS fmp_subarea,
       CASE p.p_partkey % 4 WHEN 0 THEN 'AI fishery' WHEN 1 THEN 'EBS fishery'
            WHEN 2 THEN 'AI BTS' ELSE 'AI LLS' END AS source
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "fishery_len": """
SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(500 + l_suppkey % 30 AS INT) AS nmfs_area,
       CASE WHEN l_partkey % 2 = 0 THEN 350 ELSE 330 END AS species_code,
       l_quantity AS length, CAST(l_linenumber AS DOUBLE) AS frequency
FROM {lineitem}""",
    "survey_len": """
SELECT CAST(year(l_shipdate) AS INT) AS YEAR, CAST(l_suppkey % 25 AS INT) AS STRATUM,
       l_quantity * 10 AS LENGTH, CASE WHEN l_partkey % 2 = 0 THEN 30020 ELSE 30152 END AS SPECIES_CODE,
       CAST(l_linenumber AS DOUBLE) AS FREQUENCY
FROM {lineitem}""",
    "survey_strata": """
SELECT n_nationkey AS stratum,
       CASE WHEN n_nationkey < 8 THEN 'Western Aleutians' WHEN n_nationkey < 16 THEN 'Eastern Aleutians'
            WHEN n_nationkey < 22 THEN 'Southern Bering Sea' ELSE 'Chirikof' END AS area,
       n_nationkey % 4 * 100 AS min_depth, n_nationkey % 4 * 100 + 100 AS max_depth,
       concat('REGION ', CAST(n_regionkey AS VARCHAR(10))) AS regulatory_area_name
FROM {nation}""",
    "noncomm": """
SELECT CAST(year(o.o_orderdate) AS INT) AS collection_year,
       CASE c.c_nationkey % 3 WHEN 0 THEN 'ADFG' WHEN 1 THEN 'IPHC' ELSE 'NMFS' END AS collection_agency,
       o.o_totalprice AS weight
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "model_output": """
SELECT CASE WHEN species_code = 30020 THEN 'SST' ELSE 'non-SST' END AS species, year,
       CASE WHEN survey <> 'AI' THEN survey WHEN area = 'SBS' THEN 'SBS' ELSE 'AI' END AS region,
       sum(biomass) AS re_est, ln(sum(biomass)) AS biomsd,
       sqrt(ln(sum(var) / (sum(biomass) * sum(biomass)) + 1)) AS biomsd_sd
FROM {survey_biomass}
GROUP BY CASE WHEN species_code = 30020 THEN 'SST' ELSE 'non-SST' END, year,
         CASE WHEN survey <> 'AI' THEN survey WHEN area = 'SBS' THEN 'SBS' ELSE 'AI' END""",
    "model_biomass": """
SELECT species AS species_group, 'Model 20' AS model_name, region AS strata, year, re_est AS pred
FROM {model_output}
UNION ALL
SELECT species AS species_group, 'Model 22' AS model_name, region AS strata, year,
       re_est * (CAST(100 + year % 5 AS DOUBLE) / 100) AS pred
FROM {model_output}""",
    "species_lookup": """
SELECT CAST(p_partkey AS INT) AS species_code, p_type AS species_name, p_name AS common_name
FROM {part}""",
    "agency_codes": """
SELECT DISTINCT CAST(p_partkey % 997 AS INT) AS species_code, upper(p_name) AS common_name,
       CAST(p_partkey AS INT) AS species_code_race
FROM {part}""",
}


def depends_on(name: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", BINDINGS[name])))


class Bound:
    """The tables of one folder and the bindings over them, built on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}.parquet")

    def settle(self, name: str) -> None:
        """Derive a binding once where several others are read from it."""
        self._built[name] = settled(self[name])

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name in BINDINGS:
                needs = {need: self[need] for need in depends_on(name)}
                self._built[name] = self.spark.sql(BINDINGS[name], **needs)
            else:
                self._built[name] = self.table(name)
        return self._built[name]


def with_bindings(names, extra: dict[str, str] | None = None) -> str:
    """WITH clause that defines bindings, their inputs first, then further named queries."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in BINDINGS and name not in order:
            for need in depends_on(name):
                visit(need)
            order.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in order:
        text = BINDINGS[name].strip().format(**{need: need for need in depends_on(name)})
        parts.append(f"{name} AS (\n{text})")
    for name, text in (extra or {}).items():
        parts.append(f"{name} AS (\n{text.strip()})")
    own = any(re.search(rf"\bFROM {name}\b", text) for name, text in (extra or {}).items())
    return ("WITH RECURSIVE " if own else "WITH ") + ",\n".join(parts)
