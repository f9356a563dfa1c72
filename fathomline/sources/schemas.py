"""Schemas of the table families."""

from __future__ import annotations

SPECIES = "species_code INT, species_name STRING, common_name STRING"
AGENCY_CODES = "species_code INT, common_name STRING, scientific_name STRING, species_code_race INT"
AREAS = "fmp STRING, fmp_subarea STRING, nmfs_area INT"
SURVEY_AREAS = "survey STRING, area STRING, area_code INT"
SURVEY_AI_RAW = "SURVEY STRING, YEAR INT, AREA_CODE INT, SPECIES_CODE INT, BIOMASS DOUBLE, VAR DOUBLE"
SURVEY_SHELF_RAW = "SURVEY STRING, YEAR INT, SPECIES_CODE INT, BIOMASS DOUBLE, VAR DOUBLE"
SURVEY_SLOPE_RAW = "YEAR INT, SPECIES_CODE INT, BIOMASS DOUBLE, VAR DOUBLE"
SURVEY_BIOMASS = (
    "survey STRING, year INT, area_code INT, species_code INT, biomass DOUBLE, var DOUBLE,"
    " area STRING, common_name STRING"
)
CATCH = (
    "year INT, date DATE, fmp STRING, fmp_subarea STRING, nmfs_area INT, gear STRING,"
    " retained_or_discarded STRING, target STRING, species_code INT, species_group STRING,"
    " species_name STRING, tons DOUBLE"
)
# haul keys are wider than BIGINT
OBSERVED = (
    "year INT, species INT, species_name STRING, sample_number INT, sample_size DOUBLE,"
    " sample_weight DOUBLE, extrapolated_weight DOUBLE, extrapolated_number DOUBLE,"
    " percent_retained DOUBLE, gear_type STRING, latdd_start DOUBLE, londd_start DOUBLE,"
    " nmfs_area INT, haul_join DECIMAL(20,0)"
)
CLASS_PROPORTION = "year INT, fmp_subarea STRING, prop_sst DOUBLE"
LINE_INDEX = "strata STRING, year INT, cpue DOUBLE, cv DOUBLE"
LENGTHS = "species_code INT, year INT, length DOUBLE, frequency DOUBLE, fmp_subarea STRING, source STRING"
SURVEY_LENGTHS_RAW = (
    "SURVEY STRING, YEAR INT, STRATUM INT, LENGTH DOUBLE, SPECIES_CODE INT, FREQUENCY DOUBLE"
)
# in the order of the dashboard's columns; names are untidy in the file
NONCOMMERCIAL = (
    "`Collection Year` INT, `Collection Agency` STRING, `Collection Name` STRING, `OBS Gear Code` INT,"
    " `FMP Area` STRING, `Reporting Area` INT, `ADFG Region` STRING, `ADFG Statistical Area` INT,"
    " `Agency Species Code Type` STRING, `Species Code` INT, `Species Group Code` STRING,"
    " `Species Group Name` STRING, `Number Animals` DOUBLE, Weight DOUBLE, `Record Count` INT,"
    " Contact STRING, `Date Received from AKR` TIMESTAMP"
)
MODEL_INPUT = "species STRING, region STRING, year INT, biomass DOUBLE, cv DOUBLE"
MODEL_OUTPUT = (
    "species STRING, year INT, region STRING, re_est DOUBLE, re_lci DOUBLE, re_uci DOUBLE,"
    " biomsd DOUBLE, biomsd_sd DOUBLE"
)
PARAMETERS = (
    "species_group STRING, model_name STRING, parameter STRING, estimate DOUBLE, std_err DOUBLE,"
    " lci DOUBLE, uci DOUBLE"
)
