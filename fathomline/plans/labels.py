"""Fixed values of the domain and the labels built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
MAIN_NAMES = [
    "dusky rockfish",
    "shortspine thornyhead",
    "redstripe rockfish",
    "redbanded rockfish",
    "yelloweye rockfish",
    "harlequin rockfish",
    "sharpchin rockfish",
]
OTHER_NAMES = [
    "black rockfish",
    "darkblotched rockfish",
    "rosethorn rockfish",
    "silvergray rockfish",
    "rockfish unid.",
    "dusky and dark rockfishes unid.",
    "yellowmouth rockfish",
    "broadfin thornyhead",
    "longspine thornyhead",
]
NAME_PATTERN = "thornyhead"
SST_CODE = 30020
DUSKY_CODE = 30152
SST_AGENCY_CODE = 350
DUSKY_AGENCY_CODE = 330
SST_NAME = "shortspine thornyhead"
SST, NON_SST = "SST", "non-SST"
COMPLEX = "All Other Rockfish"
COMPLEX_TOTAL = "Total Other Rockfish"
AI_AREAS = ["Eastern AI", "Central AI", "Western AI"]
COMMON_SPECIES = [
    "dusky",
    "SST",
    "other thornyheads",
    "harlequin",
    "sharpchin",
    "yelloweye",
    "redbanded",
    "redstripe",
    "black",
    "other",
]
MAJOR_SPECIES = ["dusky", "SST", "other thornyheads"]
GEARS = ["Bottom trawl", "Pelagic trawl", "Longline", "Pot", "Jig"]
KEY_AREAS = {
    543: "543 (WAI)",
    542: "542 (CAI)",
    541: "541 (EAI)",
    517: "517 (SBS)",
    519: "519 (SBS)",
    521: "521 (EBS Slope)",
}
NATURAL_MORTALITY = {SST: 0.03, NON_SST: 0.09}
ABC_SHARE = 0.75
Z_ROUNDED = 1.96
Z_EXACT = 1.959963984540054
# --------------------------------------------------------------------------


def either(condition: Column, yes, no) -> Column:
    """Two-way choice that stays missing when the condition is missing."""
    return F.when(condition, yes).when(~condition, no)


def sst_or_not(is_sst: Column) -> Column:
    return either(is_sst, F.lit(SST), F.lit(NON_SST))


def complex_of_code(code: str = "species_code") -> Column:
    return sst_or_not(F.col(code) == SST_CODE)


def complex_of_name(name: str = "species_name") -> Column:
    return sst_or_not(F.col(name) == SST)


def ordinal(column: Column, levels: Sequence) -> Column:
    """Display position of a category, 1 for the first level."""
    position = F.lit(None).cast("int")
    for place, level in reversed(list(enumerate(levels, 1))):
        position = F.when(column == F.lit(level), F.lit(place)).otherwise(position)
    return position


def keep_or_other(column: Column, keep: Sequence[str]) -> Column:
    """Names in ``keep`` stay, the rest (missing ones too) become 'other'."""
    return F.when(column.isin(list(keep)), column).otherwise(F.lit("other"))


def mortality(group: Column) -> Column:
    """Natural mortality by species group; other groups have none."""
    rate = F.lit(None).cast("double")
    for name, value in NATURAL_MORTALITY.items():
        rate = F.when(group == name, F.lit(value)).otherwise(rate)
    return rate


def ai_or_ebs(region: Column) -> Column:
    return either(region == "AI", F.lit("AI"), F.lit("EBS"))
