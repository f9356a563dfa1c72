"""The random-walk model at given parameters, as DataFrame functions.

A region's years are an array; elimination and back substitution are folds over it. No fit is
made here: states, variances and the likelihood follow from parameters that a table gives, for
instance published ones, or a grid to look at a likelihood.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.plans.statespace import LOG_2PI, MISSING_CV

STOCK = ["model_name", "species"]
POINT = "point INT, log_sigma DOUBLE, log_q DOUBLE, log_tau DOUBLE, log_tau_index DOUBLE"


def _square(value: str, cv: str) -> str:
    """Squared cv of an observation, the one for a missing cv where it has none; NULL where nothing was seen."""
    sound = f"{cv} > 0 AND NOT isnan({cv})"
    return f"CASE WHEN {value} > 0 THEN CASE WHEN {sound} THEN {cv} * {cv} ELSE {MISSING_CV * MISSING_CV}D END END"


def region_series(observations: DataFrame) -> DataFrame:
    """(model_name, species, region, cells): the years of each region in order, gaps between them filled.

    ``observations`` as for ``rw_fit``: one row per year and region. Years run from the first to the last
    one of the model and species.
    """
    data = observations
    for name in ("cpue", "cpue_cv"):
        if name not in data.columns:
            data = data.withColumn(name, F.lit(None).cast("double"))
    spans = data.groupBy(*STOCK).agg(F.min("year").alias("first"), F.max("year").alias("last"))
    seen = data.select(
        *STOCK,
        "region",
        "year",
        F.expr(_square("biomass", "cv")).alias("square"),
        F.expr("CASE WHEN biomass > 0 THEN ln(biomass) END").alias("y"),
        F.expr(_square("cpue", "cpue_cv")).alias("index_square"),
        F.expr("CASE WHEN cpue > 0 THEN ln(cpue) END").alias("index_y"),
    )
    cell = F.struct("square", "y", "index_square", "index_y")
    # a region has one cell per year
    held = seen.groupBy(*STOCK, "region").agg(F.map_from_entries(F.collect_list(F.struct("year", cell.alias("cell")))).alias("held"))
    years = F.transform(
        F.sequence("first", "last"),
        lambda year: F.struct(year.alias("year"), F.try_element_at("held", year).alias("cell")),
    )
    return held.join(spans, STOCK).select(*STOCK, "region", years.alias("cells"))


def _weight(square: str, tau: str) -> str:
    """Reciprocal log-scale variance, 0 where nothing was seen."""
    extra = f"CASE WHEN {tau} IS NULL THEN 0D ELSE exp(2 * {tau}) END"
    return f"CASE WHEN x.cell.{square} IS NULL THEN 0D ELSE 1 / ln(x.cell.{square} + {extra} + 1) END"


def solved(series: DataFrame, points: DataFrame) -> DataFrame:
    """Each region at each parameter point of its model and species: system, elimination and solution.

    ``points`` has model_name, species, point, log_sigma and may have log_q, log_tau and
    log_tau_index; a missing one takes no part.
    """
    for name in ("log_q", "log_tau", "log_tau_index"):
        if name not in points.columns:
            points = points.withColumn(name, F.lit(None).cast("double"))
    both = series.join(points, STOCK).withColumn("link", F.expr("exp(-2 * log_sigma)"))
    terms = f"""transform(cells, (x, i) -> named_struct(
      'year', x.year, 'w', {_weight("square", "log_tau")}, 'y', coalesce(x.cell.y, 0D),
      'v', {_weight("index_square", "log_tau_index")}, 'z', coalesce(x.cell.index_y, 0D) - coalesce(log_q, 0D),
      'ends', CAST(i > 0 AS INT) + CAST(i < size(cells) - 1 AS INT)))"""
    system = "transform(terms, x -> named_struct('d', x.w + x.v + link * x.ends, 'b', x.w * x.y + x.v * x.z))"
    forward = """aggregate(system, CAST(array() AS ARRAY<STRUCT<p: DOUBLE, f: DOUBLE>>), (done, x) -> concat(done, array(
      CASE WHEN size(done) = 0 THEN named_struct('p', x.d, 'f', x.b) ELSE named_struct(
        'p', x.d - link * link / element_at(done, -1).p,
        'f', x.b + link / element_at(done, -1).p * element_at(done, -1).f) END)))"""
    back = """reverse(aggregate(reverse(forward), CAST(array() AS ARRAY<STRUCT<state: DOUBLE, variance: DOUBLE>>),
      (done, x) -> concat(done, array(
        CASE WHEN size(done) = 0 THEN named_struct('state', x.f / x.p, 'variance', 1 / x.p) ELSE named_struct(
          'state', x.f / x.p + link / x.p * element_at(done, -1).state,
          'variance', 1 / x.p + link / x.p * link / x.p * element_at(done, -1).variance) END))))"""
    out = both
    for name, text in (("terms", terms), ("system", system), ("forward", forward), ("back", back)):
        out = out.withColumn(name, F.expr(text))
    return out


def states_at(series: DataFrame, points: DataFrame) -> DataFrame:
    """(model_name, species, point, region, year, biomsd, variance): log-scale states given the parameters.

    The variance is that of the state at these parameters, without the uncertainty of an estimate.
    """
    rows = solved(series, points).select(*STOCK, "point", "region", F.inline(F.arrays_zip("cells.year", "back")))
    return rows.select(*STOCK, "point", "region", "year", F.col("back.state").alias("biomsd"), F.col("back.variance").alias("variance"))


def likelihood_at(series: DataFrame, points: DataFrame) -> DataFrame:
    """(model_name, species, point, nll): negative log likelihood of all regions at each point."""
    own = f"""0.5 * (size(cells) - 1) * ({LOG_2PI!r}D + 2 * log_sigma) - 0.5 * size(cells) * {LOG_2PI!r}D + 0.5 * (
      aggregate(arrays_zip(terms, back), 0D, (s, r) -> s + r.terms.w * pow(r.terms.y - r.back.state, 2)
        + r.terms.v * pow(r.terms.z - r.back.state, 2)
        + CASE WHEN r.terms.w > 0 THEN {LOG_2PI!r}D - ln(r.terms.w) ELSE 0D END
        + CASE WHEN r.terms.v > 0 THEN {LOG_2PI!r}D - ln(r.terms.v) ELSE 0D END)
      + aggregate(forward, 0D, (s, x) -> s + ln(x.p))
      + link * aggregate(transform(back, (x, i) -> CASE WHEN i = 0 THEN 0D ELSE pow(x.state - back[i - 1].state, 2) END), 0D, (s, x) -> s + x))"""
    parts = solved(series, points).select(*STOCK, "point", F.expr(own).alias("part"))
    return parts.groupBy(*STOCK, "point").agg(F.sum("part").alias("nll"))
