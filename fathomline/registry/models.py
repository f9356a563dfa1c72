"""Queries for the state-space model, its inputs and its outputs."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.operators import complete
from fathomline.plans import recursion
from fathomline.plans import statespace as m
from fathomline.plans.survey import biomass_strata
from fathomline.registry import register
from fathomline.registry.model_sql import FIT_SQL, STATES_SQL, solve_sql
from fathomline.registry.survey import LLS_SQL, STRATA_SQL, _index  # noqa: F401
from fathomline.session import settled
from fathomline.sources import model_reports as reports

END_YEAR = 2003


def _strata(t):
    return settled(biomass_strata(t["survey_zeros"]).select("species", "region", "year", "biomass", "cv"))


def _grid(t):
    return m.model_input_grid(_strata(t), END_YEAR)


_GRID_SQL = {
    **STRATA_SQL,
    "kept": "SELECT species, region FROM strata GROUP BY 1, 2 HAVING sum(biomass) > 0",
    "inputs": f"""
SELECT k.species, k.region, CAST(y.year AS INTEGER) AS year, coalesce(s.biomass, 0) AS biomass,
       coalesce(s.cv, 0) AS cv
FROM kept k CROSS JOIN (SELECT unnest(range(min(year), {END_YEAR + 1})) AS year FROM strata) y
LEFT JOIN strata s ON s.species = k.species AND s.region = k.region AND s.year = y.year""",
}

register(
    "model_input_grid",
    _grid,
    "SELECT species, region, year, round(biomass, 6) AS biomass, round(cv, 6) AS cv FROM inputs",
    uses=("survey_zeros",),
    extra=_GRID_SQL,
)

_REGIONS = ["AI", "EBS_SHELF", "EBS_SLOPE", "SBS"]
register(
    "model_input_wide",
    lambda t: m.model_input_wide(_grid(t), _REGIONS),
    "SELECT species, value, year,\n"
    + ",\n".join(
        f"       coalesce(max(CASE WHEN region = '{r}' THEN round(x, 6) END), 0) AS \"{r}\"" for r in _REGIONS
    )
    + """
FROM (SELECT species, region, year, 'mu' AS value, biomass AS x FROM inputs
      UNION ALL SELECT species, region, year, 'cv', cv FROM inputs) u
GROUP BY species, value, year""",
    uses=("survey_zeros",),
    extra=_GRID_SQL,
)


def _index_points(t):
    """The line index on the slope, scaled down so that q is of the size of one."""
    return _index(t).filter(F.col("strata") == "EBS Slope").withColumn("cpue", F.col("cpue") / 1000)


def _fit(t):
    """Both models fitted in one job: with and without the line index."""
    grid = _grid(t)
    models = {"Model 20": grid, "Model 22": m.with_index(grid, _index_points(t), "SST", "EBS_SLOPE")}
    return settled(m.rw_fit(m.stack_models(models)))


_FIT = {**_GRID_SQL, **LLS_SQL, **FIT_SQL}
_ALL = {**_FIT, **STATES_SQL}
_FIT_USES = ("survey_zeros", "lls")


def _states(t):
    return m.state_rows(_fit(t)).select("model_name", "species", "region", "year", "re_est", "biomsd", "biomsd_sd")


for _key, _model in (("rw_fit", "Model 20"), ("rw_fit_multi", "Model 22")):
    register(
        _key,
        lambda t, model=_model: _states(t).filter(F.col("model_name") == model),
        f"""
SELECT model_name, species, region, year, round(re_est, 0) AS re_est, round(biomsd, 6) AS biomsd, round(biomsd_sd, 5) AS biomsd_sd
FROM states WHERE model_name = '{_model}'""",
        uses=_FIT_USES,
        extra=_ALL,
        digits={"re_est": 0, "biomsd_sd": 5},
    )

register(
    "rw_area_output",
    lambda t: m.rw_area_output(_fit(t)),
    """
SELECT model_name, species, year, region, round(re_est, 0) AS re_est, round(exp(biomsd - 1.96 * biomsd_sd), -1) AS re_lci,
       round(exp(biomsd + 1.96 * biomsd_sd), -1) AS re_uci
FROM states
UNION ALL
SELECT model_name, species, year, 'TOTAL', round(est, 0), round(exp(ln(est) - 1.96 * sd), -1), round(exp(ln(est) + 1.96 * sd), -1)
FROM (SELECT model_name, species, year, sum(re_est) AS est,
             sqrt(ln(sum(exp(2 * biomsd + biomsd_sd * biomsd_sd) * (exp(biomsd_sd * biomsd_sd) - 1))
                     / (sum(exp(biomsd + 0.5 * biomsd_sd * biomsd_sd)) * sum(exp(biomsd + 0.5 * biomsd_sd * biomsd_sd))) + 1)) AS sd
      FROM states GROUP BY 1, 2, 3) x""",
    uses=_FIT_USES,
    extra=_ALL,
    digits={"re_est": 0, "re_lci": -1, "re_uci": -1},
)
register(
    "model_input_check",
    lambda t: m.input_check(_strata(t)),
    """
SELECT species, region, count(*) AS n_observed,
       count(CASE WHEN cv IS NULL OR isnan(cv) OR cv <= 0 THEN 1 END) AS n_without_cv
FROM strata WHERE biomass > 0 GROUP BY species, region""",
    uses=("survey_zeros",),
    extra=STRATA_SQL,
)
register(
    "fit_diagnostics",
    lambda t: m.fit_diagnostics(_fit(t)).select("model_name", "species", "n_used", "n_unused", "log_det_hess", "converged"),
    """
SELECT f.model_name, f.species, CAST(o.n AS INTEGER) AS n_used, CAST(0 AS INTEGER) AS n_unused, round(ln(det), 4) AS log_det_hess,
       greatest(abs(gs), coalesce(abs(gq), 0)) < 0.001 AND ln(det) > 0 AS converged
FROM fitted f JOIN (SELECT model_name, species, count(CASE WHEN w > 0 THEN 1 END) + count(CASE WHEN v > 0 THEN 1 END) AS n
                    FROM obs GROUP BY 1, 2) o USING (model_name, species)""",
    uses=_FIT_USES,
    extra=_FIT,
    digits={"log_det_hess": 4},
)
_PAR = "SELECT species AS species_group, model_name"
register(
    "param_table",
    lambda t: m.param_table(_fit(t)),
    f"""
SELECT species_group, model_name, parameter, round(exp(est), 4) AS estimate, round(exp(est) * se, 4) AS std_err,
       round(exp(est - 1.959963984540054 * se), 4) AS lci, round(exp(est + 1.959963984540054 * se), 4) AS uci
FROM ({_PAR}, 'process_error' AS parameter, s AS est, sqrt(css) AS se FROM fitted
      UNION ALL {_PAR}, 'scaling_parameter_q', q, sqrt(cqq) FROM fitted WHERE k = 2) p""",
    uses=_FIT_USES,
    extra=_FIT,
    digits={n: 4 for n in ("estimate", "std_err", "lci", "uci")},
)
register(
    "model_aic",
    lambda t: m.model_aic(_fit(t)),
    """
SELECT species, model_name, round(nll, 6) AS nll, CAST(k AS INTEGER) AS n_par, round(2 * nll + 2 * k, 6) AS aic,
       round(2 * nll + 2 * k - min(2 * nll + 2 * k) OVER (PARTITION BY species), 6) AS delta_aic,
       CAST(rank() OVER (PARTITION BY species ORDER BY 2 * nll + 2 * k) AS INTEGER) AS rank
FROM fitted""",
    uses=_FIT_USES,
    extra=_FIT,
)

# parameters to look at, whatever would be estimated
_LOOK = [(model, species, i, s, 0.3 * i - 1 if (model, species) == ("Model 22", "SST") else 0.0)
         for model in ("Model 20", "Model 22") for species in ("SST", "non-SST") for i, s in enumerate((-2.1095, -0.35468, 0.5))]
_LOOK_SQL = {
    **_GRID_SQL,
    **LLS_SQL,
    "obs": FIT_SQL["obs"],
    "look": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c}, {d}::DOUBLE, {e}::DOUBLE)" for a, b, c, d, e in _LOOK)
    + ") x(model_name, species, point, s, q)",
    **solve_sql("look", "look"),
}


def _look(t):
    """The input of both models by region, and the parameters to look at."""
    grid = _grid(t)
    models = {"Model 20": grid, "Model 22": m.with_index(grid, _index_points(t), "SST", "EBS_SLOPE")}
    points = t.spark.createDataFrame(_LOOK, "model_name STRING, species STRING, point INT, log_sigma DOUBLE, log_q DOUBLE")
    return recursion.region_series(m.stack_models(models)), points


register(
    "rw_states_at",
    lambda t: recursion.states_at(*_look(t)),
    """
SELECT model_name, species, point, region, CAST(t - 1 + (SELECT min(year) FROM inputs) AS INTEGER) AS year, round(x, 6) AS biomsd,
       round(var, 6) AS variance
FROM look_states""",
    uses=_FIT_USES,
    extra=_LOOK_SQL,
)
register(
    "rw_likelihood_at",
    lambda t: recursion.likelihood_at(*_look(t)),
    "SELECT model_name, species, CAST(point AS INTEGER) AS point, round(nll, 6) AS nll FROM look_nll",
    uses=_FIT_USES,
    extra=_LOOK_SQL,
)


def _extra_errors(t):
    """The models with and without the index and with extra observation errors, by AIC within the species."""
    grid = _grid(t)
    both = m.with_index(grid, _index_points(t), "SST", "EBS_SLOPE")
    models = {
        "Model 20": grid,
        "Model 22": both,
        "Model 22.2.a": m.with_extra_error(both, biomass=True),
        "Model 22.2.b": m.with_extra_error(both, cpue=True),
        "Model 22.2.c": m.with_extra_error(both, biomass=True, cpue=True),
    }
    fit = settled(m.rw_fit(m.stack_models(models)))
    return m.model_aic(fit).join(m.fit_diagnostics(fit).select("species", "model_name", "stop", "converged"), ["species", "model_name"])


register("observation_error_models", _extra_errors, digits={n: 3 for n in ("nll", "aic", "delta_aic")})

register(
    "param_ci",
    lambda t: m.param_ci(
        t["model_output"].select(
            "species", "region", "year", (F.col("biomsd") / 10).alias("est"), F.col("biomsd_sd").alias("se")
        )
    ),
    """
SELECT species, region, year, round(exp(est), 6) AS estimate, round(exp(est) * se, 6) AS std_err,
       round(exp(est - 1.959963984540054 * se), 6) AS lci, round(exp(est + 1.959963984540054 * se), 6) AS uci
FROM (SELECT species, region, year, biomsd / 10 AS est, biomsd_sd AS se FROM model_output) p""",
    uses=("model_output",),
)


def _reports(t):
    full = complete(
        t["model_output"].select(F.col("species").alias("run"), "year", "region", "re_est", "biomsd"),
        ["run", "year", "region"],
    )
    return reports.report_rows(reports.report_text(full))


register(
    "model_report_ingest",
    lambda t: reports.area_estimates(
        settled(_reports(t)), {r: ["AI", "EBS_SHELF", "EBS_SLOPE", "SBS"] for r in ("SST", "non-SST")}
    ).select("run", "year", "region", "re_est", "biomsd"),
    """
SELECT a.run, b.year, c.region, round(s.re_est, 6) AS re_est, round(s.biomsd, 6) AS biomsd
FROM (SELECT DISTINCT species AS run FROM model_output) a CROSS JOIN (SELECT DISTINCT year FROM model_output) b
CROSS JOIN (SELECT DISTINCT region FROM model_output) c
LEFT JOIN model_output s ON s.species = a.run AND s.year = b.year AND s.region = c.region""",
    uses=("model_output",),
)


def _estimates(t):
    """States of the model as the parameters of a run, with made correlations that fall with their distance."""
    order = W.partitionBy("species").orderBy("year", "region")
    placed = t["model_output"].select(F.col("species").alias("run"), F.row_number().over(order).alias("index"), "region", "biomsd", "biomsd_sd")
    triangle = F.transform(F.sequence(F.lit(1), F.col("index")), lambda j: 1.0 / (1 + F.col("index") - j) - F.when(F.col("index") == j, 0.0).otherwise(0.25))
    return placed.select("run", "index", F.col("region").alias("name"), F.col("biomsd").alias("value"), F.col("biomsd_sd").alias("std"), triangle.alias("correlations"))


register(
    "model_covariances",
    lambda t: reports.correlation_matrix(reports.estimates_with_correlations(reports.correlation_text(settled(_estimates(t)), 2.88361))),
    """
SELECT a.run, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, a.region AS name_i, b.region AS name_j,
       round(CASE WHEN a.i = b.i THEN 1 ELSE 1.0::DOUBLE / (1 + abs(a.i - b.i)) - 0.25 END, 6) AS cor,
       round(CASE WHEN a.i = b.i THEN 1 ELSE 1.0::DOUBLE / (1 + abs(a.i - b.i)) - 0.25 END * a.biomsd_sd * b.biomsd_sd, 6) AS cov
FROM placed a JOIN placed b ON a.run = b.run""",
    uses=("model_output",),
    extra={
        "placed": "SELECT species AS run, row_number() OVER (PARTITION BY species ORDER BY year, region) AS i, region, biomsd_sd FROM model_output"
    },
)

register(
    "model_input_text",
    lambda t: reports.input_text(_rounded_grid(t)).select("run", F.posexplode(F.split("text", "\n")).alias("line_no", "line")),
    """
SELECT run, CAST(line_no AS INTEGER) AS line_no, line FROM (
  SELECT h.run, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13]) AS line_no, unnest(['# Model start and end years ', ' ' || first || ' ' || last || ' ',
    ' # Number of survey indices fit (i.e., regions/depth strata) ', ' ' || regions || ' ', ' # Number or process error parameters ', ' 1 ',
    ' # Process error index ', ' ' || ones || ' ', ' # Number of surveys ', ' ' || n || ' ', ' # Survey years ', ' ' || years || ' ',
    ' # ' || names || ' ', ' # Survey biomass ']) AS line FROM heads h
  UNION ALL SELECT run, 14 + year - first, mu FROM rows JOIN heads USING (run)
  UNION ALL SELECT run, 14 + n, '# Survey biomass SE' FROM heads
  UNION ALL SELECT run, 15 + n + year - first, cv FROM rows JOIN heads USING (run)) x""",
    uses=("survey_zeros",),
    extra={
        **_GRID_SQL,
        "cells": """
SELECT species AS run, region, year,
       CASE WHEN round(biomass * 8) = 0 THEN '-9' ELSE regexp_replace(CAST(round(biomass * 8) / 8 AS VARCHAR), '\\.0$', '') END AS mu,
       CASE WHEN round(cv * 256) = 0 THEN '-9' ELSE regexp_replace(CAST(round(cv * 256) / 256 AS VARCHAR), '\\.0$', '') END AS cv
FROM inputs""",
        "rows": "SELECT run, year, string_agg(mu, ' ' ORDER BY region) AS mu, string_agg(cv, ' ' ORDER BY region) AS cv FROM cells GROUP BY run, year",
        "heads": """
SELECT y.run, y.first, y.last, y.n, y.years, r.regions, r.ones, r.names
FROM (SELECT run, min(year) AS first, max(year) AS last, count(*) AS n, string_agg(CAST(year AS VARCHAR), ' ' ORDER BY year) AS years FROM rows GROUP BY run) y
JOIN (SELECT run, count(*) AS regions, string_agg('1', ' ') AS ones, string_agg(region, ' ' ORDER BY region) AS names
      FROM (SELECT DISTINCT run, region FROM cells) d GROUP BY run) r ON r.run = y.run""",
    },
)


def _rounded_grid(t):
    """The model input in eighths and 256ths, which have the same short text everywhere."""
    return _grid(t).withColumns({"biomass": F.round(F.col("biomass") * 8) / 8, "cv": F.round(F.col("cv") * 256) / 256})


register(
    "model_input_text_rows",
    lambda t: reports.input_rows(reports.input_text(_rounded_grid(t), {"SBS": 2})),
    """
SELECT species AS run, region, year, CAST(CASE WHEN region = 'SBS' THEN 2 ELSE 1 END AS INTEGER) AS process,
       nullif(round(biomass * 8) / 8, 0) AS biomass, round(nullif(round(cv * 256) / 256, 0), 6) AS cv FROM inputs""",
    uses=("survey_zeros",),
    extra=_GRID_SQL,
)

register(
    "observation_sd",
    lambda t: _strata(t).select("species", "region", "year", m.observation_sd(F.col("cv")).alias("sd")),
    "SELECT species, region, year, round(sqrt(ln(cv * cv + 1)), 6) AS sd FROM strata",
    uses=("survey_zeros",),
    extra=STRATA_SQL,
)
