"""Random-walk biomass model per stock, fitted as one grouped Spark job.

log biomass of region j follows x[t] = x[t-1] + N(0, s^2) with one s for all regions
of a stock; observations are normal around it on the log scale, and an optional
index adds observations shifted by ln q. The model is linear and Gaussian given s,
so the likelihood, the states and their variances are exact: each region is a
tridiagonal system solved in time proportional to its years.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.functions import na_skipping_sum
from fathomline.operators import pivot_wider
from fathomline.plans.labels import Z_EXACT, Z_ROUNDED
from fathomline.session import ship_package

LOG_SIGMA_BOUNDS = (-5.0, 2.0)
# an extra observation cv lies between nearly nothing and 1.5
LOG_TAU_BOUNDS = (-7.0, math.log(1.5))
TAU_STARTS = (-2.5, -1.0)
LOG_2PI = math.log(2 * math.pi)
# fixed value: the cv that an observation without one counts with (log-scale variance ln 82)
MISSING_CV = 9.0
NEWTON_STEPS = 50
NEWTON_GRADIENT = 1e-7
STATE = (
    "region STRING, year INT, re_est DOUBLE, re_lci DOUBLE, re_uci DOUBLE, biomsd DOUBLE, biomsd_sd DOUBLE"
)
FIT = (
    "species STRING, model_name STRING, nll DOUBLE, mgc DOUBLE, log_det_hess DOUBLE, n_par INT, n_used INT, n_unused INT,"
    " steps INT, stop STRING,"
    " parameters ARRAY<STRUCT<parameter STRING, est DOUBLE, se DOUBLE>>,"
    f" states ARRAY<STRUCT<{STATE}>>"
)


# --- input -----------------------------------------------------------------
def model_input_grid(
    data: DataFrame, end_year: int | None = None, per_species_start: bool = False
) -> DataFrame:
    """Every year of each species and region; 0 stands for not observed.

    Regions whose biomass adds up to 0 are left out. Only observed pairs can have
    biomass, so the years are spread over the observed pairs and no product of
    species and regions is formed.
    """
    pairs = (
        data.groupBy("species", "region")
        .agg(na_skipping_sum("biomass").alias("total"))
        .filter(F.col("total") > 0)
        .select("species", "region")
    )
    ends = [F.min("year").alias("first"), F.max("year").alias("last")]
    last = F.col("last") if end_year is None else F.lit(end_year)
    if per_species_start:
        spans = pairs.join(data.groupBy("species").agg(*ends), "species")
    else:
        span = data.agg(F.struct(*ends)).scalar()
        spans = pairs.select("*", span.alias("s")).select("species", "region", "s.first", "s.last")
    years = spans.select("species", "region", F.explode(F.sequence("first", last)).alias("year"))
    return years.join(data, ["species", "region", "year"], "left").select(
        "species",
        "region",
        "year",
        F.coalesce("biomass", F.lit(0.0)).alias("biomass"),
        F.coalesce("cv", F.lit(0.0)).alias("cv"),
    )


def model_input_wide(grid: DataFrame, regions) -> DataFrame:
    """The grid with a column per region and a row each for estimate and cv."""
    parts = [("mu", "biomass"), ("cv", "cv")]
    long = grid.select(
        "species",
        "year",
        "region",
        F.inline(F.array(*[F.struct(F.lit(v).alias("value"), F.col(c).alias("x")) for v, c in parts])),
    )
    return pivot_wider(long, ["species", "value", "year"], "region", "x", regions, fill=0.0)


def with_index(grid: DataFrame, index: DataFrame, species: str, region: str) -> DataFrame:
    """Add a second index (cpue, cv by year) to one region of one species."""
    points = index.select(
        F.lit(species).alias("species"),
        F.lit(region).alias("region"),
        "year",
        "cpue",
        F.col("cv").alias("cpue_cv"),
    )
    return grid.join(points, ["species", "region", "year"], "left")


def observation_sd(cv: Column) -> Column:
    """Log-scale standard deviation of a log-normal observation with this cv."""
    return F.sqrt(F.log(cv * cv + 1))


def with_extra_error(grid: DataFrame, biomass: bool = False, cpue: bool = False) -> DataFrame:
    """Ask for an extra observation cv, one for all biomass or for the index, to be estimated with the model."""
    return grid.withColumns({"extra_biomass": F.lit(biomass), "extra_cpue": F.lit(cpue)})


def with_process_errors(grid: DataFrame, groups: Mapping[str, int]) -> DataFrame:
    """Give regions process errors of their own: regions of one number share one, others have number 1."""
    number = F.lit(1)
    for region, group in groups.items():
        number = F.when(F.col("region") == region, group).otherwise(number)
    return grid.withColumn("process", number)


# --- numerics of one stock -------------------------------------------------
class _Stock:
    """Observations of one stock as years by regions, with its likelihood.

    A variance on the log scale is ln(cv^2 + tau^2 + 1); the extra cv tau is 0 unless it is a parameter.
    """

    def __init__(self, pdf: pd.DataFrame, is_se: bool, missing_cv: float | None = MISSING_CV):
        self.missing_cv = missing_cv
        self.used = self.unused = 0
        self.regions = sorted(pdf["region"].unique())
        self.years = np.arange(int(pdf["year"].min()), int(pdf["year"].max()) + 1)
        row = (pdf["year"] - self.years[0]).to_numpy(int)
        column = pdf["region"].map({r: i for i, r in enumerate(self.regions)}).to_numpy(int)
        shape = (len(self.years), len(self.regions))
        self.square, self.y = self._observations(pdf, "biomass", "cv", row, column, shape, is_se)
        self.index_square, self.index_y = np.full(shape, np.nan), np.zeros(shape)
        if "cpue" in pdf and pdf["cpue"].notna().any():
            self.index_square, self.index_y = self._observations(pdf, "cpue", "cpue_cv", row, column, shape, False)
        self.has_index = bool(np.isfinite(self.index_square).any())
        self.weight, constant = self._weights(self.square)
        self.index_weight, more = self._weights(self.index_square)
        self.constant = constant + more
        self.process = np.zeros(len(self.regions), int)
        if "process" in pdf and pdf["process"].notna().any():
            numbers = pdf.groupby("region")["process"].max().reindex(self.regions).fillna(1)
            self.process = np.unique(numbers.to_numpy(int), return_inverse=True)[1]
        self.extra_biomass = "extra_biomass" in pdf and bool((pdf["extra_biomass"] == True).any())  # noqa: E712
        self.extra_cpue = self.has_index and "extra_cpue" in pdf and bool((pdf["extra_cpue"] == True).any())  # noqa: E712

    def _observations(self, pdf, value, error, row, column, shape, is_se):
        amount = pdf[value].to_numpy(float)
        cv = pdf[error].to_numpy(float)
        seen = amount > 0
        safe = np.where(seen, amount, 1.0)
        if is_se:
            cv = cv / safe
        present = np.isfinite(cv) & (cv > 0)
        if self.missing_cv is not None:
            cv = np.where(present, cv, self.missing_cv)
            present = np.ones_like(present)
        self.unused += int((seen & ~present).sum())
        seen &= present
        self.used += int(seen.sum())
        square, y = np.full(shape, np.nan), np.zeros(shape)
        square[row[seen], column[seen]] = np.square(cv[seen])
        y[row[seen], column[seen]] = np.log(safe[seen])
        return square, y

    @staticmethod
    def _weights(square: np.ndarray, tau: float = 0.0) -> tuple[np.ndarray, float]:
        """Reciprocal variances, 0 where nothing was seen, and what they add to the likelihood."""
        seen = np.isfinite(square)
        variance = np.log(np.where(seen, square, 1.0) + tau * tau + 1)
        return np.where(seen, 1 / variance, 0.0), 0.5 * float(np.sum(LOG_2PI + np.log(variance[seen])))

    def solve(self, log_sigma, log_q: float = 0.0, log_tau: float | None = None, log_tau_index: float | None = None):
        """States, their variances and the negative log likelihood at given parameters.

        ``log_sigma`` is one number, or one per region.
        """
        weight, index_weight, constant = self.weight, self.index_weight, self.constant
        if log_tau is not None or log_tau_index is not None:
            weight, constant = self._weights(self.square, 0.0 if log_tau is None else math.exp(log_tau))
            index_weight, more = self._weights(self.index_square, 0.0 if log_tau_index is None else math.exp(log_tau_index))
            constant += more
        n, regions = weight.shape
        log_sigma = np.broadcast_to(np.asarray(log_sigma, float), regions)
        link = np.exp(-2 * log_sigma)
        ends = np.array([(t > 0) + (t < n - 1) for t in range(n)], dtype=float).reshape(-1, 1)
        diagonal = weight + index_weight + link * ends
        index = self.index_y - log_q
        b = weight * self.y + index_weight * index
        pivot, forward = np.empty_like(diagonal), np.empty_like(diagonal)
        pivot[0], forward[0] = diagonal[0], b[0]
        for t in range(1, n):
            factor = link / pivot[t - 1]
            pivot[t] = diagonal[t] - link * factor
            forward[t] = b[t] + factor * forward[t - 1]
        state, variance = np.empty_like(diagonal), np.empty_like(diagonal)
        state[-1], variance[-1] = forward[-1] / pivot[-1], 1 / pivot[-1]
        for t in range(n - 2, -1, -1):
            factor = link / pivot[t]
            state[t] = forward[t] / pivot[t] + factor * state[t + 1]
            variance[t] = 1 / pivot[t] + factor * factor * variance[t + 1]
        # from residuals and steps: sums of squared logs would cancel almost wholly where weights are large
        squares = np.sum(weight * (self.y - state) ** 2) + np.sum(index_weight * (index - state) ** 2)
        squares += np.sum(link * np.diff(state, axis=0) ** 2)
        nll = (
            0.5 * (n - 1) * float(np.sum(LOG_2PI + 2 * log_sigma))
            + constant
            + 0.5 * (squares + np.sum(np.log(pivot)))
            - 0.5 * regions * n * LOG_2PI
        )
        return state, variance, float(nll)

    def best_log_q(self, log_sigma: float) -> float:
        """The likelihood is a parabola in ln q: three points give its minimum."""
        if not self.has_index:
            return 0.0
        middle = float(np.sum(self.index_weight * self.index_y) / np.sum(self.index_weight))
        middle -= float(np.sum(self.weight * self.y) / max(np.sum(self.weight), 1e-300))
        low, mid, high = (self.solve(log_sigma, middle + d)[2] for d in (-1.0, 0.0, 1.0))
        return middle + 0.5 * (low - high) / (low - 2 * mid + high)

    def at(self, theta):
        """``solve`` at a vector: process errors, ln q, extra cv of the biomass, extra cv of the index."""
        k = int(self.process.max()) + 1
        more = list(theta[k:])
        log_q = more.pop(0) if self.has_index else 0.0
        log_tau = more.pop(0) if self.extra_biomass else None
        return self.solve(np.asarray(theta)[self.process], log_q, log_tau, more.pop(0) if self.extra_cpue else None)

    def nll(self, theta) -> float:
        return self.at(theta)[2]

    def parameters(self) -> list[tuple[str, float, float]]:
        """Name and bounds of each parameter, in the order of ``at``."""
        k = int(self.process.max()) + 1
        found = [("process_error" if k == 1 else f"process_error_{i + 1}", *LOG_SIGMA_BOUNDS) for i in range(k)]
        if self.has_index:
            found.append(("scaling_parameter_q", -np.inf, np.inf))
        if self.extra_biomass:
            found.append(("extra_biomass_cv", *LOG_TAU_BOUNDS))
        if self.extra_cpue:
            found.append(("extra_cpue_cv", *LOG_TAU_BOUNDS))
        return found


def _minimise(profile, low: float, high: float) -> float:
    """Coarse grid, then golden section around its best point."""
    points = np.linspace(low, high, 29)
    values = [profile(p) for p in points]
    best = int(np.argmin(values))
    a, d = points[max(best - 1, 0)], points[min(best + 1, len(points) - 1)]
    gold = (math.sqrt(5) - 1) / 2
    b, c = d - gold * (d - a), a + gold * (d - a)
    fb, fc = profile(b), profile(c)
    while d - a > 1e-6:
        if fb < fc:
            d, c, fc = c, b, fb
            b = d - gold * (d - a)
            fb = profile(b)
        else:
            a, b, fb = b, c, fc
            c = a + gold * (d - a)
            fc = profile(c)
    return 0.5 * (a + d)


def _gradient(f, theta, step=1e-4):
    out = np.empty(len(theta))
    for i in range(len(theta)):
        d = np.zeros(len(theta))
        d[i] = step
        out[i] = (f(theta + d) - f(theta - d)) / (2 * step)
    return out


def _hessian(f, theta, step=1e-3):
    k = len(theta)
    out = np.empty((k, k))
    middle = f(theta)
    for i in range(k):
        di = np.zeros(k)
        di[i] = step
        out[i, i] = (f(theta + di) - 2 * middle + f(theta - di)) / step**2
        for j in range(i):
            dj = np.zeros(k)
            dj[j] = step
            mixed = f(theta + di + dj) - f(theta + di - dj) - f(theta - di + dj) + f(theta - di - dj)
            out[i, j] = out[j, i] = mixed / (4 * step**2)
    return out


def _number(value) -> float | None:
    return float(value) if np.isfinite(value) else None


def _newton(f, theta, low: float, high: float):
    """Newton steps to a small gradient: (theta, steps, why it stopped).

    A long step is shortened, one that does not lower ``f`` is halved.
    """
    for steps in range(NEWTON_STEPS):
        gradient = _gradient(f, theta)
        if np.max(np.abs(gradient)) < NEWTON_GRADIENT:
            return theta, steps, "gradient"
        hessian = _hessian(f, theta)
        if np.any(np.linalg.eigvalsh(hessian) <= 0):
            return theta, steps, "not convex"
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 0.5 / np.max(np.abs(step)))
        before = f(theta)
        while np.max(np.abs(step)) > 1e-10 and not (low <= (theta - step)[0] <= high and f(theta - step) <= before):
            step /= 2
        if np.max(np.abs(step)) <= 1e-10:
            return theta, steps, "no lower value"
        theta = theta - step
    return theta, NEWTON_STEPS, "steps"


def _bounded(f, theta: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Newton steps between bounds: (theta, steps, why it stopped).

    A parameter at a bound that the slope pushes against it is held there; the Hessian of the others is
    made convex where it is not; steps are clipped to the bounds and halved until they lower ``f`` enough.
    """
    theta = np.clip(theta, low, high)
    value = f(theta)
    for steps in range(4 * NEWTON_STEPS):
        gradient, hessian = _gradient(f, theta), _hessian(f, theta)
        held = ((theta <= low) & (gradient > 0)) | ((theta >= high) & (gradient < 0))
        free = np.flatnonzero(~held)
        if not len(free) or np.max(np.abs(gradient[free])) < 10 * NEWTON_GRADIENT:
            return theta, steps, "at bound" if held.any() else "gradient"
        values, vectors = np.linalg.eigh(hessian[np.ix_(free, free)])
        slope = vectors.T @ gradient[free]
        step = np.zeros(len(theta))
        step[free] = -vectors @ (slope / np.maximum(np.abs(values), 1e-3))
        step *= min(1.0, 1.0 / np.max(np.abs(step)))
        while True:
            there = np.clip(theta + step, low, high)
            lower = f(there)
            if lower <= value + 1e-4 * float(gradient @ (there - theta)) or np.max(np.abs(step)) < 1e-10:
                break
            step /= 2
        if np.max(np.abs(step)) < 1e-10:
            return theta, steps, "at bound" if held.any() else "no lower value"
        theta, value = there, lower
    return theta, 4 * NEWTON_STEPS, "steps"


def _best(stock: _Stock):
    """The parameters of least negative log likelihood: (theta, steps, why it stopped)."""
    low, high = LOG_SIGMA_BOUNDS
    log_sigma = _minimise(lambda s: stock.solve(s, stock.best_log_q(s))[2], low, high)
    known = stock.parameters()
    start = [log_sigma] * (int(stock.process.max()) + 1)
    if stock.has_index:
        start.append(stock.best_log_q(log_sigma))
    extra = len(known) - len(start)
    if not extra and stock.process.max() == 0:
        return _newton(stock.nll, np.array(start), low, high)
    lows, highs = (np.array([p[i] for p in known]) for i in (1, 2))
    # variances that depend on parameters can have more than one valley
    found = [_bounded(stock.nll, np.array([*start, *taus]), lows, highs) for taus in product(TAU_STARTS, repeat=extra)]
    theta, steps, stop = min(found, key=lambda x: stock.nll(x[0]))
    return theta, steps, stop


def fit_stock(pdf: pd.DataFrame, is_se: bool = False, missing_cv: float | None = MISSING_CV) -> dict:
    """Fit one stock: parameters, states with intervals, and convergence numbers.

    A positive amount with a zero or missing cv counts with ``missing_cv``; with None it is
    left out and counted as unused. Extra observation errors and several process errors are asked for
    by the columns of ``with_extra_error`` and ``with_process_errors``; all parameters are then fitted together
    between their bounds. A fit with a parameter at its bound, or with an extra error whose interval
    reaches one, says so as its reason to stop: it has not converged.
    """
    stock = _Stock(pdf, is_se, missing_cv)
    known = stock.parameters()
    names = [p[0] for p in known]
    theta, steps, stop = _best(stock)
    lows, highs = (np.array([p[i] for p in known]) for i in (1, 2))
    free = (theta > lows) & (theta < highs)
    gradient = _gradient(stock.nll, theta)[free]
    hessian = _hessian(stock.nll, theta)
    determinant = np.linalg.det(hessian)
    covariance = np.full(hessian.shape, np.nan)
    inner = np.ix_(free, free)
    if free.any() and np.linalg.det(hessian[inner]) > 0:
        covariance[~free] = covariance[:, ~free] = 0.0
        covariance[inner] = np.linalg.inv(hessian[inner])

    state, variance, nll = stock.at(theta)
    slopes = []
    for i in range(len(theta)):
        d = np.zeros(len(theta))
        d[i] = 1e-4
        slopes.append((stock.at(theta + d)[0] - stock.at(theta - d)[0]) / 2e-4)
    slopes = np.stack(slopes)
    sd = np.sqrt(variance + np.einsum("itr,ij,jtr->tr", slopes, covariance, slopes))
    errors = np.sqrt(np.where(np.diag(covariance) > 0, np.diag(covariance), np.nan))
    if not free.all():
        stop, determinant = "at bound", -1.0
    elif any(
        name.startswith("extra") and not (low < t - Z_ROUNDED * e and t + Z_ROUNDED * e < high)
        for name, t, e, low, high in zip(names, theta, errors, lows, highs)
    ):
        stop = "interval at bound"
    states = [
        {
            "region": region,
            "year": int(year),
            "re_est": _number(math.exp(state[t, r])),
            "re_lci": _number(np.exp(state[t, r] - Z_ROUNDED * sd[t, r])),
            "re_uci": _number(np.exp(state[t, r] + Z_ROUNDED * sd[t, r])),
            "biomsd": _number(state[t, r]),
            "biomsd_sd": _number(sd[t, r]),
        }
        for r, region in enumerate(stock.regions)
        for t, year in enumerate(stock.years)
    ]
    return {
        "nll": nll,
        "mgc": float(np.max(np.abs(gradient), initial=0.0)),
        "log_det_hess": _number(math.log(determinant)) if determinant > 0 else None,
        "n_par": len(theta),
        "n_used": stock.used,
        "n_unused": stock.unused,
        "steps": steps,
        "stop": stop,
        "parameters": [
            {"parameter": n, "est": float(e), "se": _number(s)} for n, e, s in zip(names, theta, errors)
        ],
        "states": states,
    }


# --- fits as tables --------------------------------------------------------
def rw_fit(observations: DataFrame, is_se: bool = False, missing_cv: float | None = MISSING_CV) -> DataFrame:
    """One row per model and species with its parameters and states.

    ``observations`` has model_name, species, region, year, biomass, cv and may have
    cpue and cpue_cv. A group holds the years by regions of one stock, never raw
    records. Several tables can be read from a fit: settle it first. ``missing_cv`` as
    in ``fit_stock``.
    """
    ship_package(observations.sparkSession)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        model_name, species = key
        return pd.DataFrame([{"species": species, "model_name": model_name, **fit_stock(pdf, is_se, missing_cv)}])

    return observations.groupBy("model_name", "species").applyInPandas(fit, FIT)


def state_rows(fit: DataFrame) -> DataFrame:
    return fit.select("model_name", "species", F.inline("states"))


def total_log_sd(mean: str = "biomsd", sd: str = "biomsd_sd"):
    """Log-scale sd of a sum of log-normal estimates (delta method)."""
    m, s2 = F.col(mean), F.col(sd) * F.col(sd)
    numerator = F.sum(F.exp(2 * m + s2) * (F.exp(s2) - 1))
    denominator = F.sum(F.exp(m + 0.5 * s2))
    return F.sqrt(F.log(F.try_divide(numerator, denominator * denominator) + 1))


def rw_area_output(fit: DataFrame) -> DataFrame:
    """Estimate and interval per region and year, and for all regions as TOTAL."""
    states = state_rows(fit)
    columns = ["model_name", "species", "year", "region", "re_est", "re_lci", "re_uci"]
    totals = (
        states.groupBy("model_name", "species", "year")
        .agg(F.sum("re_est").alias("re_est"), total_log_sd().alias("sd"))
        .select(
            "model_name",
            "species",
            "year",
            F.lit("TOTAL").alias("region"),
            "re_est",
            F.exp(F.log("re_est") - Z_ROUNDED * F.col("sd")).alias("re_lci"),
            F.exp(F.log("re_est") + Z_ROUNDED * F.col("sd")).alias("re_uci"),
        )
    )
    return totals.unionByName(states.select(*columns))


def input_check(data: DataFrame) -> DataFrame:
    """Positive biomass and how much of it has a zero or missing cv, by species and region."""
    seen = data.filter(F.col("biomass") > 0)
    bare = F.col("cv").isNull() | F.isnan("cv") | (F.col("cv") <= 0)
    return seen.groupBy("species", "region").agg(
        F.count(F.lit(1)).alias("n_observed"), F.count(F.when(bare, 1)).alias("n_without_cv")
    )


def fit_diagnostics(fit: DataFrame) -> DataFrame:
    return fit.select(
        "model_name",
        "species",
        "log_det_hess",
        "mgc",
        "n_used",
        "n_unused",
        "steps",
        "stop",
        (
            (F.col("mgc") < 0.001) & (F.coalesce("log_det_hess", F.lit(-1.0)) > 0) & ~F.col("stop").endswith("at bound")
        ).alias("converged"),
    )


def param_ci(parameters: DataFrame, z: float = Z_EXACT) -> DataFrame:
    """Natural-scale estimate, error and interval from a log-scale estimate and error."""
    est, se = F.col("est"), F.col("se")
    return parameters.withColumns(
        {
            "estimate": F.exp(est),
            "std_err": F.exp(est) * se,
            "lci": F.exp(est - z * se),
            "uci": F.exp(est + z * se),
        }
    ).drop("est", "se")


def param_table(fit: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """Parameters of all models and groups; ``also`` adds ones known from elsewhere."""
    rows = fit.select(F.col("species").alias("species_group"), "model_name", F.inline("parameters"))
    columns = ["species_group", "model_name", "parameter", "estimate", "std_err", "lci", "uci"]
    table = param_ci(rows).select(*columns)
    if also is not None:
        table = table.unionByName(param_ci(also).select(*columns))
    return table.orderBy("species_group", "model_name", "parameter")


def model_aic(fit: DataFrame) -> DataFrame:
    """AIC of each model and its rank and distance within the species.

    A species has as many rows here as models were fitted to it.
    """
    aic = 2 * F.col("nll") + 2 * F.col("n_par")
    within = W.partitionBy("species")
    rows = fit.select("species", "model_name", "nll", "n_par", aic.alias("aic"))
    return rows.select(
        "*",
        (F.col("aic") - F.min("aic").over(within)).alias("delta_aic"),
        F.rank().over(within.orderBy("aic")).alias("rank"),
    )


def observations(grid: DataFrame, model_name: str) -> DataFrame:
    """Model input rows labelled with the model to fit."""
    return grid.withColumn("model_name", F.lit(model_name))


def stack_models(models: Mapping[str, DataFrame]) -> DataFrame:
    """Inputs of several models in one table, so that all are fitted in one job."""
    parts = [observations(grid, name) for name, grid in models.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union
