import math

import numpy as np
import pandas as pd
import pytest

import golden
from fathomline.plans import statespace as m
from fathomline.session import settled


def frame(data, first, last, regions=("AI", "EBS Slope", "SBS")):
    seen = {(r, y): (b, c) for r, y, b, c in data}
    return pd.DataFrame(
        [(r, y, *seen.get((r, y), (0.0, 0.0))) for r in regions for y in range(first, last + 1)],
        columns=["region", "year", "biomass", "cv"],
    )


def test_published_2020_fit():
    fit = m.fit_stock(frame([x for x in golden.SURVEY if x[1] <= 2020], 1982, 2020))
    assert fit["nll"] == pytest.approx(golden.NLL_2020, abs=1e-5)  # inputs are rounded
    assert fit["parameters"][0]["est"] == pytest.approx(golden.LOG_SIGMA_2020, abs=1e-5)
    assert fit["log_det_hess"] == pytest.approx(golden.LOG_DET_2020, abs=1e-3)
    total = sum(s["re_est"] for s in fit["states"] if s["year"] == 2020)
    assert total == pytest.approx(golden.BIOMASS_2020, rel=1e-3)
    assert fit["mgc"] < 0.001


@pytest.fixture(scope="module")
def fit_2022(spark):
    data = spark.createDataFrame(
        [("SST", r, y, b, c) for r, y, b, c in golden.SURVEY],
        "species STRING, region STRING, year INT, biomass DOUBLE, cv DOUBLE",
    )
    index = spark.createDataFrame(golden.INDEX, "year INT, cpue DOUBLE, cv DOUBLE")
    grid = m.model_input_grid(data, 2023)
    models = {"Model 20": grid, "Model 22": m.with_index(grid, index, "SST", "EBS Slope")}
    return settled(m.rw_fit(m.stack_models(models)))


def test_published_2022_parameters(fit_2022):
    got = {
        (r["model_name"], r["parameter"]): (r["estimate"], r["std_err"], r["lci"], r["uci"])
        for r in m.param_table(fit_2022).collect()
    }
    assert got["Model 20", "process_error"] == pytest.approx(golden.MODEL_20, abs=1e-5)
    assert got["Model 22", "process_error"] == pytest.approx(golden.MODEL_22, abs=1e-5)
    assert got["Model 22", "scaling_parameter_q"] == pytest.approx(golden.MODEL_22_Q, abs=1e-5)


def test_published_2022_totals(fit_2022):
    rows = m.rw_area_output(fit_2022).filter("region = 'TOTAL'").collect()
    got = {(r["model_name"], r["year"]): r for r in rows}
    for year, (one, two) in golden.TOTALS.items():
        assert got["Model 20", year]["re_est"] == pytest.approx(one, rel=1e-6)
        assert got["Model 22", year]["re_est"] == pytest.approx(two, rel=1e-6)
    last = got["Model 22", 2023]
    assert last["re_lci"] < last["re_est"] < last["re_uci"]


def test_diagnostics_and_aic(fit_2022):
    assert all(r["converged"] for r in m.fit_diagnostics(fit_2022).collect())
    ranks = {r["model_name"]: (r["rank"], r["delta_aic"], r["aic"] - 2 * r["nll"]) for r in m.model_aic(fit_2022).collect()}
    assert sorted(r[0] for r in ranks.values()) == [1, 2]
    assert min(r[1] for r in ranks.values()) == 0
    assert ranks["Model 20"][2] == pytest.approx(2) and ranks["Model 22"][2] == pytest.approx(4)


def dense(pdf, log_sigma):
    """States, variances and likelihood from full matrices."""
    states, variances, nll = [], [], 0.0
    for _, region in pdf.groupby("region"):
        n = len(region)
        seen = (region["biomass"] > 0).to_numpy()
        y = np.where(seen, np.log(np.where(seen, region["biomass"], 1)), 0)
        s2 = np.log(region["cv"].to_numpy() ** 2 + 1)
        w = np.where(seen, 1 / np.where(seen, s2, 1), 0)
        step = np.diff(np.eye(n), axis=0)
        precision = np.diag(w) + step.T @ step * math.exp(-2 * log_sigma)
        x = np.linalg.solve(precision, w * y)
        quad = np.sum(w * (y - x) ** 2) + np.sum((step @ x) ** 2) * math.exp(-2 * log_sigma)
        nll += 0.5 * quad + 0.5 * np.linalg.slogdet(precision)[1] - 0.5 * n * math.log(2 * math.pi)
        nll += 0.5 * np.sum(np.log(2 * math.pi * s2[seen])) + 0.5 * (n - 1) * (math.log(2 * math.pi) + 2 * log_sigma)
        states.append(x)
        variances.append(np.diag(np.linalg.inv(precision)))
    return np.array(states).T, np.array(variances).T, nll


def test_banded_solution_equals_the_dense_one():
    pdf = frame(golden.SURVEY, 1991, 2023)
    stock = m._Stock(pdf, False)
    for log_sigma in (-3.0, -1.0, 0.5):
        state, variance, nll = stock.solve(log_sigma)
        x, v, f = dense(pdf, log_sigma)
        assert np.allclose(state, x) and np.allclose(variance, v) and nll == pytest.approx(f, rel=1e-10)


def test_standard_errors_can_be_given():
    pdf = frame(golden.SURVEY, 1991, 2023)
    as_se = pdf.assign(cv=pdf["cv"] * pdf["biomass"])
    assert m.fit_stock(as_se, is_se=True)["nll"] == pytest.approx(m.fit_stock(pdf)["nll"])


def test_one_region_with_one_year():
    fit = m.fit_stock(pd.DataFrame({"region": ["AI"], "year": [2000], "biomass": [10.0], "cv": [0.1]}))
    assert fit["states"][0]["re_est"] == pytest.approx(10.0)


def test_input_grid(spark, rows):
    data = spark.createDataFrame(
        [("a", "AI", 2000, 5.0, 0.1), ("a", "SBS", 2001, 0.0, None), ("b", "SBS", 2002, 1.0, 0.2)],
        "species STRING, region STRING, year INT, biomass DOUBLE, cv DOUBLE",
    )
    got = rows(m.model_input_grid(data, 2003))
    assert len(got) == 8 and {r[:2] for r in got} == {("a", "AI"), ("b", "SBS")}
    assert ("a", "AI", 2001, 0.0, 0.0) in got
    own = rows(m.model_input_grid(data, 2003, per_species_start=True))
    assert len(own) == 6
    wide = rows(m.model_input_wide(m.model_input_grid(data, 2003), ["AI", "SBS"]))
    assert ("a", "mu", 2000, 5.0, 0.0) in wide and ("b", "cv", 2002, 0.0, 0.2) in wide


def test_an_observation_without_cv_counts_by_rule():
    seen = [("A", y, b, c) for y, b, c in ((2000, 10.0, 0.1), (2001, 500.0, 0.0), (2002, 10.0, 0.1))]
    counted = m.fit_stock(frame(seen, 2000, 2002, ("A",)))
    left_out = m.fit_stock(frame(seen, 2000, 2002, ("A",)), missing_cv=None)
    assert (counted["n_used"], counted["n_unused"]) == (3, 0)
    assert (left_out["n_used"], left_out["n_unused"]) == (2, 1)
    assert counted["states"][1]["re_est"] > left_out["states"][1]["re_est"] * 1.0001
    assert left_out["states"][1]["re_est"] == pytest.approx(10.0, rel=1e-3)


def test_newton_reports_why_it_stopped():
    fit = m.fit_stock(frame([x for x in golden.SURVEY if x[1] <= 2020], 1982, 2020))
    assert fit["stop"] in ("gradient", "no lower value") and fit["mgc"] < 1e-5 and fit["steps"] < 50


def five_models():
    """The stock with and without the index, and with extra observation errors."""
    own = frame(golden.SURVEY, 1991, 2023)
    index = {y: (c, v) for y, c, v in golden.INDEX}
    seen = [index.get(y, (np.nan, np.nan)) if r == "EBS Slope" else (np.nan, np.nan) for r, y in zip(own["region"], own["year"])]
    both = own.assign(cpue=[x[0] for x in seen], cpue_cv=[x[1] for x in seen])
    return {
        "Model 20": own,
        "Model 22": both,
        "Model 22.2.a": both.assign(extra_biomass=True),
        "Model 22.2.b": both.assign(extra_cpue=True),
        "Model 22.2.c": both.assign(extra_biomass=True, extra_cpue=True),
    }


def test_extra_observation_errors_converge_as_published():
    fits = {name: m.fit_stock(pdf) for name, pdf in five_models().items()}
    # the published run found no convergence for an extra error of the biomass
    assert [f["stop"].endswith("at bound") for f in fits.values()] == [False, False, True, False, True]
    assert [f["n_par"] for f in fits.values()] == [1, 2, 3, 3, 4]
    assert fits["Model 22.2.b"]["mgc"] < 0.001 and fits["Model 22.2.b"]["log_det_hess"] > 0
    assert fits["Model 22.2.a"]["log_det_hess"] is None
    # a model that holds another one is at least as likely; an extra error at its lower bound adds nothing
    assert fits["Model 22.2.b"]["nll"] < fits["Model 22"]["nll"]
    assert fits["Model 22.2.a"]["nll"] == pytest.approx(fits["Model 22"]["nll"], abs=1e-3)
    assert fits["Model 22.2.c"]["nll"] == pytest.approx(fits["Model 22.2.b"]["nll"], abs=1e-3)


@pytest.mark.parametrize("name", ["Model 22.2.a", "Model 22.2.b"])
def test_joint_fit_against_a_grid(name):
    pdf = five_models()[name]
    stock, fit = m._Stock(pdf, False), m.fit_stock(pdf)
    centre = np.array([p["est"] for p in fit["parameters"]])
    wide = [np.linspace(-4, 0.5, 19), np.linspace(-1.5, 0.8, 24), np.linspace(*m.LOG_TAU_BOUNDS, 23)]
    best = min((stock.nll(np.array(t)), t) for t in ((a, b, c) for a in wide[0] for b in wide[1] for c in wide[2]))
    assert fit["nll"] <= best[0] + 1e-9 and np.abs(np.array(best[1]) - centre).max() < 0.35
    low, high = (np.array([p[i] for p in stock.parameters()]) for i in (1, 2))
    steps = (-0.02, 0.0, 0.02)
    around = [np.clip(centre + np.array(d), low, high) for d in ((a, b, c) for a in steps for b in steps for c in steps)]
    assert min(map(stock.nll, around)) >= fit["nll"] - 1e-9


def test_several_process_errors():
    pdf = five_models()["Model 20"]
    own = m.fit_stock(pdf.assign(process=pdf["region"].map({"AI": 1, "EBS Slope": 2, "SBS": 2})))
    assert [p["parameter"] for p in own["parameters"]] == ["process_error_1", "process_error_2"]
    # regions are independent given their parameters: the parts fitted alone add up
    alone = [m.fit_stock(part) for part in (pdf[pdf["region"] == "AI"], pdf[pdf["region"] != "AI"])]
    assert own["nll"] == pytest.approx(sum(f["nll"] for f in alone), abs=1e-6)
    for mine, other in zip(own["parameters"], alone):
        assert mine["est"] == pytest.approx(other["parameters"][0]["est"], abs=1e-4)
    shared = m.fit_stock(pdf.assign(process=1))
    assert shared["nll"] == pytest.approx(m.fit_stock(pdf)["nll"], abs=1e-12) and own["nll"] <= shared["nll"]


def test_extra_errors_as_tables(spark):
    schema = "species STRING, region STRING, year INT, biomass DOUBLE, cv DOUBLE"
    data = spark.createDataFrame([("SST", r, y, b, c) for r, y, b, c in golden.SURVEY], schema)
    index = spark.createDataFrame(golden.INDEX, "year INT, cpue DOUBLE, cv DOUBLE")
    grid = m.model_input_grid(data, 2023)
    both = m.with_index(grid, index, "SST", "EBS Slope")
    models = {
        "Model 20": grid,
        "Model 22": both,
        "Model 22.2.a": m.with_extra_error(both, biomass=True),
        "Model 22.2.b": m.with_extra_error(both, cpue=True),
        "Model 22.2.c": m.with_extra_error(both, biomass=True, cpue=True),
        "own errors": m.with_process_errors(grid, {"AI": 2}),
    }
    fit = settled(m.rw_fit(m.stack_models(models)))
    converged = {r["model_name"]: r["converged"] for r in m.fit_diagnostics(fit).collect()}
    assert [converged[name] for name in models] == [True, True, False, True, False, True]
    wanted = {name: m.fit_stock(pdf)["nll"] for name, pdf in five_models().items()}
    ranked = {r["model_name"]: (r["nll"], r["n_par"]) for r in m.model_aic(fit).collect()}
    assert all(ranked[name][0] == pytest.approx(nll) for name, nll in wanted.items())
    parameters = {(r["model_name"], r["parameter"]): r for r in m.param_table(fit).collect()}
    bound = parameters["Model 22.2.a", "extra_biomass_cv"]
    assert bound["std_err"] is None and bound["estimate"] == pytest.approx(math.exp(-7.0))
    assert ("own errors", "process_error_2") in parameters


def test_recursion_equals_the_numerics_of_the_fit(spark):
    from fathomline.plans import recursion

    tables, points, want = [], [], {}
    thetas = {"Model 20": [(-2.0,), (-0.5,)], "Model 22.2.c": [(-2.0, -0.3, -1.0, -2.0), (-1.0, 0.2, 0.1, -5.0)]}
    for name, rows in thetas.items():
        pdf = five_models()[name]
        stock = m._Stock(pdf, False)
        held = pdf.assign(model_name=name, species="SST").reindex(columns=["model_name", "species", "region", "year", "biomass", "cv", "cpue", "cpue_cv"])
        tables += [tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in held.itertuples(index=False)]
        for i, theta in enumerate(rows):
            points.append((name, "SST", i, *theta, *[None] * (4 - len(theta))))
            want[name, i] = stock.at(np.array(theta)), stock
    data = spark.createDataFrame(tables, "model_name STRING, species STRING, region STRING, year INT, biomass DOUBLE, cv DOUBLE, cpue DOUBLE, cpue_cv DOUBLE")
    series = recursion.region_series(data.filter("biomass > 0 OR cpue > 0 OR year IN (1991, 2023)"))
    given = spark.createDataFrame(points, f"model_name STRING, species STRING, {recursion.POINT}")
    for r in recursion.likelihood_at(series, given).collect():
        assert r["nll"] == pytest.approx(want[r["model_name"], r["point"]][0][2], rel=1e-10)
    rows = recursion.states_at(series, given).collect()
    assert len(rows) == 4 * 3 * 33
    for r in rows:
        (state, variance, _), stock = want[r["model_name"], r["point"]]
        at = r["year"] - 1991, stock.regions.index(r["region"])
        assert r["biomsd"] == pytest.approx(state[at], rel=1e-9) and r["variance"] == pytest.approx(variance[at], rel=1e-9)
