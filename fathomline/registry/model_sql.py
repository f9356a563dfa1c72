"""The model fit in SQL, to check the fitted tables.

Given parameters, elimination over the years and back substitution are recursions. The least point is
sought on a grid of log sigma (the likelihood is a parabola in ln q), on a finer grid around its best
point, and by one Newton step from there.
"""

from __future__ import annotations

from fathomline.plans import statespace as m

_LOG_2PI = repr(m.LOG_2PI)
OBS_SQL = f"""
SELECT k.model_name, i.species, i.region, i.year, i.year - f.first + 1 AS t, f.n,
       CASE WHEN i.biomass > 0 THEN 1 / ln(CASE WHEN i.cv > 0 THEN i.cv * i.cv ELSE {m.MISSING_CV**2} END + 1) ELSE 0.0::DOUBLE END AS w,
       CASE WHEN i.biomass > 0 THEN ln(i.biomass) ELSE 0.0::DOUBLE END AS y,
       CASE WHEN l.cpue > 0 THEN 1 / ln(CASE WHEN l.cv > 0 THEN l.cv * l.cv ELSE {m.MISSING_CV**2} END + 1) ELSE 0.0::DOUBLE END AS v,
       CASE WHEN l.cpue > 0 THEN ln(l.cpue / 1000) ELSE 0.0::DOUBLE END AS z
FROM inputs i CROSS JOIN (SELECT min(year) AS first, max(year) - min(year) + 1 AS n FROM inputs) f
CROSS JOIN (SELECT unnest(['Model 20', 'Model 22']) AS model_name) k
LEFT JOIN line_index l ON k.model_name = 'Model 22' AND i.species = 'SST' AND i.region = 'EBS_SLOPE'
  AND l.strata = 'EBS Slope' AND l.year = i.year"""
_CELL = "point, model_name, species, region, t"


def solve_sql(name: str, points: str) -> dict[str, str]:
    """Elimination, states with their variances, and likelihood at the rows (model_name, species, point, s, q) of ``points``."""
    return {
        f"{name}_system": f"""
SELECT p.point, model_name, species, o.region, o.year, o.t, o.n, p.s, p.q, o.w, o.y, o.v, o.z - p.q AS z, exp(-2 * p.s) AS link,
       o.w + o.v + exp(-2 * p.s) * (CASE WHEN o.t > 1 THEN 1 ELSE 0 END + CASE WHEN o.t < o.n THEN 1 ELSE 0 END) AS d,
       o.w * o.y + o.v * (o.z - p.q) AS b
FROM obs o JOIN {points} p USING (model_name, species)""",
        f"{name}_forward": f"""
SELECT {_CELL}, link, n, d AS p, b AS f FROM {name}_system WHERE t = 1
UNION ALL
SELECT s.point, s.model_name, s.species, s.region, s.t, s.link, s.n, s.d - s.link * s.link / r.p, s.b + s.link / r.p * r.f
FROM {name}_forward r JOIN {name}_system s
  ON s.point = r.point AND s.model_name = r.model_name AND s.species = r.species AND s.region = r.region AND s.t = r.t + 1""",
        f"{name}_states": f"""
SELECT {_CELL}, f / p AS x, 1 / p AS var, CAST(NULL AS DOUBLE) AS later FROM {name}_forward WHERE t = n
UNION ALL
SELECT r.point, r.model_name, r.species, r.region, r.t, r.f / r.p + r.link / r.p * u.x, 1 / r.p + r.link / r.p * r.link / r.p * u.var, u.x
FROM {name}_states u JOIN {name}_forward r
  ON r.point = u.point AND r.model_name = u.model_name AND r.species = u.species AND r.region = u.region AND r.t = u.t - 1""",
        f"{name}_nll": f"""
SELECT model_name, species, point, any_value(s.s) AS s, any_value(s.q) AS q, sum(
         0.5 * (w * (y - x) * (y - x) + v * (z - x) * (z - x) + CASE WHEN w > 0 THEN {_LOG_2PI} - ln(w) ELSE 0 END
                + CASE WHEN v > 0 THEN {_LOG_2PI} - ln(v) ELSE 0 END + ln(r.p) + coalesce(s.link * (later - x) * (later - x), 0))
         + CASE WHEN t = 1 THEN 0.5 * (s.n - 1) * ({_LOG_2PI} + 2 * s.s) - 0.5 * s.n * {_LOG_2PI} ELSE 0 END) AS nll
FROM {name}_system s JOIN {name}_forward r USING ({_CELL}) JOIN {name}_states u USING ({_CELL}) GROUP BY model_name, species, point""",
    }


def _profile_sql(name: str) -> dict[str, str]:
    """Per grid number (point // 3) the least likelihood over ln q, from its values at -1, 0 and 1, and where it is."""
    low, mid, high = (f"max(CASE WHEN point % 3 = {k} THEN nll END)" for k in range(3))
    return {
        f"{name}_three": f"SELECT model_name, species, point // 3 AS i, any_value(s) AS s, {low} AS lo, {mid} AS mid, {high} AS hi FROM {name}_nll GROUP BY ALL",
        f"{name}_profile": f"""
SELECT model_name, species, i, s, CASE WHEN lo IS NULL THEN 0 ELSE 0.5 * (lo - hi) / (lo - 2 * mid + hi) END AS q,
       CASE WHEN lo IS NULL THEN mid ELSE mid - (hi - lo) * (hi - lo) / (8 * (lo - 2 * mid + hi)) END AS nll
FROM {name}_three""",
    }


def _grid_sql(centre: str, numbers: int, step: float) -> str:
    """Points around a log sigma; three values of ln q where there is an index, else one in their middle."""
    return f"""
SELECT c.model_name, c.species, CAST(3 * g.i + d.d AS INTEGER) AS point, c.s + {step} * g.i AS s, CAST(d.d - 1 AS DOUBLE) AS q
FROM {centre} c CROSS JOIN (SELECT unnest(range({numbers})) AS i) g CROSS JOIN (SELECT unnest([0, 1, 2]) AS d) d
WHERE c.k = 2 OR d.d = 1"""


# gradient by steps of 1e-4, Hessian by steps of 1e-3, as the fit takes them; 0 is the middle
_STENCIL = [(0, 0.0, 0.0, 1), (1, 1e-4, 0.0, 1), (2, -1e-4, 0.0, 1), (3, 1e-3, 0.0, 1), (4, -1e-3, 0.0, 1), (5, 0.0, 1e-4, 2),
            (6, 0.0, -1e-4, 2), (7, 0.0, 1e-3, 2), (8, 0.0, -1e-3, 2), (9, 1e-3, 1e-3, 2), (10, 1e-3, -1e-3, 2),
            (11, -1e-3, 1e-3, 2), (12, -1e-3, -1e-3, 2)]


def _stencil_sql(name: str, centre: str) -> dict[str, str]:
    """Slopes and curvatures at the rows (model_name, species, k, s, q) of ``centre``."""
    values = ", ".join(f"({p}, {a!r}, {b!r}, {k})" for p, a, b, k in _STENCIL)
    at = [f"max(CASE WHEN point = {p} THEN nll END)" for p in range(len(_STENCIL))]
    points = {
        f"{name}_points": f"""
SELECT c.model_name, c.species, g.point, c.s + g.a::DOUBLE AS s, c.q + g.b::DOUBLE AS q
FROM {centre} c JOIN (VALUES {values}) g(point, a, b, k) ON g.k <= c.k"""
    }
    return points | solve_sql(name, f"{name}_points") | {
        f"{name}_slopes": f"""
SELECT c.model_name, c.species, c.k, c.s, c.q, {at[0]} AS nll, ({at[1]} - {at[2]}) / 2e-4 AS gs, ({at[5]} - {at[6]}) / 2e-4 AS gq,
       ({at[3]} - 2 * {at[0]} + {at[4]}) / 1e-6 AS hss, ({at[7]} - 2 * {at[0]} + {at[8]}) / 1e-6 AS hqq,
       ({at[9]} - {at[10]} - {at[11]} + {at[12]}) / 4e-6 AS hsq
FROM {name}_nll n JOIN {centre} c USING (model_name, species) GROUP BY ALL""",
    }

#: Named queries from ``inputs`` (the model input) and ``line_index`` to ``fitted``: a row per model and species with
#: its parameters s and q, their number k, the likelihood, its slopes and the covariances of the parameters.
FIT_SQL = {
    "obs": OBS_SQL,
    "kinds": "SELECT model_name, species, CASE WHEN max(v) > 0 THEN 2 ELSE 1 END AS k, -5.0::DOUBLE AS s FROM obs GROUP BY 1, 2",
    "coarse_points": _grid_sql("kinds", 141, 0.05),
    **solve_sql("coarse", "coarse_points"),
    **_profile_sql("coarse"),
    "coarse_best": """
SELECT model_name, species, any_value(k.k) AS k, arg_min(p.s, p.nll) - 0.06 AS s
FROM coarse_profile p JOIN kinds k USING (model_name, species) GROUP BY 1, 2""",
    "fine_points": _grid_sql("coarse_best", 121, 0.001),
    **solve_sql("fine", "fine_points"),
    **_profile_sql("fine"),
    "fine_best": "SELECT model_name, species, arg_min(i, nll) AS i FROM fine_profile GROUP BY 1, 2",
    "fine_around": """
SELECT model_name, species, max(CASE WHEN p.i = b.i THEN p.s END) AS s, max(CASE WHEN p.i = b.i THEN p.q END) AS q,
       max(CASE WHEN p.i = b.i - 1 THEN p.nll END) AS below, max(CASE WHEN p.i = b.i THEN p.nll END) AS mid,
       max(CASE WHEN p.i = b.i + 1 THEN p.nll END) AS above
FROM fine_best b JOIN fine_profile p USING (model_name, species) GROUP BY 1, 2""",
    "nearly": """
SELECT model_name, species, k.k, f.s + 0.0005 * (below - above) / (below - 2 * mid + above) AS s, f.q
FROM fine_around f JOIN kinds k USING (model_name, species)""",
    **_stencil_sql("near", "nearly"),
    "least": """
SELECT model_name, species, k,
       s - CASE WHEN k = 1 THEN gs / hss ELSE (hqq * gs - hsq * gq) / (hss * hqq - hsq * hsq) END AS s,
       q - CASE WHEN k = 1 THEN 0 ELSE (hss * gq - hsq * gs) / (hss * hqq - hsq * hsq) END AS q
FROM near_slopes""",
    **_stencil_sql("last", "least"),
    "fitted": """
SELECT *, CASE WHEN k = 1 THEN hss ELSE hss * hqq - hsq * hsq END AS det,
       CASE WHEN k = 1 THEN 1 / hss ELSE hqq / (hss * hqq - hsq * hsq) END AS css,
       CASE WHEN k = 1 THEN 0 ELSE hss / (hss * hqq - hsq * hsq) END AS cqq,
       CASE WHEN k = 1 THEN 0 ELSE -hsq / (hss * hqq - hsq * hsq) END AS csq
FROM last_slopes""",
}

#: From ``fitted`` on: states with the variances that the uncertainty of the parameters adds.
STATES_SQL = {
    "state_rows": """
SELECT model_name, species, region, t, max(CASE WHEN point = 0 THEN x END) AS x, max(CASE WHEN point = 0 THEN var END) AS var,
       (max(CASE WHEN point = 1 THEN x END) - max(CASE WHEN point = 2 THEN x END)) / 2e-4 AS xs,
       coalesce((max(CASE WHEN point = 5 THEN x END) - max(CASE WHEN point = 6 THEN x END)) / 2e-4, 0) AS xq
FROM last_states GROUP BY ALL""",
    "states": """
SELECT r.model_name, r.species, r.region, CAST(r.t - 1 + (SELECT min(year) FROM inputs) AS INTEGER) AS year, r.x AS biomsd, exp(r.x) AS re_est,
       sqrt(r.var + xs * xs * css + 2 * xs * xq * csq + xq * xq * cqq) AS biomsd_sd
FROM state_rows r JOIN fitted f USING (model_name, species)""",
}
