"""Least squares, orbit and mass fits, resampling on synthetic truth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearpass.functions.dynamics import Perturber
from nearpass.functions.kepler import positions
from nearpass.operators import fits, timeseries

TRUE = np.array([2.6, 0.12, 7.0, 80.0, 45.0, 130.0])
EPOCH = 2457000.5


def observer(t):
    lon = 2 * np.pi * (t - 2457102.0) / 365.25
    return np.stack([np.cos(lon), np.sin(lon) * 0.9175, np.sin(lon) * 0.3978], 1) * 1.01


def observed(t, noise, seed=0, elements=TRUE, **kw):
    obs = fits.predict(elements, EPOCH, t, observer(t), **kw)
    rng = np.random.default_rng(seed)
    obs[:, 0] += rng.normal(0, noise, len(t)) / 3.6e6 / np.cos(np.radians(obs[:, 1]))
    obs[:, 1] += rng.normal(0, noise, len(t)) / 3.6e6
    return obs


def test_levenberg_marquardt_recovers_a_line_and_its_errors():
    x = np.linspace(0, 1, 200)
    y = 2 + 3 * x + np.random.default_rng(0).normal(0, 0.1, 200)
    fit = fits.levenberg_marquardt(lambda p: (p[0] + p[1] * x - y) / 0.1, np.array([0.0, 0.0]))
    want = np.linalg.lstsq(np.stack([np.ones(200), x], 1), y, rcond=None)[0]
    assert fit.converged and np.allclose(fit.x, want, atol=1e-6)
    assert fit.chi2 / fit.dof == pytest.approx(1.0, abs=0.25) and 0.01 < fit.sigma[0] < 0.02


def test_orbit_fit_drops_outliers_and_covers_the_truth():
    t = np.sort(np.random.default_rng(1).uniform(EPOCH, EPOCH + 900, 60))
    obs = observed(t, 2.0)
    obs[7, 1] += 3000 / 3.6e6
    fit, keep = fits.fit_orbit(TRUE * (1 + 1e-6), EPOCH, t, obs, observer(t), np.full(60, 2.0))
    assert not keep[7] and keep.sum() >= 57
    assert np.all(np.abs(fit.x - TRUE) < 6 * fit.sigma + 1e-12)
    with pytest.raises(ValueError, match="8 are needed"):
        fits.fit_orbit(TRUE, EPOCH, t[:3], obs[:3], observer(t[:3]), np.full(3, 2.0))


def test_mass_of_a_perturber_is_found():
    names = ("a_au", "ecc", "i_deg", "node_deg", "argperi_deg", "mean_anomaly_deg", "epoch_jd")
    other = dict(zip(names, [2.6005, 0.12, 7.01, 80.0, 45.0, 130.25, EPOCH], strict=True))
    t = np.linspace(EPOCH, EPOCH + 300, 40)
    gm = 4e-13
    gap = np.linalg.norm(positions(*TRUE, EPOCH, t) - positions(*[other[n] for n in names], t), axis=1)
    assert gap.min() < 0.02
    obs = observed(t, 0.05, perturber=Perturber(gm, other), step=5.0)
    target = {"elements": TRUE, "epoch": EPOCH, "t": t, "radec": obs, "observer": observer(t), "sigma": np.full(40, 0.05)}
    fit = fits.fit_mass([target], other, gm0=1e-13, step=5.0)
    assert abs(fit.x[0] - gm) < 5 * fit.sigma[0] and fit.sigma[0] < gm / 3


def test_whitening_equals_the_full_covariance():
    rng = np.random.default_rng(2)
    r, s, g = rng.normal(size=9), rng.uniform(0.5, 2, 9), np.array([0, 0, 0, 1, 1, 2, 2, 2, 2])
    w = fits.whitened(r, s, g, 0.7)
    cov = np.diag(s**2) + 0.49 * (g[:, None] == g[None])
    assert w @ w == pytest.approx(r @ np.linalg.solve(cov, r))


def test_floor_profile_and_status():
    rng = np.random.default_rng(3)
    r = rng.normal(0, 3, 4000)
    assert fits.systematic_floor(r, np.ones(4000), 4000) == pytest.approx(math.sqrt(8), rel=0.05)
    assert fits.systematic_floor(r, np.full(4000, 9.0), 4000) == 0.0
    out = fits.profile_interval(lambda m: (m - 2) ** 2 / 0.25, np.linspace(-1, 5, 601))
    assert (out["best"], out["low"], out["high"]) == pytest.approx((2.0, 1.5, 2.5), abs=0.011) and out["p_zero"] < 1e-4 and out["bounded"]
    assert fits.boundary_p_value(-1.0) == 1.0 and fits.chi2_sf_1(3.841459) == pytest.approx(0.05, abs=1e-6)
    status = [fits.mass_status(*a) for a in ((0.1, -1.0, 0.0), (None, 1.0, 0.0), (0.1, 1.0, 0.001), (0.1, 1.0, 0.5), (0.1, 1.0, 0.001, True), (0.1, 1.0, None))]
    assert status == ["non_physical", "unknown", "measured", "not_identifiable", "not_identifiable", "unknown"]


def test_group_fits_report_errors_as_rows(spark):
    t = np.linspace(EPOCH, EPOCH + 600, 30)
    obs, o = observed(t, 2.0), observer(t)
    rows = [(1, float(t[k]), *map(float, obs[k]), *map(float, o[k])) for k in range(30)] + [(2, float(t[0]), 1.0, 1.0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "number int, jd double, ra double, dec double, x_gaia double, y_gaia double, z_gaia double")
    seeds = spark.createDataFrame([(n, *map(float, TRUE), EPOCH) for n in (1, 2)], "number int, " + ", ".join(f"{c} double" for c in fits.ORBIT) + ", epoch_jd double")
    got = {r.number: r for r in fits.orbit_fits(df, seeds, "number", 2.0).collect()}
    assert got[1].error is None and got[1].a_au == pytest.approx(2.6, abs=1e-5) and got[1].chi2_red < 2
    assert "needed" in got[2].error and got[2].a_au is None


def test_a_large_body_is_fitted_from_all_its_observations(spark):
    t = np.linspace(EPOCH, EPOCH + 600, 400)
    obs, o = observed(t, 2.0), observer(t)
    obs[[7, 200], 1] += 3000 / 3.6e6
    rows = [(n, float(t[k]), *map(float, obs[k]), *map(float, o[k])) for n in (1, 2) for k in range(400 if n == 1 else 40)]
    df = spark.createDataFrame(rows, "number int, jd double, ra double, dec double, x_gaia double, y_gaia double, z_gaia double")
    seeds = spark.createDataFrame([(n, *map(float, TRUE * (1 + 1e-6)), EPOCH) for n in (1, 2)], "number int, " + ", ".join(f"{c} double" for c in fits.ORBIT) + ", epoch_jd double")
    got = {r.number: r for r in fits.orbit_fits(df, seeds, "number", 2.0, 50).collect()}
    fit, keep = fits.fit_orbit(TRUE * (1 + 1e-6), EPOCH, t, obs, o, np.full(400, 2.0))
    assert got[1].error is None and got[2].error is None and got[2].kept <= 40
    assert got[1].kept == keep.sum() >= 390 and not keep[[7, 200]].any()
    for c, x, sigma in zip(fits.ORBIT, fit.x, fit.sigma, strict=True):
        assert abs(got[1][c] - x) < 1e-3 * sigma and got[1][f"sigma_{c}"] == pytest.approx(sigma, rel=1e-3)
    assert got[1].chi2_red == pytest.approx(fit.chi2 / fit.dof, rel=1e-6)


def test_nbody_refine_and_its_errors(spark):
    names = [f"{c}_{s}" for s in "ij" for c in fits.ORBIT]
    a, b = TRUE.copy(), TRUE + np.array([0.001, 0, 0.02, 0, 0, 0.05])
    rows = [(1, 2, EPOCH + 50, *map(float, a), *map(float, b), EPOCH, EPOCH), (3, 4, EPOCH, *map(float, a), *map(float, b), EPOCH, EPOCH + 1)]
    df = spark.createDataFrame(rows, "idx_i bigint, idx_j bigint, jd_tdb double, " + ", ".join(f"{n} double" for n in names) + ", epoch_jd_i double, epoch_jd_j double")
    plain = {r.idx_i: r for r in fits.nbody_refine(df, ["idx_i", "idx_j"], planets=()).collect()}
    t = EPOCH + 50 + np.linspace(-1, 1, 97)
    d = np.linalg.norm(positions(*a, EPOCH, t) - positions(*b, EPOCH, t), axis=1)
    assert plain[1].dist_au_nbody == pytest.approx(d.min(), abs=1e-8) and plain[1].nbody_converged and plain[1].nbody_energy_drift < 1e-7
    assert "different epochs" in plain[3].error_message and plain[3].dist_au_nbody is None


def test_bootstrap_and_jackknife_agree_with_theory(spark):
    v = np.random.default_rng(4).normal(5, 2, 400)
    df = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate(v)] + [("none", 900, None)], "k string, i long, v double")
    boot = fits.bootstrap_means(df, "k", "i", "v", 200).collect()
    sem = v.std(ddof=1) / 20
    assert len(boot) == 1 and boot[0].sigma == pytest.approx(sem, rel=0.2) and boot[0].low < v.mean() < boot[0].high
    jack = timeseries.jackknife(df, "k", F.col("v")).collect()
    assert jack[0].jackknife_sigma == pytest.approx(sem) and jack[0].top_share == pytest.approx(((v - v.mean()) ** 2).max() / ((v - v.mean()) ** 2).sum())


def test_monte_carlo_distance(spark):
    names = [f"{p}{c}_{s}" for s in "ij" for p in ("", "sigma_") for c in fits.ORBIT]
    values = {f"{c}_{s}": float(x) for s, e in (("i", TRUE), ("j", TRUE + [0, 0, 0, 0, 0, 0.1])) for c, x in zip(fits.ORBIT, e, strict=True)}
    sure = {n: values.get(n, 1e-9) for n in names}
    lost = {n: values.get(n) for n in names}
    rows = [(k, k + 1, EPOCH, EPOCH, EPOCH, *[d[n] for n in names]) for k, d in ((1, sure), (3, lost))]
    df = spark.createDataFrame(rows, "idx_i bigint, idx_j bigint, jd_tdb double, epoch_jd_i double, epoch_jd_j double, " + ", ".join(f"{n} double" for n in names))
    got = {r.idx_i: r for r in fits.monte_carlo_distance(df, 200).collect()}
    d = np.linalg.norm(positions(*TRUE, EPOCH, EPOCH) - positions(*(TRUE + [0, 0, 0, 0, 0, 0.1]), EPOCH, EPOCH))
    assert got[1].median_au == pytest.approx(d, rel=1e-4) and got[1].p16_au < got[1].median_au < got[1].p84_au
    assert got[3].median_au is None and got[3].note == "no covariance"


def test_total_sigma_adds_the_calibrators_share(spark):
    masses = spark.createDataFrame([(1, 10.0, 3.0)], "number int, mass double, sigma double")
    calibrators = spark.createDataFrame([(4, 0.3), (5, -0.5)], "number int, relative_error double")
    got = fits.with_total_sigma(masses, "mass", "sigma", calibrators).first().sigma_total
    assert got == pytest.approx(math.sqrt(9 + (math.sqrt(0.17) * 10) ** 2))
    assert fits.with_total_sigma(masses, "mass", "sigma", calibrators.limit(0)).first().sigma_total == 3.0
    status = masses.select(fits.mass_status_column(F.col("mass"), F.col("sigma")).alias("s")).first().s
    assert status == "measured"


def test_light_time_and_aberration():
    t = np.linspace(EPOCH, EPOCH + 300, 20)
    o = observer(t)
    place = lambda when: positions(*TRUE, EPOCH, when)
    eps = np.radians(23.4392911)
    eye = np.stack([o[:, 0], np.cos(eps) * o[:, 1] + np.sin(eps) * o[:, 2], -np.sin(eps) * o[:, 1] + np.cos(eps) * o[:, 2]], 1)
    seen = fits.retarded(place, t, o)
    delay = np.linalg.norm(seen - eye, axis=1) / fits.LIGHT_AU_DAY
    assert np.abs(seen - place(t - delay)).max() < 1e-12
    shift = fits.sky_residual_mas(fits.predict(TRUE, EPOCH, t, o, light_time=True), fits.predict(TRUE, EPOCH, t, o))
    assert 1000 < np.linalg.norm(shift, axis=1).max() < 60_000
    turned = fits.aberrated(np.array([[0.0, 0.0, 2.0]]), np.array([[0.0172, 0.0, 0.0]]))
    assert np.degrees(np.arcsin(turned[0, 0])) * 3600 == pytest.approx(20.5, abs=0.1)


def test_monte_carlo_with_full_covariances(spark):
    """Fully correlated a and M leave another spread than independent ones."""
    sigma = np.array([1e-5, 1e-6, 1e-5, 1e-5, 1e-5, 1e-3])
    same = np.outer(sigma, sigma) * (np.eye(6) + 0.999 * (np.eye(6)[::-1] * ((np.arange(6)[:, None] % 5) == 0)))
    names = [f"{c}_{s}" for s in "ij" for c in fits.ORBIT]
    values = [*map(float, TRUE), *map(float, TRUE + [0, 0, 0, 0, 0, 0.1])]
    rows = [(k, k + 1, EPOCH + 400, EPOCH, EPOCH, *values, c, c) for k, c in ((1, np.diag(sigma**2).ravel().tolist()), (3, same.ravel().tolist()), (5, [float("nan")] * 36), (7, (-np.eye(6)).ravel().tolist()))]
    schema = "idx_i bigint, idx_j bigint, jd_tdb double, epoch_jd_i double, epoch_jd_j double, " + ", ".join(f"{n} double" for n in names) + ", covariance_i array<double>, covariance_j array<double>"
    got = {r.idx_i: r for r in fits.monte_carlo_distance(spark.createDataFrame(rows, schema), 400).collect()}
    assert got[1].sigma_au > 0 and got[3].sigma_au > 0 and abs(got[3].sigma_au / got[1].sigma_au - 1) > 0.1
    assert got[5].note == "no covariance" and got[7].note == "covariance is not positive"


def test_bootstrap_query_draws_the_reference_s_replicates(spark, sf):
    from nearpass.plans import series

    want = fits.bootstrap_means(series.readings(spark, sf, "g_mag"), "source_id", "observation_id", "g_mag", 200)
    rows = lambda df: sorted((r.source_id, *(None if v is None else round(v, 9) for v in (r.sigma, r.low, r.high))) for r in df.collect())
    assert rows(series.bootstrap_sigma(spark, sf)) == rows(want)


def test_variations_agree_with_differences():
    from nearpass.functions.dynamics import Perturber, acceleration, integrate, variations
    from nearpass.functions.kepler import elements_to_state

    start, end = 2457000.5, 2457080.5
    state = np.stack([elements_to_state(2.4 + 0.3 * k, 0.1 + 0.05 * k, 5.0, 40.0, 70.0, 10.0 * k, start, start) for k in range(3)])
    heavy = {"a_au": 2.45, "ecc": 0.1, "i_deg": 5.5, "node_deg": 40.0, "argperi_deg": 70.0, "mean_anomaly_deg": 2.0, "epoch_jd": start}
    body = Perturber(1e-10, heavy)
    moved, by_state, by_gm = variations(state, start, end, 0.25, ("jupiter",), body)
    path = lambda s, gm=1e-10: integrate(s, start, np.array([end]), acceleration(("jupiter",), (Perturber(gm, heavy),)), 0.25)[0]
    assert np.abs(moved - path(state)).max() < 1e-9
    for c in range(6):
        d = np.zeros(6)
        d[c] = 1e-6
        want = (path(state + d) - path(state - d)) / 2e-6
        assert np.abs(by_state[:, :, c] - want).max() < 1e-5 * np.abs(by_state).max()
    want = (path(state, 2e-10) - path(state, 0.0)) / 2e-10
    assert np.abs(by_gm - want).max() < 1e-4 * np.abs(by_gm).max()
    assert np.abs(np.linalg.det(by_state) - 1).max() < 1e-8


def test_integration_over_a_grid_checks_its_input(spark):
    row = (1, 2.4, 0.1, 5.0, 40.0, 70.0, 10.0, 2457000.5)
    schema = "number int, a_au double, ecc double, i_deg double, node_deg double, argperi_deg double, mean_anomaly_deg double, epoch_jd double"
    one = spark.createDataFrame([row, (2, *row[1:])], schema)
    out = fits.nbody_propagate(one, "number", [2456990.5, 2457000.5, 2457010.5]).toPandas()
    assert len(out) == 6 and np.isfinite(out[["x", "y", "z"]].to_numpy()).all()
    with pytest.raises(ValueError, match="rise"):
        fits.nbody_propagate(one, "number", [2.0, 1.0])
    with pytest.raises(ValueError, match="epochs"):
        fits.nbody_propagate(one.unionByName(spark.createDataFrame([(*row[:7], 2457001.5)], schema)), "number", [2457010.5])
