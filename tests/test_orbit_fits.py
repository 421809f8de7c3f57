"""Orbit fits of many bodies side by side against fits one by one."""

import numpy as np
import pytest

from nearpass.operators import fits


def test_fits_side_by_side_equal_fits_one_by_one(spark):
    """Bodies with 3 to 40 observations, outliers, a bad seed and a body without finite numbers."""
    rng = np.random.default_rng(5)
    epoch, n = 2457000.5, 40
    true = rng.uniform([2.1, 0.02, 1, 0, 0, 0], [3.4, 0.3, 20, 360, 360, 360], (n, 6))
    seed = true + rng.normal(0, 1, true.shape) * [1e-5, 1e-6, 1e-4, 0, 0, 1e-4]
    seed[4] += [0.02, 0.01, 0.5, 0.5, 0.5, 0.5]
    rows, single = [], {}
    for k in range(n):
        t = np.sort(rng.uniform(epoch, epoch + 700, 3 if k == 2 else 12 + k % 29))
        eye = np.stack([np.cos(t / 58.13), np.sin(t / 58.13) * 0.917, np.sin(t / 58.13) * 0.398], 1)
        obs = fits.predict(true[k], epoch, t, eye) + rng.normal(0, 2.0 / 3.6e6, (len(t), 2))
        if k % 5 == 0:
            obs[3, 1] += 4000 / 3.6e6
        if k == 3:
            obs[1, 0] = np.nan
        rows += [(k, float(a), *map(float, b), *map(float, c)) for a, b, c in zip(t, obs, eye, strict=True)]
        if k not in (2, 3):
            single[k] = fits.fit_orbit(seed[k], epoch, t, obs, eye, np.full(len(t), 2.0))
    df = spark.createDataFrame(rows, "number int, jd double, ra double, dec double, x_gaia double, y_gaia double, z_gaia double")
    seeds = spark.createDataFrame([(k, *map(float, seed[k]), epoch) for k in range(n)], "number int, " + ", ".join(f"{c} double" for c in fits.ORBIT) + ", epoch_jd double")
    plan = fits.orbit_fits(df, seeds, "number", 2.0)
    assert "MapInPandas" in plan._jdf.queryExecution().executedPlan().toString()  # many bodies a call
    got = {r.number: r for r in plan.collect()}
    assert set(got) == set(range(n)) and "8 are needed" in got[2].error and got[2].kept == 0 and got[2].a_au is None
    assert "converge" in got[3].error and got[3].a_au is None
    for k, (fit, keep) in single.items():
        assert got[k].error is None and got[k].kept == keep.sum() and got[k].chi2_red == pytest.approx(fit.chi2 / fit.dof, rel=1e-5)
        for c, x, sigma in zip(fits.ORBIT, fit.x, fit.sigma, strict=True):
            assert abs(got[k][c] - x) < 1e-2 * sigma and got[k][f"sigma_{c}"] == pytest.approx(sigma, rel=1e-3)
