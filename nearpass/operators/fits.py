"""Least-squares fits per group: orbits, perturber masses, identifiability, resampling."""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from math import erfc, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearpass.functions.dynamics import GIANTS, PLANETS, Perturber, acceleration, advance, energy, giants_pull, integrate, variations
from nearpass.functions.kepler import elements_to_state, positions, state_to_elements
from nearpass.session import shuffle_partitions, stage

ORBIT = ["a_au", "ecc", "i_deg", "node_deg", "argperi_deg", "mean_anomaly_deg"]
_EPS = np.radians(23.4392911)
#: Steps of the numeric derivatives by the six elements.
_SCALE = np.array([1e-7, 1e-7, 1e-5, 1e-5, 1e-5, 1e-5])


@dataclass
class Fit:
    x: np.ndarray
    covariance: np.ndarray
    chi2: float
    dof: int
    steps: int
    converged: bool

    @property
    def sigma(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.covariance), 0, None))


def levenberg_marquardt(residual: Callable[[np.ndarray], np.ndarray], x0: np.ndarray, jacobian: Callable[[np.ndarray], np.ndarray] | None = None, scale: np.ndarray | None = None, steps: int = 50, tol: float = 1e-10) -> Fit:
    """Minimise the sum of squared (whitened) residuals; covariance is the inverse of J'J."""
    x = np.array(x0, float)
    scale = np.maximum(np.abs(x), 1.0) * 1e-6 if scale is None else scale

    def numeric(at: np.ndarray) -> np.ndarray:
        cols = []
        for k in range(len(at)):
            d = np.zeros(len(at))
            d[k] = scale[k]
            cols.append((residual(at + d) - residual(at - d)) / (2 * scale[k]))
        return np.stack(cols, 1)

    jac = jacobian or numeric
    r = residual(x)
    chi2, damp, done, k = float(r @ r), 1e-3, False, 0
    for k in range(1, steps + 1):
        j = jac(x)
        h, g = j.T @ j, j.T @ r
        for _ in range(12):
            move = -np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-30), g, rcond=None)[0]
            trial = residual(x + move)
            if np.isfinite(trial).all() and trial @ trial <= chi2:
                break
            damp *= 4
        else:
            done = True
            break
        gain = chi2 - float(trial @ trial)
        x, r, chi2, damp = x + move, trial, float(trial @ trial), max(damp / 6, 1e-12)
        if gain <= tol * max(chi2, 1e-300) or np.all(np.abs(move) <= tol * (np.abs(x) + tol)):
            done = True
            break
    j = jac(x)
    return Fit(x, np.linalg.pinv(j.T @ j), chi2, max(1, len(r) - len(x)), k, done)


def sky(xyz: np.ndarray, observer: np.ndarray) -> np.ndarray:
    """``(n, 2)`` RA and Dec in degrees of ecliptic heliocentric positions from equatorial observer positions."""
    eq = np.stack([xyz[:, 0], np.cos(_EPS) * xyz[:, 1] - np.sin(_EPS) * xyz[:, 2], np.sin(_EPS) * xyz[:, 1] + np.cos(_EPS) * xyz[:, 2]], 1) - observer
    ra = np.degrees(np.arctan2(eq[:, 1], eq[:, 0])) % 360
    return np.stack([ra, np.degrees(np.arcsin(eq[:, 2] / np.linalg.norm(eq, axis=1)))], 1)


def sky_residual_mas(observed: np.ndarray, model: np.ndarray) -> np.ndarray:
    turn = (observed[:, 0] - model[:, 0] + 540) % 360 - 180
    return np.stack([turn * np.cos(np.radians(model[:, 1])) * 3.6e6, (observed[:, 1] - model[:, 1]) * 3.6e6], 1)


def whitened(residual: np.ndarray, sigma: np.ndarray, group: np.ndarray, common: float) -> np.ndarray:
    """Residuals whitened by ``diag(sigma^2) + common^2 11'`` within each group, in closed form."""
    out = residual / sigma
    if not common:
        return out
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        u = common / sigma[at]
        n = float(u @ u)
        out[at] -= u * ((u @ out[at]) / n) * (1 - 1 / sqrt(1 + n))
    return out


#: Fixed value: speed of light, AU per day.
LIGHT_AU_DAY = 173.144632674


def retarded(place: Callable[[np.ndarray], np.ndarray], t: np.ndarray, observer: np.ndarray, steps: int = 4) -> np.ndarray:
    """Ecliptic positions at the time the light left; each step shrinks the error by v/c."""
    left = np.array(t, float)
    eye = np.stack([observer[:, 0], np.cos(_EPS) * observer[:, 1] + np.sin(_EPS) * observer[:, 2], -np.sin(_EPS) * observer[:, 1] + np.cos(_EPS) * observer[:, 2]], 1)
    for _ in range(steps):
        left = t - np.linalg.norm(place(left) - eye, axis=1) / LIGHT_AU_DAY
    return place(left)


def aberrated(direction: np.ndarray, velocity: np.ndarray) -> np.ndarray:
    """Unit directions as seen by an observer moving at ``velocity`` (AU/day), to first order in v/c."""
    u = direction / np.linalg.norm(direction, axis=-1, keepdims=True) + velocity / LIGHT_AU_DAY
    return u / np.linalg.norm(u, axis=-1, keepdims=True)


def predict(elements: np.ndarray, epoch: float, t: np.ndarray, observer: np.ndarray, perturber: Perturber | None = None, planets: tuple[str, ...] = (), step: float = 2.0, light_time: bool = False) -> np.ndarray:
    """RA, Dec at the observation times: two-body in closed form (with light time on demand), or integrated with perturbers."""
    if perturber is None and not planets:
        if light_time:
            return sky(retarded(lambda when: positions(*elements[:6], epoch, when), t, observer), observer)
        return sky(positions(*elements[:6], epoch, t), observer)
    state = elements_to_state(*elements[:6], epoch, epoch)[None]
    order, back = np.unique(t, return_inverse=True)
    path = integrate(state, epoch, order, acceleration(planets, (perturber,) if perturber else ()), step)[:, 0, :3]
    return sky(path[back], observer)


def fit_orbit(seed: np.ndarray, epoch: float, t: np.ndarray, radec: np.ndarray, observer: np.ndarray, sigma_mas: np.ndarray, clip: float | None = 5.0, least: int = 8, planets: tuple[str, ...] = ()) -> tuple[Fit, np.ndarray]:
    """Six elements from sky positions, refitted without outliers; the kept observations."""
    keep = np.ones(len(t), bool)
    if len(t) < least:
        raise ValueError(f"{len(t)} observations; {least} are needed")
    fit = None
    x = np.array(seed, float)
    for _ in range(5):
        def residual(p: np.ndarray, keep: np.ndarray = keep) -> np.ndarray:
            return (sky_residual_mas(radec[keep], predict(p, epoch, t[keep], observer[keep], planets=planets)) / sigma_mas[keep, None]).ravel()

        fit = levenberg_marquardt(residual, x, scale=np.array([1e-7, 1e-7, 1e-5, 1e-5, 1e-5, 1e-5]))
        x = fit.x
        if clip is None:
            break
        pull = np.abs(sky_residual_mas(radec, predict(x, epoch, t, observer, planets=planets)) / sigma_mas[:, None]).max(1)
        now = pull <= clip * max(1.0, sqrt(fit.chi2 / fit.dof))
        if now.sum() < least or (now == keep).all():
            break
        keep = now
    return fit, keep


#: Observations, padded, that are fitted at a time.
FIT_OBS = 60_000
_FAILED = "SVD did not converge in Linear Least Squares"


def _minimise(residual: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, steps: int = 50, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``levenberg_marquardt`` of many bodies side by side, each with its own damping and end: x, covariance, chi-square, solved.

    ``residual`` takes elements and the bodies they are of; a body that isn't solved has met no finite numbers.
    """
    n = len(x)
    x, damp, good = x.copy(), np.full(n, 1e-3), np.ones(n, bool)
    r = residual(x, np.arange(n))
    chi2 = (r * r).sum(1)

    def jacobian(who: np.ndarray) -> np.ndarray:
        return np.stack([(residual(x[who] + d, who) - residual(x[who] - d, who)) / (2 * d.sum()) for d in np.diag(_SCALE)], 2)

    left = np.arange(n)
    for _ in range(steps):
        j = jacobian(left)
        h, g = j.swapaxes(1, 2) @ j, (j * r[left][:, :, None]).sum(1)
        fine = np.isfinite(h).all((1, 2)) & np.isfinite(g).all(1)
        good[left[~fine]] = False
        left, h, g = left[fine], h[fine], g[fine]
        diagonal = np.einsum("bii->bi", h) + 1e-30
        tries, ended = np.arange(len(left)), np.ones(len(left), bool)
        for _ in range(12):
            who = left[tries]
            normal = h[tries]
            np.einsum("bii->bi", normal)[:] += damp[who, None] * diagonal[tries]
            move = -(np.linalg.pinv(normal, 6 * np.finfo(float).eps, hermitian=True) @ g[tries][:, :, None])[:, :, 0]
            trial = residual(x[who] + move, who)
            now = (trial * trial).sum(1)
            better = np.isfinite(trial).all(1) & (now <= chi2[who])
            took, move, now = who[better], move[better], now[better]
            gain = chi2[took] - now
            x[took] += move
            r[took], chi2[took], damp[took] = trial[better], now, np.maximum(damp[took] / 6, 1e-12)
            ended[tries[better]] = (gain <= tol * np.maximum(now, 1e-300)) | (np.abs(move) <= tol * (np.abs(x[took]) + tol)).all(1)
            tries = tries[~better]
            damp[left[tries]] *= 4
            if not len(tries):
                break
        left = left[~ended]
        if not len(left):
            break
    j = jacobian(np.arange(n))
    h = j.swapaxes(1, 2) @ j
    good &= np.isfinite(h).all((1, 2))
    return x, np.linalg.pinv(np.where(good[:, None, None], h, 0.0)), chi2, good


def fit_orbits_together(seed: np.ndarray, epoch: np.ndarray, t: np.ndarray, radec: np.ndarray, observer: np.ndarray, seen: np.ndarray, sigma_mas: float, clip: float = 5.0, least: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``fit_orbit`` of many bodies with a row of observations each, padded where not ``seen``: elements, sigmas, reduced chi-square, kept, solved."""
    n, most = t.shape

    def offsets(p: np.ndarray, who: np.ndarray) -> np.ndarray:
        places = positions(*(p[:, k, None] for k in range(6)), epoch[who, None], t[who]).reshape(-1, 3)
        return (sky_residual_mas(radec[who].reshape(-1, 2), sky(places, observer[who].reshape(-1, 3))) / sigma_mas).reshape(len(who), most, 2)

    x, keep = np.array(seed, float), seen.copy()
    sigma, chi2_red, good = np.full((n, 6), np.nan), np.full(n, np.nan), np.ones(n, bool)
    left = np.arange(n)
    with np.errstate(all="ignore"):
        for _ in range(5):
            mine = lambda p, k: np.where(keep[left[k], :, None], offsets(p, left[k]), 0.0).reshape(len(k), -1)
            x[left], covariance, chi2, fine = _minimise(mine, x[left])
            good[left] = fine
            sigma[left] = np.sqrt(np.clip(np.einsum("bii->bi", covariance), 0, None))
            chi2_red[left] = chi2 / np.maximum(1, 2 * keep[left].sum(1) - 6)
            left = left[fine]
            now = seen[left] & (np.abs(offsets(x[left], left)).max(2) <= clip * np.maximum(1.0, np.sqrt(chi2_red[left]))[:, None])
            again = (now.sum(1) >= least) & (now != keep[left]).any(1)
            left = left[again]
            keep[left] = now[again]
            if not len(left):
                break
    return x, sigma, chi2_red, keep.sum(1), good


def fit_mass(targets: list[dict], perturber: dict[str, float], gm0: float = 1e-14, planets: tuple[str, ...] = (), step: float = 2.0) -> Fit:
    """One perturber mass shared by all targets, each with its own six elements (1 + 6N unknowns).

    A target: ``elements, epoch, t, radec, observer, sigma``. The Jacobian is an arrow: each
    target touches its own block and the mass column.
    """
    unit = gm0

    def blocks(x: np.ndarray) -> list[np.ndarray]:
        body = Perturber(float(x[0]) * unit, perturber)
        return [(sky_residual_mas(d["radec"], predict(x[1 + 6 * k : 7 + 6 * k], d["epoch"], d["t"], d["observer"], body, planets, step)) / d["sigma"][:, None]).ravel() for k, d in enumerate(targets)]

    x0 = np.concatenate([[1.0], *[np.asarray(d["elements"], float)[:6] for d in targets]])
    scale = np.concatenate([[0.2], np.tile([1e-7, 1e-7, 1e-5, 1e-5, 1e-5, 1e-5], len(targets))])
    rows = np.cumsum([0, *[2 * len(d["t"]) for d in targets]])

    def jacobian(x: np.ndarray) -> np.ndarray:
        out = np.zeros((rows[-1], len(x)))
        for c in range(7):  # the same element of all targets is moved at once
            move = np.zeros(len(x))
            move[0 if c == 0 else np.arange(len(targets)) * 6 + c] = 1.0
            up, down = blocks(x + move * scale), blocks(x - move * scale)
            for k in range(len(targets)):
                col = 0 if c == 0 else 6 * k + c
                out[rows[k] : rows[k + 1], col] = (up[k] - down[k]) / (2 * scale[col])
        return out

    fit = levenberg_marquardt(lambda x: np.concatenate(blocks(x)), x0, jacobian, scale, steps=20)
    fit.x[0] *= unit
    fit.covariance[0, :] *= unit
    fit.covariance[:, 0] *= unit
    return fit


def planted_mass_fits(perturbers: DataFrame, key: str, gm: float, targets: int = 2, epochs: int = 10, span: float = 160.0, sigma_mas: float = 0.05) -> DataFrame:
    """``key, planted, gm, sigma``: a mass put into each perturber, and what ``fit_mass`` makes of its targets' motion.

    The targets pass the perturber at made-up times and distances; their directions from the Earth, integrated with
    it and without noise, are what the fit sees. A perturber is one task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                epoch = float(row.epoch_jd)
                orbit = {c: float(getattr(row, c)) for c in [*ORBIT, "epoch_jd"]}
                t = np.linspace(epoch, epoch + span, epochs)
                a, e, i, node, peri, lon, rate, _ = PLANETS["earth"]
                place = elements_to_state(a, e, i, node, peri - node, lon + rate * (t - 2451545.0) / 36525.0 - peri, t, t)[:, :3]
                eye = np.stack([place[:, 0], np.cos(_EPS) * place[:, 1] - np.sin(_EPS) * place[:, 2], np.sin(_EPS) * place[:, 1] + np.cos(_EPS) * place[:, 2]], 1)
                seen = []
                for k in range(targets):
                    meet = epoch + span * (k + 1) / (targets + 2)
                    state = elements_to_state(*[orbit[c] for c in ORBIT], epoch, meet)
                    state = state + np.r_[0.0, 0.004 + 0.002 * k, 0.004, 6e-4, 0.0, 2e-4 * (k + 1)]
                    start = integrate(state[None], meet, np.array([epoch]), acceleration((), (Perturber(gm, orbit),)), 2.0)[0]
                    other = state_to_elements(start, epoch)
                    elements = np.array([float(other[c][0]) for c in ORBIT])
                    seen.append({"elements": elements, "epoch": epoch, "t": t, "radec": predict(elements, epoch, t, eye, Perturber(gm, orbit), (), 8.0), "observer": eye, "sigma": np.full(epochs, sigma_mas)})
                fit = fit_mass(seen, orbit, gm0=gm / 3, step=8.0)
                yield pd.DataFrame({key: [getattr(row, key)], "planted": [gm], "gm": [float(fit.x[0])], "sigma": [float(fit.sigma[0])]})

    spread = perturbers.select(key, *ORBIT, "epoch_jd").dropna().repartition(shuffle_partitions(perturbers.sparkSession), key)
    return spread.mapInPandas(run, f"{key} int, planted double, gm double, sigma double")


def systematic_floor(residual: np.ndarray, sigma: np.ndarray, dof: int) -> float:
    """Noise to add in quadrature so that reduced chi-square is one; 0 if it already is less."""
    chi2 = lambda s: float((residual**2 / (sigma**2 + s * s)).sum()) / dof
    if chi2(0.0) <= 1:
        return 0.0
    low, high = 0.0, float(np.abs(residual).max()) * 2 + 1e-12
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2(mid) > 1 else (low, mid)
    return (low + high) / 2


def noise_models(df: DataFrame, key: str, group: str, value: str, sigma: str, common: float) -> DataFrame:
    """``key, n, chi2_grouped, floor, chi2_floored``: two ways to allow for noise that formal errors leave out.

    ``chi2_grouped`` whitens by the errors and a ``common`` noise shared within each group; ``floor`` is the noise that
    brings the reduced chi-square to one. A key's rows are one task's; null values are left out.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        r, s = rows[value].to_numpy(float), rows[sigma].to_numpy(float)
        white = whitened(r, s, pd.factorize(rows[group])[0], common)
        dof = max(1, len(r) - 1)
        floor = systematic_floor(r, s, dof)
        return pd.DataFrame({key: [rows[key].iloc[0]], "n": [len(r)], "chi2_grouped": [float(white @ white)], "floor": [floor], "chi2_floored": [float((r**2 / (s**2 + floor**2)).sum()) / dof]})

    rows = df.select(key, group, value, sigma).dropna()
    kind = df.schema[key].dataType.simpleString()
    return rows.repartition(shuffle_partitions(df.sparkSession), key).groupBy(key).applyInPandas(run, f"{key} {kind}, n bigint, chi2_grouped double, floor double, chi2_floored double")


def chi2_sf_1(x: float) -> float:
    """Survival of chi-square with one degree of freedom."""
    return erfc(sqrt(max(x, 0.0) / 2))


def boundary_p_value(delta_chi2: float) -> float:
    """For a parameter that may not be negative: half the usual one."""
    return 1.0 if delta_chi2 <= 0 else 0.5 * chi2_sf_1(delta_chi2)


def profile_interval(chi2_at: Callable[[float], float], grid: np.ndarray, n_sigma: float = 1.0) -> dict[str, float | bool]:
    """Best value and interval of a profile likelihood, and whether zero can be told apart."""
    values = np.array([chi2_at(g) for g in grid])
    k = int(values.argmin())
    inside = grid[values <= values[k] + n_sigma**2]
    delta = float(np.interp(0.0, grid, values) - values[k]) if grid.min() <= 0 else float(values[0] - values[k])
    return {"best": float(grid[k]), "low": float(inside.min()), "high": float(inside.max()), "delta_chi2_zero": delta, "p_zero": boundary_p_value(delta), "bounded": bool(0 < k < len(grid) - 1)}


def mass_status(sigma_total: float | None, mass: float | None, p_zero: float | None, covers_zero: bool | None = None, limit: float = 0.05) -> str:
    """non_physical, unknown, measured or not_identifiable; a bootstrap interval overrides the p-value."""
    if mass is None or sigma_total is None:
        return "unknown"
    if mass <= 0:
        return "non_physical"
    if covers_zero is not None:
        return "not_identifiable" if covers_zero else "measured"
    return "unknown" if p_zero is None else "measured" if p_zero < limit else "not_identifiable"


def mass_status_column(mass: Column, sigma_total: Column, n_sigma: float = 3.0) -> Column:
    """Column form of ``mass_status`` for a significance in sigmas."""
    known = mass.isNotNull() & sigma_total.isNotNull()
    return F.when(~known, "unknown").when(mass <= 0, "non_physical").when(mass >= n_sigma * sigma_total, "measured").otherwise("not_identifiable")


def with_total_sigma(masses: DataFrame, mass: str, sigma: str, calibrators: DataFrame) -> DataFrame:
    """Adds ``sigma_total`` with the systematic share of calibrators' relative errors (``number, relative_error``)."""
    floor = calibrators.agg(F.sqrt(F.avg(F.pow("relative_error", 2)))).scalar()
    return masses.withColumn("sigma_total", F.sqrt(F.pow(sigma, 2) + F.pow(F.coalesce(floor, F.lit(0.0)) * F.col(mass), 2)))


#: An observation is kept if its pull at these elements is within the limit.
Rule = tuple[np.ndarray, float] | None
#: Elements to evaluate at, the rule in force and one to compare with it; asked for by a fit in steps.
Ask = tuple[np.ndarray, Rule, Rule]


def _pull(x: np.ndarray, epoch: float, t: np.ndarray, radec: np.ndarray, observer: np.ndarray, sigma_mas: float) -> np.ndarray:
    return np.abs(sky_residual_mas(radec, predict(x, epoch, t, observer)) / sigma_mas).max(1)


def _sums(ask: Ask, epoch: float, t: np.ndarray, radec: np.ndarray, observer: np.ndarray, sigma_mas: float) -> np.ndarray:
    """J'J, J'r, r'r, kept, kept by the rule to compare and changed by it, of some of a body's observations; they add up."""
    x, rule, other = ask
    judge = lambda r: np.ones(len(t), bool) if r is None else _pull(r[0], epoch, t, radec, observer, sigma_mas) <= r[1]
    keep = judge(rule)
    now = judge(other)
    residual = lambda p: (sky_residual_mas(radec[keep], predict(p, epoch, t[keep], observer[keep])) / sigma_mas).ravel()
    r = residual(x)
    j = np.stack([(residual(x + d) - residual(x - d)) / (2 * d.sum()) for d in np.diag(_SCALE)], 1)
    return np.concatenate([(j.T @ j).ravel(), j.T @ r, [r @ r, keep.sum(), now.sum(), (now != keep).sum()]])


def _fit_in_steps(seed: np.ndarray, clip: float = 5.0, least: int = 8, steps: int = 50, tol: float = 1e-10) -> Generator[Ask, np.ndarray, tuple[Fit, int]]:
    """``fit_orbit`` from sums alone: yields what is to be summed and is sent the sums of ``_sums``."""
    x, rule, fit, kept = np.array(seed, float), None, None, 0
    for _ in range(5):
        s = yield x, rule, None
        damp, done, k = 1e-3, False, 0
        for k in range(1, steps + 1):
            h, g, chi2 = s[:36].reshape(6, 6), s[36:42], s[42]
            for _ in range(12):
                move = -np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-30), g, rcond=None)[0]
                trial = yield x + move, rule, None
                if np.isfinite(trial[42]) and trial[42] <= chi2:
                    break
                damp *= 4
            else:
                done = True
                break
            x, s, damp = x + move, trial, max(damp / 6, 1e-12)
            if chi2 - s[42] <= tol * max(s[42], 1e-300) or np.all(np.abs(move) <= tol * (np.abs(x) + tol)):
                done = True
                break
        kept = int(s[43])
        fit = Fit(x, np.linalg.pinv(s[:36].reshape(6, 6)), float(s[42]), max(1, 2 * kept - 6), k, done)
        other = (x, clip * max(1.0, sqrt(fit.chi2 / fit.dof)))
        s = yield x, rule, other
        if s[44] < least or s[45] == 0:
            break
        rule, kept = other, int(s[44])
    return fit, kept


_OBSERVED = ["jd", "ra", "dec", "x_gaia", "y_gaia", "z_gaia"]


def _fit_spread(rows: DataFrame, key: str, sigma_mas: float) -> list[tuple]:
    """Fits of bodies whose observations are spread over tasks; each step of all of them is one job over all rows."""
    rows = stage(rows.select(key, *_OBSERVED, *ORBIT, "epoch_jd").repartition(shuffle_partitions(rows.sparkSession)), "observations")
    first = {r[0]: r[1] for r in rows.groupBy(key).agg(F.min(F.struct("jd", *ORBIT, "epoch_jd"))).collect()}
    epochs = {k: float(r["epoch_jd"]) for k, r in first.items()}
    fitting = {k: _fit_in_steps(np.array([r[c] for c in ORBIT], float)) for k, r in first.items()}
    asks, out = {k: next(f) for k, f in fitting.items()}, []
    while asks:
        def run(frames: Iterator[pd.DataFrame], asks: dict[object, Ask] = dict(asks)) -> Iterator[pd.DataFrame]:  # noqa: B006
            total: dict[object, np.ndarray] = {}
            for frame in frames:
                for k, part in frame.groupby(key):
                    if k in asks:
                        o = part[_OBSERVED].to_numpy(float)
                        total[k] = total.get(k, 0.0) + _sums(asks[k], epochs[k], o[:, 0], o[:, 1:3], o[:, 3:], sigma_mas)
            if total:
                yield pd.DataFrame({key: list(total), "s": list(total.values())})

        sums: dict[object, np.ndarray] = {}
        for r in rows.select(key, *_OBSERVED).mapInPandas(run, f"{key} int, s array<double>").collect():
            sums[r[0]] = sums.get(r[0], 0.0) + np.array(r[1], float)
        for k in list(asks):
            try:
                asks[k] = fitting[k].send(sums[k])
            except StopIteration as end:
                fit, kept = end.value
                out.append((k, *map(float, fit.x), *map(float, fit.sigma), fit.chi2 / fit.dof, kept, None))
                del asks[k]
            except (ValueError, np.linalg.LinAlgError) as error:
                out.append((k, *[None] * 13, 0, str(error)[:200]))
                del asks[k]
    return out


def orbit_fits(observations: DataFrame, seeds: DataFrame, key: str, sigma_mas: float = 5.0, task_obs: int = 20_000) -> DataFrame:
    """``key``, six elements, their sigmas, reduced chi-square, observations kept and an error text.

    Every observation counts. A body of up to ``task_obs`` observations is fitted in one task, many side by side; of a larger one
    the normal equations are summed over tasks in each step of the same fit. Failures are rows, not exceptions.
    """
    fields = ", ".join([*[f"{c} double" for c in ORBIT], *[f"sigma_{c} double" for c in ORBIT]])
    schema = f"{key} int, {fields}, chi2_red double, kept int, error string"
    least = 8

    def fitted_rows(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        head = np.flatnonzero(rows[key].ne(rows[key].shift()))
        count = np.diff(head, append=len(rows))
        values = rows[[*_OBSERVED, *ORBIT, "epoch_jd"]].to_numpy(float)
        few = np.flatnonzero(count < least)
        if len(few):
            yield pd.DataFrame({key: rows[key].to_numpy()[head[few]], **dict.fromkeys([*ORBIT, *[f"sigma_{c}" for c in ORBIT], "chi2_red"]), "kept": 0, "error": [f"{k} observations; {least} are needed" for k in count[few]]})
        enough = np.flatnonzero(count >= least)
        enough = enough[np.argsort(count[enough], kind="stable")]
        while len(enough):
            size = max(1, int(np.searchsorted(np.arange(1, len(enough) + 1) * count[enough], FIT_OBS, "right")))
            first, many, enough = head[enough[:size]], count[enough[:size]], enough[size:]
            turn = np.arange(many.max())
            seen = turn < many[:, None]
            o = values[first[:, None] + np.where(seen, turn, 0)]
            x, sigma, chi2_red, kept, good = fit_orbits_together(values[first, 6:12], values[first, 12], o[..., 0], o[..., 1:3], o[..., 3:6], seen, sigma_mas, least=least)
            out = {**{c: x[:, k] for k, c in enumerate(ORBIT)}, **{f"sigma_{c}": sigma[:, k] for k, c in enumerate(ORBIT)}, "chi2_red": chi2_red}
            yield pd.DataFrame({key: rows[key].to_numpy()[first], **{c: np.where(good, v, None) for c, v in out.items()}, "kept": np.where(good, kept, 0), "error": np.where(good, None, _FAILED)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= 2 * FIT_OBS:
                rows = pd.concat(held, ignore_index=True)
                whole = (rows[key] != rows[key].iloc[-1]).to_numpy()  # the last body may go on
                yield from fitted_rows(rows[whole].reset_index(drop=True)) if whole.any() else ()
                held = [rows[~whole]]
        if held:
            yield from fitted_rows(pd.concat(held, ignore_index=True))

    spark = observations.sparkSession
    large = [r[0] for r in observations.groupBy(key).count().where(F.col("count") > task_obs).select(key).collect()]  # at most a row per task_obs
    joined = observations.join(seeds.select(key, *ORBIT, "epoch_jd"), key).select(key, *_OBSERVED, *ORBIT, "epoch_jd")
    small = joined.where(~F.col(key).isin(large)) if large else joined
    fitted = small.repartition(shuffle_partitions(spark), key).sortWithinPartitions(key, "jd").mapInPandas(run, schema)
    return fitted.unionByName(spark.createDataFrame(_fit_spread(joined.where(F.col(key).isin(large)), key, sigma_mas), schema)) if large else fitted


def observed(bodies: DataFrame, key: str, times: list[float]) -> DataFrame:
    """``key, jd, ra, dec, x_gaia, y_gaia, z_gaia``: where bodies stand in the sky, seen from the Earth, without noise."""
    t = np.array(times, float)
    a, e, i, node, peri, lon, rate, _ = PLANETS["earth"]
    ecliptic = elements_to_state(a, e, i, node, peri - node, lon + rate * (t - 2451545.0) / 36525.0 - peri, t, t)[:, :3]
    eye = np.stack([ecliptic[:, 0], np.cos(_EPS) * ecliptic[:, 1] - np.sin(_EPS) * ecliptic[:, 2], np.sin(_EPS) * ecliptic[:, 1] + np.cos(_EPS) * ecliptic[:, 2]], 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = len(frame)
            args = [np.repeat(frame[c].to_numpy(float), len(t)) for c in [*ORBIT, "epoch_jd"]]
            seen = sky(positions(*args, np.tile(t, n)), np.tile(eye, (n, 1)))
            yield pd.DataFrame({key: np.repeat(frame[key].to_numpy(), len(t)), "jd": np.tile(t, n), "ra": seen[:, 0], "dec": seen[:, 1], **{f"{c}_gaia": np.tile(eye[:, k], n) for k, c in enumerate("xyz")}})

    return bodies.select(key, *ORBIT, "epoch_jd").dropna().mapInPandas(run, f"{key} int, jd double, ra double, dec double, x_gaia double, y_gaia double, z_gaia double")


def transition_volume(bodies: DataFrame, key: str, days: float) -> DataFrame:
    """``key, volume``: determinant of the derivatives of the state after ``days`` by the state at the elements' epoch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), 2000):
                part = frame.iloc[k : k + 2000]
                args = [part[c].to_numpy(float) for c in [*ORBIT, "epoch_jd"]]
                _, by_state, _ = variations(elements_to_state(*args, args[-1]), 0.0, days, 1.0)
                yield pd.DataFrame({key: part[key].to_numpy(), "volume": np.linalg.det(by_state)})

    spread = bodies.select(key, *ORBIT, "epoch_jd").dropna().repartition(shuffle_partitions(bodies.sparkSession), key)
    return spread.mapInPandas(run, f"{key} int, volume double")


def nbody_propagate(elements: DataFrame, ident: str, times: list[float], planets: tuple[str, ...] = tuple(PLANETS), step: float = 2.0, perturbers: tuple[Perturber, ...] = ()) -> DataFrame:
    """``ident, step_idx, t_jd, x, y, z``: massless bodies at all times under the Sun, planets and asteroids of known mass.

    Steps go out from the bodies' one common epoch both ways; other epochs, or times that don't rise, are an error.
    Bodies don't feel each other, so any shard of them is integrated by itself.
    """
    if any(b <= a for a, b in zip(times, times[1:], strict=False)):
        raise ValueError("the times must rise")
    bodies = elements.select(F.col(ident).cast("bigint").alias(ident), *ORBIT, "epoch_jd").dropna()
    low, high = bodies.agg(F.min("epoch_jd"), F.max("epoch_jd")).first()
    if low != high:
        raise ValueError("the bodies have different epochs")
    t = np.array(times, float)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), 1000):
                part = frame.iloc[k : k + 1000]
                args = [part[c].to_numpy(float) for c in [*ORBIT, "epoch_jd"]]
                path = integrate(elements_to_state(*args, args[-1]), float(low), t, acceleration(planets, perturbers), step).swapaxes(0, 1)[:, :, :3]
                flat = path.reshape(-1, 3)
                yield pd.DataFrame({ident: np.repeat(part[ident].to_numpy(), len(t)), "step_idx": np.tile(np.arange(len(t)), len(part)), "t_jd": np.tile(t, len(part)), "x": flat[:, 0], "y": flat[:, 1], "z": flat[:, 2]})

    spread = bodies.repartition(shuffle_partitions(elements.sparkSession), ident)
    return spread.mapInPandas(run, f"{ident} bigint, step_idx bigint, t_jd double, x double, y double, z double")


def nbody_refine(pairs: DataFrame, ident: list[str], planets: tuple[str, ...] = GIANTS, window_days: float = 1.0, sample_days: float = 1.0 / 48) -> DataFrame:
    """Pairs (with both orbits, ``_i`` and ``_j``, and ``jd_tdb``) refined under planetary perturbations.

    Adds ``t_min_nbody_jd, dist_au_nbody, rel_vel_nbody, nbody_energy_drift, nbody_converged, near_boundary,
    error_message``; a pair that fails is a row with its error.
    """
    from nearpass.operators.detect import vertex_np

    names = ["t_min_nbody_jd", "dist_au_nbody", "rel_vel_nbody", "nbody_energy_drift", "nbody_converged", "near_boundary", "error_message"]
    half = round(window_days / sample_days)

    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        epoch, centre = rows["epoch_jd_i"].to_numpy(float), rows["jd_tdb"].to_numpy(float)
        first = np.stack([elements_to_state(*[rows[f"{c}_{s}"].to_numpy(float) for c in ORBIT], epoch, epoch) for s in "ij"], 1)
        pull, t = giants_pull(planets), centre - half * sample_days
        state = advance(first, epoch, t, pull, 2.0)
        path = [state]
        for k in range(1, 2 * half + 1):
            now = centre + (k - half) * sample_days
            path.append(advance(path[-1], t, now, pull, max(sample_days, 0.1)))
            t = now
        track = np.stack(path, 1)
        d = np.linalg.norm(track[:, :, 0, :3] - track[:, :, 1, :3], axis=-1)
        n = np.arange(len(rows))
        k = np.clip(np.where(np.isfinite(d), d, np.inf).argmin(1), 1, 2 * half - 1)
        pick = k[:, None] + np.array([-1, 0, 1])
        at, deep = vertex_np(centre[:, None] + (pick - half) * sample_days, np.take_along_axis(d, pick, 1))
        speed = np.linalg.norm(track[n, k, 0, 3:] - track[n, k, 1, 3:], axis=-1)
        free = advance(first, epoch, centre, giants_pull(()), 2.0)  # the integrator's own error
        drift = np.abs(energy(free) / energy(first) - 1).max(1)
        ok = np.isfinite(deep)
        return pd.DataFrame({"t_min_nbody_jd": at, "dist_au_nbody": deep, "rel_vel_nbody": speed, "nbody_energy_drift": drift, "nbody_converged": ok & (drift < 1e-7), "near_boundary": np.abs(at - centre) > 0.95 * window_days, "error_message": np.where(ok, None, "the integration left the finite numbers")}, index=rows.index)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.reset_index(drop=True)
            out = pd.DataFrame({c: pd.Series([None] * len(frame), dtype=object) for c in names})
            fair = frame["epoch_jd_i"] == frame["epoch_jd_j"]
            out.loc[~fair, ["nbody_converged", "near_boundary"]] = False
            out.loc[~fair, "error_message"] = "the two orbits have different epochs"
            for k in range(0, int(fair.sum()), 2000):
                rows = frame[fair].iloc[k : k + 2000]
                out.loc[rows.index, names] = batch(rows).astype(object)
            yield pd.concat([frame[[*ident, "jd_tdb"]], out], axis=1)

    keys = ", ".join(f"{c} bigint" for c in ident)
    spread = pairs.repartition(shuffle_partitions(pairs.sparkSession), *ident)
    return spread.mapInPandas(run, f"{keys}, jd_tdb double, t_min_nbody_jd double, dist_au_nbody double, rel_vel_nbody double, nbody_energy_drift double, nbody_converged boolean, near_boundary boolean, error_message string")


def bootstrap_means(df: DataFrame, key: str, ident: str, value: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """Poisson bootstrap of the mean: spread and percentile interval per key.

    Each reading's weight in a replicate is a Poisson number drawn from a hash of reading and
    replicate, so replicates need no second pass and no collected group. A task sums the weights and weighted
    values of all replicates in arrays, one pair per key and Arrow batch; only these are spread out and added.
    """
    cumulative = np.cumsum([0.36787944117144233 / float(np.prod(range(1, k + 1))) for k in range(8)])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            order = np.argsort(frame[key].to_numpy(), kind="stable")
            frame = frame.iloc[order]
            first = np.flatnonzero(np.r_[True, frame[key].to_numpy()[1:] != frame[key].to_numpy()[:-1]])
            v = frame["_v"].to_numpy(float)
            n, s = np.zeros((len(first), replicates)), np.zeros((len(first), replicates))
            reading = _mixed(frame[ident].to_numpy(np.int64).view(np.uint64) + np.uint64(seed))
            for b in range(replicates):
                u = (_mixed(reading ^ _mixed(np.full(1, b + 1, np.uint64))) >> np.uint64(11)).astype(float) / float(1 << 53)
                w = np.searchsorted(cumulative, u).astype(float)
                n[:, b], s[:, b] = np.add.reduceat(w, first), np.add.reduceat(w * v, first)
            yield pd.DataFrame({key: frame[key].to_numpy()[first], "n": list(n), "s": list(s)})

    rows = df.where(F.col(value).isNotNull() & F.col(ident).isNotNull() & F.col(key).isNotNull()).select(key, F.col(ident).cast("bigint").alias(ident), F.col(value).cast("double").alias("_v"))
    sums = rows.mapInPandas(partial, f"{key} {df.schema[key].dataType.simpleString()}, n array<double>, s array<double>")
    per = sums.select(key, F.posexplode(F.arrays_zip("n", "s")).alias("b", "sums")).groupBy(key, "b").agg(F.sum("sums.n").alias("n"), F.sum("sums.s").alias("s")).where("n > 0")
    means = per.withColumn("m", F.col("s") / F.col("n"))
    return means.groupBy(key).agg(F.stddev_samp("m").alias("sigma"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _roots(frame: pd.DataFrame, side: str) -> tuple[np.ndarray, list[str | None]]:
    """Square roots of the bodies' element covariances, and what is wrong with them; one that isn't quite positive gets a jitter."""
    roots, notes = np.full((len(frame), 6, 6), np.nan), [None] * len(frame)
    sigmas = np.stack([frame[c].to_numpy(float) if (c := f"sigma_{x}_{side}") in frame else np.full(len(frame), np.nan) for x in ORBIT], 1)
    given = frame[f"covariance_{side}"].tolist() if f"covariance_{side}" in frame else [None] * len(frame)
    for k, full in enumerate(given):
        matrix = np.diag(sigmas[k] ** 2) if full is None else np.asarray(full, float).reshape(6, 6)
        if not np.isfinite(matrix).all():
            notes[k] = "no covariance"
            continue
        if full is None:
            roots[k] = np.diag(sigmas[k])
            continue
        notes[k] = "covariance is not positive"
        for jitter in (0.0, 1e-12, 1e-9, 1e-6):
            try:
                roots[k], notes[k] = np.linalg.cholesky(matrix + jitter * np.diag(np.abs(np.diag(matrix)) + 1e-300)), None
                break
            except np.linalg.LinAlgError:
                continue
    return roots, notes


def _normals(ident: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """``(n, draws, 6)`` standard normal numbers that depend on the row's number and the seed only."""
    place = np.arange(draws * 6, dtype=np.uint64)
    bits = [_mixed(_mixed(ident + np.uint64(2 * seed + k))[:, None] ^ _mixed(place + np.uint64(1))[None, :]) for k in range(2)]
    u, v = (((b >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53) for b in bits)
    return (np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)).reshape(len(ident), draws, 6)


def monte_carlo_distance(pairs: DataFrame, draws: int = 500, seed: int = 0) -> DataFrame:
    """Spread of a pair's distance: median, sigma, 16 and 84 percent, from independent draws per body.

    Each body brings a covariance of its six elements (``covariance_i/_j``, 36 numbers by row) or their
    sigmas (``sigma_<c>_i/_j``). Fewer than 50 finite draws, or neither of them, give nulls and a note.
    Draws come from a hash of the pair's ids, all pairs of a batch at once.
    """

    def batch(frame: pd.DataFrame) -> pd.DataFrame:
        ids = [_mixed(frame[f"idx_{s}"].to_numpy(np.int64).view(np.uint64)) for s in "ij"]
        with np.errstate(over="ignore"):
            pair = _mixed(ids[0] * np.uint64(3) + ids[1])
        notes: list[str | None] = [None] * len(frame)
        places = []
        for k, s in enumerate("ij"):
            roots, wrong = _roots(frame, s)
            notes = [a or b for a, b in zip(notes, wrong, strict=True)]
            x = frame[[f"{c}_{s}" for c in ORBIT]].to_numpy(float)[:, None, :] + np.einsum("nij,ndj->ndi", roots, _normals(pair, draws, 2 * seed + k))
            x[(x[..., 0] <= 0) | (x[..., 1] < 0) | (x[..., 1] >= 1)] = np.nan
            with np.errstate(invalid="ignore"):
                places.append(positions(*[x[..., c] for c in range(6)], frame[f"epoch_jd_{s}"].to_numpy(float)[:, None], frame["jd_tdb"].to_numpy(float)[:, None]))
        d = np.linalg.norm(places[0] - places[1], axis=2)
        many = np.isfinite(d).sum(1) >= 50
        notes = [a or (None if b else "fewer than 50 usable draws") for a, b in zip(notes, many, strict=True)]
        fine = np.array([n is None for n in notes])
        out = {c: np.full(len(frame), np.nan) for c in ("median_au", "sigma_au", "p16_au", "p84_au")}
        if fine.any():
            good = np.where(np.isfinite(d[fine]), d[fine], np.nan)
            out["median_au"][fine], out["p16_au"][fine], out["p84_au"][fine] = np.nanquantile(good, [0.5, 0.16, 0.84], axis=1)
            out["sigma_au"][fine] = np.nanstd(good, axis=1, ddof=1)
        return pd.DataFrame({"idx_i": frame["idx_i"], "idx_j": frame["idx_j"], **{c: pd.Series(v, index=frame.index).astype(object).where(fine, None) for c, v in out.items()}, "note": pd.Series(notes, index=frame.index, dtype=object)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            size = max(1, 200_000 // draws)
            for k in range(0, len(frame), size):
                yield batch(frame.iloc[k : k + size].reset_index(drop=True))

    return pairs.mapInPandas(run, "idx_i bigint, idx_j bigint, median_au double, sigma_au double, p16_au double, p84_au double, note string")
