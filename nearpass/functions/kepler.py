"""Two-body motion: Column expressions for ad-hoc use, NumPy kernels for bulk propagation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: Gaussian gravitational constant, AU^1.5 per day.
GAUSS_K = 0.01720209895
NEWTON_STEPS = 15
#: From this eccentricity on, E = M is no safe start.
HIGH_ECC = 0.8
OBLIQUITY_DEG = 84381.406 / 3600.0


def mean_anomaly(m0_deg: Column, a_au: Column, epoch_jd: Column, t_jd: Column) -> Column:
    """Radians in [0, 2 pi) at ``t_jd``."""
    return F.pmod(F.radians(m0_deg) + F.lit(GAUSS_K) / F.pow(a_au, 1.5) * (t_jd - epoch_jd), F.lit(2 * np.pi))


def eccentric_anomaly(mean: Column, ecc: Column, steps: int = NEWTON_STEPS) -> Column:
    """Kepler's equation by a fixed number of Newton steps, from E = M or, where that may not converge, from M + 0.85 e."""
    start = F.when(ecc >= HIGH_ECC, mean + 0.85 * ecc * F.signum(F.sin(mean))).otherwise(mean)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda big_e, _: big_e + (mean - big_e + ecc * F.sin(big_e)) / (1.0 - ecc * F.cos(big_e)))


def true_anomaly(big_e: Column, ecc: Column) -> Column:
    return 2.0 * F.atan2(F.sqrt(1.0 + ecc) * F.sin(big_e / 2.0), F.sqrt(1.0 - ecc) * F.cos(big_e / 2.0))


def orbit_xyz(a_au: Column, ecc: Column, i_deg: Column, node_deg: Column, argperi_deg: Column, big_e: Column) -> dict[str, Column]:
    """Heliocentric mean-ecliptic J2000 coordinates in AU from the eccentric anomaly."""
    r = a_au * (1.0 - ecc * F.cos(big_e))
    u = F.radians(argperi_deg) + true_anomaly(big_e, ecc)
    cn, sn, ci, si = F.cos(F.radians(node_deg)), F.sin(F.radians(node_deg)), F.cos(F.radians(i_deg)), F.sin(F.radians(i_deg))
    return {
        "x": r * (cn * F.cos(u) - sn * F.sin(u) * ci),
        "y": r * (sn * F.cos(u) + cn * F.sin(u) * ci),
        "z": r * F.sin(u) * si,
    }


def orbit_class(a_au: Column, ecc: Column) -> Column:
    """NEA wins over the belts; then TNO, Centaur, Trojan, MBA; anything else is Other."""
    trojan = F.abs(a_au - 5.205) < 0.5
    return (
        F.when(a_au.isNull() | ecc.isNull(), "Other")
        .when(a_au * (1.0 - ecc) < 1.3, "NEA")
        .when((a_au >= 1.7) & (a_au < 5.5) & ~trojan, "MBA")
        .when(trojan, "Trojan")
        .when((a_au > 5.5) & (a_au <= 30.0), "Centaur")
        .when(a_au > 30.0, "TNO")
        .otherwise("Other")
    )


def solve_kepler(mean: np.ndarray, ecc: np.ndarray, steps: int = NEWTON_STEPS) -> np.ndarray:
    """Vectorised twin of ``eccentric_anomaly`` with cubic steps; stops when no further step moves anything.

    Up to an eccentricity of 0.8 two terms of the series in e are the start, and a step smaller than
    3e-6 leaves an error below a double's.
    """
    mean, ecc = np.asarray(mean, dtype=float), np.asarray(ecc, dtype=float)
    flat = not (ecc >= HIGH_ECC).any()
    s = np.sin(mean)
    if flat:
        big_e = mean + ecc * s * (1.0 + ecc * np.cos(mean))
    else:
        big_e = np.where(ecc >= HIGH_ECC, mean + 0.85 * ecc * np.sign(s), mean)
    for _ in range(steps):
        s, slope = ecc * np.sin(big_e), 1.0 - ecc * np.cos(big_e)
        move = (mean - big_e + s) / slope
        move /= 1.0 + 0.5 * move * s / slope
        big_e += move
        if not (np.abs(move) >= (3e-6 if flat else 1e-11)).any():
            break
    return big_e


def positions(a, ecc, i_deg, node_deg, argperi_deg, m0_deg, epoch_jd, t_jd) -> np.ndarray:  # noqa: ANN001
    """``(..., 3)`` heliocentric positions; all arguments broadcast against each other."""
    a, ecc = np.asarray(a, float), np.asarray(ecc, float)
    mean = np.mod(np.radians(m0_deg) + GAUSS_K / a**1.5 * (np.asarray(t_jd, float) - epoch_jd), 2 * np.pi)
    ecc_b = np.broadcast_to(ecc, mean.shape)
    big_e = solve_kepler(mean, ecc_b)
    r = a * (1.0 - ecc_b * np.cos(big_e))
    nu = 2.0 * np.arctan2(np.sqrt(1.0 + ecc_b) * np.sin(big_e / 2), np.sqrt(1.0 - ecc_b) * np.cos(big_e / 2))
    u = np.radians(argperi_deg) + nu
    cn, sn = np.cos(np.radians(node_deg)), np.sin(np.radians(node_deg))
    ci, si = np.cos(np.radians(i_deg)), np.sin(np.radians(i_deg))
    cu, su = np.cos(u), np.sin(u)
    return np.stack([r * (cn * cu - sn * su * ci), r * (sn * cu + cn * su * ci), r * su * si], axis=-1)


def tracks(orbits: list[np.ndarray], t_jd: np.ndarray, speeds: bool = False) -> np.ndarray:
    """``(times, bodies, 3)``: ``positions`` of many bodies at many times, with what only depends on the body done once.

    ``orbits`` are seven arrays of elements. The last step of Kepler's equation is below 3e-6 and turns sine and cosine
    without computing them again. With ``speeds`` the velocities follow as three more columns; eccentricities are then below 0.8.
    """
    a, ecc, i, node, peri, m0, epoch = (np.asarray(c, float) for c in orbits)
    i, node, peri, m0 = (np.radians(c) for c in (i, node, peri, m0))
    mean = m0 + GAUSS_K / a**1.5 * (np.asarray(t_jd, float)[:, None] - epoch)
    shape = mean.shape
    mean = (mean - 2 * np.pi * np.floor(mean / (2 * np.pi))).ravel()
    e = np.broadcast_to(ecc, shape).ravel()
    big_e = mean + e * np.sin(mean) * (1.0 + e * np.cos(mean))
    sin_e, cos_e = np.empty_like(mean), np.empty_like(mean)
    left = np.arange(len(mean))
    for _ in range(NEWTON_STEPS):
        at, k = big_e[left], e[left]
        s, c = np.sin(at), np.cos(at)
        slope = 1.0 - k * c
        move = (mean[left] - at + k * s) / slope
        move /= 1.0 + 0.5 * move * k * s / slope
        big_e[left] = at + move
        sin_e[left], cos_e[left] = s + move * (c - 0.5 * move * s), c - move * (s + 0.5 * move * c)
        left = left[np.abs(move) >= 3e-6]
        if not len(left):
            break
    cn, sn, ci, si, cw, sw = np.cos(node), np.sin(node), np.cos(i), np.sin(i), np.cos(peri), np.sin(peri)
    p = (cw * cn - sw * sn * ci, cw * sn + sw * cn * ci, sw * si)
    q = (-sw * cn - cw * sn * ci, -sw * sn + cw * cn * ci, cw * si)
    along, across = (cos_e.reshape(shape) - ecc) * a, sin_e.reshape(shape) * (a * np.sqrt(1.0 - ecc * ecc))
    out = [along * x + across * y for x, y in zip(p, q, strict=True)]
    if speeds:
        rate = (GAUSS_K / a**1.5) / (1.0 - ecc * cos_e.reshape(shape))
        along, across = sin_e.reshape(shape) * rate * -a, cos_e.reshape(shape) * rate * (a * np.sqrt(1.0 - ecc * ecc))
        return np.stack([*out, *[along * x + across * y for x, y in zip(p, q, strict=True)]], axis=-1)
    out = np.stack(out, axis=-1)
    wild = np.flatnonzero(~(ecc < HIGH_ECC))
    if len(wild):
        out[:, wild] = positions(*[np.asarray(c, float)[wild] for c in orbits], np.asarray(t_jd, float)[:, None])
    return out


def elements_to_state(a, ecc, i_deg, node_deg, argperi_deg, m0_deg, epoch_jd, t_jd, gm: float = GAUSS_K**2) -> np.ndarray:  # noqa: ANN001
    """``(..., 6)`` position and velocity (AU, AU/day) by the analytic derivative of the two-body motion."""
    a, ecc = np.asarray(a, float), np.asarray(ecc, float)
    n = np.sqrt(gm) / a**1.5
    mean = np.mod(np.radians(m0_deg) + n * (np.asarray(t_jd, float) - epoch_jd), 2 * np.pi)
    big_e = solve_kepler(mean, np.broadcast_to(ecc, mean.shape))
    b = a * np.sqrt(1 - ecc**2)
    rate = n / (1 - ecc * np.cos(big_e))
    plane = np.stack([a * (np.cos(big_e) - ecc), b * np.sin(big_e), -a * np.sin(big_e) * rate, b * np.cos(big_e) * rate], -1)
    w, o, i = np.radians(argperi_deg), np.radians(node_deg), np.radians(i_deg)
    p = np.stack(np.broadcast_arrays(np.cos(w) * np.cos(o) - np.sin(w) * np.sin(o) * np.cos(i), np.cos(w) * np.sin(o) + np.sin(w) * np.cos(o) * np.cos(i), np.sin(w) * np.sin(i)), -1)
    q = np.stack(np.broadcast_arrays(-np.sin(w) * np.cos(o) - np.cos(w) * np.sin(o) * np.cos(i), -np.sin(w) * np.sin(o) + np.cos(w) * np.cos(o) * np.cos(i), np.cos(w) * np.sin(i)), -1)
    return np.concatenate([plane[..., :1] * p + plane[..., 1:2] * q, plane[..., 2:3] * p + plane[..., 3:4] * q], -1)


def state_to_elements(state: np.ndarray, epoch_jd: float, gm: float = GAUSS_K**2) -> dict[str, np.ndarray]:
    """Osculating elements in degrees of ``(..., 6)`` bound states."""
    r, v = state[..., :3], state[..., 3:]
    rn = np.linalg.norm(r, axis=-1)
    h = np.cross(r, v)
    a = 1.0 / (2.0 / rn - (v * v).sum(-1) / gm)
    e_vec = np.cross(v, h) / gm - r / rn[..., None]
    ecc = np.linalg.norm(e_vec, axis=-1)
    inc = np.arccos(np.clip(h[..., 2] / np.linalg.norm(h, axis=-1), -1, 1))
    node = np.arctan2(h[..., 0], -h[..., 1])
    along = np.stack([np.cos(node), np.sin(node), np.zeros_like(node)], -1)
    across = np.cross(h / np.linalg.norm(h, axis=-1)[..., None], along)
    argp = np.arctan2((e_vec * across).sum(-1), (e_vec * along).sum(-1))
    u = np.arctan2((r * across).sum(-1), (r * along).sum(-1))
    nu = u - argp
    big_e = 2 * np.arctan2(np.sqrt(np.maximum(1 - ecc, 0)) * np.sin(nu / 2), np.sqrt(1 + ecc) * np.cos(nu / 2))
    mean = big_e - ecc * np.sin(big_e)
    deg = lambda x: np.degrees(np.mod(x, 2 * np.pi))
    return {"a_au": a, "ecc": ecc, "i_deg": np.degrees(inc), "node_deg": deg(node), "argperi_deg": deg(argp), "mean_anomaly_deg": deg(mean), "epoch_jd": np.full_like(a, epoch_jd)}
