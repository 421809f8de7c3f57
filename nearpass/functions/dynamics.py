"""Numerical integration of small bodies under the Sun, planets and asteroid perturbers (NumPy)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from nearpass.functions.kepler import GAUSS_K, elements_to_state

GM_SUN = GAUSS_K**2
#: Mean elements at J2000 (a AU, e, i, node, perihelion longitude, mean longitude in degrees), the longitude's rate in degrees a century, and the Sun's mass over the planet's.
PLANETS = {
    "mercury": (0.38709927, 0.20563593, 7.00497902, 48.33076593, 77.45779628, 252.25032350, 149472.67411175, 6023600.0),
    "venus": (0.72333566, 0.00677672, 3.39467605, 76.67984255, 131.60246718, 181.97909950, 58517.81538729, 408523.71),
    "earth": (1.00000261, 0.01671123, -0.00001531, 0.0, 102.93768193, 100.46457166, 35999.37244981, 328900.56),
    "mars": (1.52371034, 0.09339410, 1.84969142, 49.55953891, -23.94362959, -4.55343205, 19140.30268499, 3098708.0),
    "jupiter": (5.20288700, 0.04838624, 1.30439695, 100.47390909, 14.72847983, 34.39644051, 3034.74612775, 1047.3486),
    "saturn": (9.53667594, 0.05386179, 2.48599187, 113.66242448, 92.59887831, 49.95424423, 1222.49362201, 3497.898),
    "uranus": (19.18916464, 0.04725744, 0.77263783, 74.01692503, 170.95427630, 313.23810451, 428.48202785, 22902.98),
    "neptune": (30.06992276, 0.00859048, 1.77004347, 131.78422574, 44.96476227, -55.12002969, 218.45945325, 19412.24),
}
GIANTS = ("jupiter", "saturn")


def planet_positions(names: tuple[str, ...], jd: float) -> tuple[np.ndarray, np.ndarray]:
    """Heliocentric positions and GMs from mean elements."""
    xyz, gm = [], []
    for name in names:
        a, e, i, node, peri, lon, rate, inverse = PLANETS[name]
        mean = lon + rate * (jd - 2451545.0) / 36525.0 - peri
        xyz.append(elements_to_state(a, e, i, node, peri - node, mean, jd, jd)[:3])
        gm.append(GM_SUN / inverse)
    return np.array(xyz).reshape(-1, 3), np.array(gm)


@dataclass(frozen=True)
class Perturber:
    """An asteroid of known mass on its own two-body orbit."""

    gm: float
    elements: dict[str, float] = field(hash=False)

    def position(self, jd: float) -> np.ndarray:
        return elements_to_state(*[self.elements[c] for c in ("a_au", "ecc", "i_deg", "node_deg", "argperi_deg", "mean_anomaly_deg", "epoch_jd")], jd)[:3]


def acceleration(planets: tuple[str, ...] = GIANTS, perturbers: tuple[Perturber, ...] = ()) -> Callable[[float, np.ndarray], np.ndarray]:
    """Heliocentric acceleration of massless bodies at ``(n, 3)`` positions, with the indirect terms."""

    def at(jd: float, r: np.ndarray) -> np.ndarray:
        d2 = (r * r).sum(-1, keepdims=True)
        total = -GM_SUN * r / d2**1.5
        xyz, gm = planet_positions(planets, jd) if planets else (np.zeros((0, 3)), np.zeros(0))
        if perturbers:
            xyz = np.concatenate([xyz, np.array([p.position(jd) for p in perturbers])])
            gm = np.concatenate([gm, np.array([p.gm for p in perturbers])])
        for s, g in zip(xyz, gm, strict=True):
            gap = s - r
            total = total + g * (gap / ((gap * gap).sum(-1, keepdims=True)) ** 1.5 - s / (s @ s) ** 1.5)
        return total

    return at


#: Nodes and weights of the sixth-order symmetric composition of leapfrog steps.
_W = (0.784513610477560, 0.235573213359357, -1.17767998417887)
_YOSHIDA = (_W[0], _W[1], _W[2], 1.0 - 2.0 * sum(_W), _W[2], _W[1], _W[0])


def integrate(state: np.ndarray, start_jd: float, times: np.ndarray, accel: Callable[[float, np.ndarray], np.ndarray], step: float = 1.0) -> np.ndarray:
    """``(T, n, 6)`` states at the given times, both before and after ``start_jd``.

    A sixth-order symplectic composition with equal steps of at most ``step`` days between samples.
    """
    times = np.asarray(times, float)
    out = np.empty((len(times), *state.shape))
    for sign in (1, -1):
        picked = [k for k in np.argsort(sign * times, kind="stable") if sign * (times[k] - start_jd) >= 0 and (sign > 0 or times[k] < start_jd)]
        r, v, t = state[:, :3].copy(), state[:, 3:].copy(), start_jd
        for k in picked:
            n = max(1, int(np.ceil(abs(times[k] - t) / step)))
            h = (times[k] - t) / n
            for _ in range(n if h else 0):
                for w in _YOSHIDA:
                    r = r + 0.5 * w * h * v
                    v = v + w * h * accel(t + 0.5 * w * h, r)
                    r = r + 0.5 * w * h * v
                    t += w * h
            t = float(times[k])
            out[k, :, :3], out[k, :, 3:] = r, v
    return out


def giants_pull(planets: tuple[str, ...]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Like ``acceleration``, for ``(n, b, 3)`` positions at ``n`` different times."""

    def at(jd: np.ndarray, r: np.ndarray) -> np.ndarray:
        total = -GM_SUN * r / ((r * r).sum(-1, keepdims=True)) ** 1.5
        for name in planets:
            a, e, i, node, peri, lon, rate, inverse = PLANETS[name]
            s = elements_to_state(a, e, i, node, peri - node, lon + rate * (jd - 2451545.0) / 36525.0 - peri, jd, jd)[:, None, :3]
            gap = s - r
            total = total + GM_SUN / inverse * (gap / ((gap * gap).sum(-1, keepdims=True)) ** 1.5 - s / ((s * s).sum(-1, keepdims=True)) ** 1.5)
        return total

    return at


def advance(state: np.ndarray, t: np.ndarray, target: np.ndarray, accel: Callable[[np.ndarray, np.ndarray], np.ndarray], step: float) -> np.ndarray:
    """``(n, b, 6)`` states from times ``t`` to ``target``, all n at once with their own step lengths."""
    n = max(1, int(np.ceil(np.abs(target - t).max(initial=0.0) / step)))
    h = ((target - t) / n)[:, None, None]
    r, v, now = state[..., :3].copy(), state[..., 3:].copy(), t.astype(float).copy()
    for _ in range(n):
        for w in _YOSHIDA:
            r = r + 0.5 * w * h * v
            v = v + w * h * accel(now + 0.5 * w * h[:, 0, 0], r)
            r = r + 0.5 * w * h * v
            now = now + w * h[:, 0, 0]
    return np.concatenate([r, v], -1)


def energy(state: np.ndarray) -> np.ndarray:
    """Two-body energy per mass."""
    r, v = state[..., :3], state[..., 3:]
    return (v * v).sum(-1) / 2 - GM_SUN / np.linalg.norm(r, axis=-1)


def variations(state: np.ndarray, start_jd: float, end_jd: float, step: float = 1.0, planets: tuple[str, ...] = (), perturber: Perturber | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States ``(n, 6)`` carried to ``end_jd``, with the derivatives by their start ``(n, 6, 6)`` and by the perturber's GM ``(n, 6)``.

    The variational equations are integrated along with the motion (fourth-order Runge-Kutta, equal steps of at most ``step`` days).
    """
    n = len(state)
    steps = max(1, int(np.ceil(abs(end_jd - start_jd) / step)))
    h = (end_jd - start_jd) / steps

    def slope(t: float, y: np.ndarray) -> np.ndarray:
        r, d = y[:, :3, 0], np.linalg.norm(y[:, :3, 0], axis=1)
        pull = -GM_SUN * r / d[:, None] ** 3
        tide = GM_SUN * (3 * r[:, :, None] * r[:, None, :] / d[:, None, None] ** 5 - np.eye(3) / d[:, None, None] ** 3)
        by_gm = np.zeros((n, 3))
        xyz, gm = planet_positions(planets, t) if planets else (np.zeros((0, 3)), np.zeros(0))
        bodies = [*zip(xyz, gm, strict=True), *([(perturber.position(t), perturber.gm)] if perturber else [])]
        for k, (s, g) in enumerate(bodies):
            gap = s - r
            far = np.linalg.norm(gap, axis=1)
            unit = gap / far[:, None] ** 3 - s / np.linalg.norm(s) ** 3
            pull = pull + g * unit
            tide = tide + g * (3 * gap[:, :, None] * gap[:, None, :] / far[:, None, None] ** 5 - np.eye(3) / far[:, None, None] ** 3)
            if perturber and k == len(bodies) - 1:
                by_gm = unit
        out = np.empty_like(y)
        out[:, :3] = y[:, 3:]
        out[:, 3:, 0] = pull
        out[:, 3:, 1:] = tide @ y[:, :3, 1:]
        out[:, 3:, 7] += by_gm
        return out

    y = np.zeros((n, 6, 8))
    y[:, :, 0], y[:, :, 1:7] = state, np.eye(6)
    t = start_jd
    for _ in range(steps):
        a = slope(t, y)
        b = slope(t + h / 2, y + h / 2 * a)
        c = slope(t + h / 2, y + h / 2 * b)
        d = slope(t + h, y + h * c)
        y, t = y + h / 6 * (a + 2 * b + 2 * c + d), t + h
    return y[:, :, 0], y[:, :, 1:7], y[:, :, 7]
