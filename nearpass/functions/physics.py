"""Sizes, deflections, magnitudes, observability and frames as Column expressions.

Missing input gives null; NaN never comes out of a null.
"""

from __future__ import annotations

from math import cos, pi, radians, sin, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
AU_KM = 149597870.7
DAY_S = 86400.0
NEWTON_G = 6.674e-11
DEFAULT_ALBEDO = 0.14
ZONE_EDGES_AU = (2.5, 2.82)
ZONE_ALBEDO = (0.20, 0.13, 0.06)
ZONE_DENSITY = (2700.0, 2000.0, 1300.0)
PHASE_DEG = 20.0
SLOPE = 0.15
MIN_ELONGATION_DEG = 45.0
FAINTEST_MAG = 21.0
RAD_TO_MUAS = 2.06265e11
OBLIQUITY_DEG = 23.4392911


def clean(x: Column) -> Column:
    """NaN to null."""
    return F.when(~F.isnan(x), x)


def au_to_km(d: Column) -> Column:
    return d * AU_KM


def au_day_to_km_s(v: Column) -> Column:
    return v * (AU_KM / DAY_S)


def diameter_from_h(h: Column, albedo: Column | float = DEFAULT_ALBEDO) -> Column:
    albedo = F.lit(albedo) if isinstance(albedo, float) else albedo
    return F.lit(1329.0) / F.sqrt(albedo) * F.pow(F.lit(10.0), -h / 5.0)


def by_zone(a_au: Column, values: tuple[float, float, float]) -> Column:
    inner, outer = ZONE_EDGES_AU
    return F.when(a_au < inner, values[0]).when(a_au < outer, values[1]).when(a_au.isNotNull(), values[2])


def diameter(h: Column, a_au: Column, measured_km: Column, measured_albedo: Column) -> tuple[Column, Column]:
    """Diameter and its source: measured, measured albedo, zone albedo, default albedo, unknown."""
    has_d, has_p, has_h, has_a = measured_km > 0, measured_albedo > 0, h.isNotNull(), a_au.isNotNull()
    size = (
        F.when(has_d, measured_km)
        .when(has_p & has_h, diameter_from_h(h, measured_albedo))
        .when(has_h & has_a, diameter_from_h(h, by_zone(a_au, ZONE_ALBEDO)))
        .when(has_h, diameter_from_h(h))
    )
    source = F.when(has_d, "measured").when(has_p & has_h, "albedo_measured").when(has_h & has_a, "zone_albedo").when(has_h, "default_albedo").otherwise("unknown")
    return size, source


def deflection_dv(diameter_km: Column, dist_au: Column, vel_au_day: Column, a_au: Column) -> Column:
    """2GM/(b v) in m/s with a density by zone (the middle one where ``a`` is unknown)."""
    density = F.coalesce(by_zone(a_au, ZONE_DENSITY), F.lit(ZONE_DENSITY[1]))
    gm = NEWTON_G * pi / 6.0 * density * F.pow(diameter_km * 1000.0, 3)
    b, v = dist_au * (AU_KM * 1000.0), vel_au_day * (AU_KM * 1000.0 / DAY_S)
    return F.when((dist_au > 0) & (vel_au_day > 0), 2.0 * gm / (b * v))


def earth_xyz(jd: Column) -> dict[str, Column]:
    """Heliocentric ecliptic position of the Earth from the mean solar theory (about 0.01 degree)."""
    n = jd - 2451545.0
    g = F.radians(F.pmod(357.528 + 0.9856003 * n, F.lit(360.0)))
    lon = F.radians(F.pmod(280.460 + 0.9856474 * n, F.lit(360.0)) + 1.915 * F.sin(g) + 0.020 * F.sin(2.0 * g))
    r = 1.00014 - 0.01671 * F.cos(g) - 0.00014 * F.cos(2.0 * g)
    return {"x": -r * F.cos(lon), "y": -r * F.sin(lon), "z": F.lit(0.0)}


def dot(p: dict[str, Column], q: dict[str, Column]) -> Column:
    return p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"]


def minus(p: dict[str, Column], q: dict[str, Column]) -> dict[str, Column]:
    return {k: p[k] - q[k] for k in p}


def norm(p: dict[str, Column]) -> Column:
    return F.sqrt(dot(p, p))


def elongation_deg(body: dict[str, Column], earth: dict[str, Column]) -> Column:
    """Angle between the body and the Sun as seen from the Earth."""
    to_body = minus(body, earth)
    to_sun = {k: -v for k, v in earth.items()}
    length = norm(to_body) * norm(to_sun)
    return F.when(length > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(to_body, to_sun) / length)))))


def apparent_mag(h: Column, r_au: Column, delta_au: Column, slope: float = SLOPE, phase_deg: float = PHASE_DEG) -> Column:
    """H-G magnitude at a fixed phase angle."""
    from math import exp, log10, tan

    half = tan(radians(phase_deg) / 2.0)
    phase = (1 - slope) * exp(-3.33 * half**0.63) + slope * exp(-1.87 * half**1.22)
    return F.when((r_au > 0) & (delta_au > 0), h + 5.0 * F.log10(r_au * delta_au) - 2.5 * log10(phase))


def observable(elongation: Column, mag: Column) -> Column:
    return F.coalesce((elongation > MIN_ELONGATION_DEG) & (mag < FAINTEST_MAG), F.lit(False))


def deflection_score(diameter_km: Column, dist_au: Column, vel_au_day: Column) -> Column:
    return F.when((dist_au > 0) & (vel_au_day > 0), F.pow(diameter_km, 3) / (dist_au * vel_au_day * vel_au_day))


def deflection_muas(mass_kg: Column, vel_m_s: Column, impact_m: Column) -> Column:
    ok = (mass_kg > 0) & (vel_m_s > 0) & (impact_m > 0)
    return F.when(ok, 2.0 * NEWTON_G * mass_kg / (vel_m_s * vel_m_s * impact_m) * RAD_TO_MUAS)


def mass_from_diameter(diameter_km: Column, density: float = 1500.0) -> Column:
    return F.when(diameter_km > 0, density * pi / 6.0 * F.pow(diameter_km * 1000.0, 3))


def bulk_density_g_cm3(mass_kg: Column, diameter_km: Column) -> Column:
    return F.when((mass_kg > 0) & (diameter_km > 0), mass_kg / (pi / 6.0 * F.pow(diameter_km * 1000.0, 3)) / 1000.0)


def density_gate(density: Column, low: float = 0.8, high: float = 4.5) -> Column:
    """``PASS`` for a plausible density in g/cm3 (bounds excluded), ``SKIP`` for none."""
    return F.when(density.isNull() | F.isnan(density), "SKIP").when((density > low) & (density < high), "PASS").otherwise("FAIL")


def implied_mass_kg(shift_rad: Column, vel_m_s: Column, impact_m: Column, days: float = 90.0, distance_au: float = 2.5) -> Column:
    ok = (vel_m_s > 0) & (impact_m > 0)
    return F.when(ok, shift_rad * vel_m_s * impact_m * (distance_au * AU_KM * 1000.0) / (2.0 * NEWTON_G * days * DAY_S))


def ecliptic_to_equatorial(p: dict[str, Column], obliquity_deg: float = OBLIQUITY_DEG) -> dict[str, Column]:
    c, s = cos(radians(obliquity_deg)), sin(radians(obliquity_deg))
    return {"x": p["x"], "y": c * p["y"] - s * p["z"], "z": s * p["y"] + c * p["z"]}


def equatorial_to_ecliptic(p: dict[str, Column], obliquity_deg: float = OBLIQUITY_DEG) -> dict[str, Column]:
    return ecliptic_to_equatorial(p, -obliquity_deg)


def ra_dec_deg(p: dict[str, Column]) -> tuple[Column, Column]:
    ra = F.pmod(F.degrees(F.atan2(p["y"], p["x"])), F.lit(360.0))
    return ra, F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p["z"] / norm(p)))))


def tangent_residual_mas(ra_obs: Column, dec_obs: Column, ra: Column, dec: Column) -> tuple[Column, Column]:
    turn = F.pmod(ra_obs - ra + 540.0, F.lit(360.0)) - 180.0
    return turn * F.cos(F.radians(dec)) * 3.6e6, (dec_obs - dec) * 3.6e6


def along_scan(east: Column, north: Column, angle_deg: Column) -> Column:
    """Component along a scan at a position angle from north through east."""
    return east * F.sin(F.radians(angle_deg)) + north * F.cos(F.radians(angle_deg))


def along_scan_variance(s_ra: Column, s_dec: Column, rho: Column, angle_deg: Column, floor: float = 1e-6) -> Column:
    s, c = F.sin(F.radians(angle_deg)), F.cos(F.radians(angle_deg))
    bounded = F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), rho))
    return F.greatest(F.lit(floor), s * s * s_ra * s_ra + c * c * s_dec * s_dec + 2.0 * s * c * bounded * s_ra * s_dec)


def mahalanobis2(dx: Column, dy: Column, vxx: Column, vyy: Column, vxy: Column, floor: float = 1e-12) -> Column:
    det = F.greatest(vxx * vyy - vxy * vxy, F.lit(floor))
    return (vyy * dx * dx - 2.0 * vxy * dx * dy + vxx * dy * dy) / det


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of k successes in n; null for n = 0."""
    p, nn = k / F.nullif(n.cast("double"), F.lit(0.0)), n.cast("double")
    centre = (p + z * z / (2.0 * nn)) / (1.0 + z * z / nn)
    half = z * F.sqrt(p * (1.0 - p) / nn + z * z / (4.0 * nn * nn)) / (1.0 + z * z / nn)
    some = n > 0
    return F.when(some, centre - half), F.when(some, centre + half)


def z_score(value: Column, reference: Column, sigma: Column, reference_sigma: Column) -> Column:
    spread = F.sqrt(sigma * sigma + reference_sigma * reference_sigma)
    return F.when(spread > 0, (value - reference) / spread)


def rotate(p: dict[str, Column], axis: str, angle_deg: float) -> dict[str, Column]:
    """Rotation of coordinates about x, y or z."""
    c, s = cos(radians(angle_deg)), sin(radians(angle_deg))
    a, b = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}[axis]
    return {**p, a: c * p[a] + s * p[b], b: -s * p[a] + c * p[b]}


def upper_root(vxx: Column, vyy: Column, vxy: Column) -> tuple[Column, Column, Column]:
    """Upper Cholesky factor of a 2x2 covariance."""
    c = F.sqrt(vyy)
    b = vxy / c
    return F.sqrt(F.greatest(vxx - b * b, F.lit(0.0))), b, c


SQRT2 = sqrt(2.0)
