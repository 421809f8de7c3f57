"""Checks of a catalogue: recall of filters by band, missed pairs, scaling of counts, planted encounters, long baselines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearpass.functions.kepler import elements_to_state, positions, state_to_elements
from nearpass.functions.physics import AU_KM, DAY_S, wilson
from nearpass.operators.hybrid import quantiles
from nearpass.session import shuffle_partitions

ORBIT = ["a_au", "ecc", "i_deg", "node_deg", "argperi_deg", "mean_anomaly_deg", "epoch_jd"]


def recall_by_band(pairs: DataFrame, dist: str, kept: Column, edges: list[float]) -> DataFrame:
    """``band, low, high, n, kept, recall, ci_low, ci_high`` over right-open distance bands; empty bands are left out."""
    band = F.lit(None).cast("int")
    for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        band = F.when((F.col(dist) >= low) & (F.col(dist) < high), F.lit(k)).otherwise(band)
    bounds = F.array(*[F.lit(float(e)) for e in edges])
    counted = pairs.withColumn("band", band).where("band IS NOT NULL").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("kept"))
    low, high = wilson(F.col("kept"), F.col("n"))
    return counted.select("band", bounds[F.col("band")].alias("low"), bounds[F.col("band") + 1].alias("high"), "n", "kept", (F.col("kept") / F.col("n")).alias("recall"), low.alias("ci_low"), high.alias("ci_high"))


def missed_pairs(pairs: DataFrame, max_da: float, max_di: float) -> DataFrame:
    """One row: how many pairs (``da, di, e_max, i_max``) a filter loses and why, and which orbits they have."""
    missed = pairs.where((F.col("da") > max_da) | (F.col("di") > max_di))
    over_da, over_di = F.col("da") > max_da, F.col("di") > max_di
    counts = missed.agg(
        F.count(F.lit(1)).alias("missed"), F.count_if(over_da).alias("over_da"), F.count_if(over_di).alias("over_di"), F.count_if(over_da & over_di).alias("both"),
        F.min("e_max").alias("e_low"), F.max("e_max").alias("e_high"), F.min("i_max").alias("i_low"), F.max("i_max").alias("i_high"),
    )
    return counts.withColumns({f"{c}_mid": quantiles(missed, f"{c}_max", {"mid": 0.5}).select("mid").scalar() for c in "ei"})


def square_scaling(sample_count: Column, sample_bodies: Column, all_count: Column, all_bodies: Column, tol: float) -> dict[str, Column]:
    """Whether a sample's count grown with the square of the bodies meets the whole's within ``tol``."""
    predicted = sample_count * F.pow(all_bodies / sample_bodies, 2)
    error = F.abs(predicted - all_count) / F.nullif(all_count.cast("double"), F.lit(0.0))
    return {"predicted": predicted, "rel_err": error, "ok": F.coalesce(error <= tol, F.lit(False))}


def planted_pairs(elements: DataFrame, ident: str, start_jd: float, end_jd: float, seed: int = 0, max_dist: float = 0.045, max_vel_km_s: float = 10.0) -> DataFrame:
    """A made-up partner for every body, passing it at a known time and distance.

    ``pair_id, planted_jd, planted_au`` and both orbits (``_i`` the body's, ``_j`` the partner's). The partner
    is set off at right angles to its relative speed, so the planted place is the closest. Partners that would not be
    bound inner orbits (e below 0.9, a of 1.2 to 5) are left out. Numbers come from a hash of body and seed.
    """
    u = lambda k: (F.pmod(F.xxhash64(F.col(ident), F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    drawn = elements.select(F.col(ident).cast("bigint").alias("pair_id"), *ORBIT, *[u(k).alias(f"u{k}") for k in range(7)]).dropna()

    def plant(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            r = f[[f"u{k}" for k in range(7)]].to_numpy(float)
            when = start_jd + (end_jd - start_jd) * (0.05 + 0.9 * r[:, 0])
            one = elements_to_state(*[f[c].to_numpy(float) for c in ORBIT], when)
            turn, rise = 2 * np.pi * r[:, 1], 2 * r[:, 2] - 1
            flat = np.sqrt(1 - rise**2)
            along = np.stack([flat * np.cos(turn), flat * np.sin(turn), rise], 1)
            speed = np.exp(np.log(0.5) + (np.log(max_vel_km_s) - np.log(0.5)) * r[:, 3]) * DAY_S / AU_KM
            off = np.stack([np.cos(2 * np.pi * r[:, 4]), np.sin(2 * np.pi * r[:, 4]), r[:, 5]], 1)
            off -= (off * along).sum(1, keepdims=True) * along
            off /= np.linalg.norm(off, axis=1, keepdims=True)
            dist = np.exp(np.log(1e-4) + (np.log(max_dist) - np.log(1e-4)) * r[:, 6])
            two = np.concatenate([one[:, :3] + dist[:, None] * off, one[:, 3:] + speed[:, None] * along], 1)
            with np.errstate(invalid="ignore", divide="ignore"):
                other = state_to_elements(two, 0.0)
            other["epoch_jd"] = when
            out = pd.DataFrame({"pair_id": f["pair_id"].to_numpy(), "planted_jd": when, "planted_au": dist, **{f"{c}_i": f[c].to_numpy(float) for c in ORBIT}, **{f"{c}_j": other[c] for c in ORBIT}})
            yield out[(out["a_au_j"] > 1.2) & (out["a_au_j"] < 5.0) & (out["ecc_j"] < 0.9)]

    orbits = ", ".join(f"{c}_{s} double" for s in "ij" for c in ORBIT)
    return drawn.mapInPandas(plant, f"pair_id bigint, planted_jd double, planted_au double, {orbits}")


def closest_approach(pairs: DataFrame, start_jd: float, end_jd: float, coarse_days: float = 1.0, fine_days: float = 1.0 / 24, window: tuple[float, float] | None = None) -> DataFrame:
    """``pair_id, t_min_jd, dist_au``: where two orbits (``_i``, ``_j``) come closest over a long time.

    A coarse grid first, then fine steps about its lowest point and a parabola through the lowest of those. ``window``
    adds ``in_window``, whether that time falls into it. Pairs meet nobody else: only their own two places are made.
    """
    n = max(1, int(np.floor((end_jd - start_jd) / coarse_days + 1e-9)) + 1)
    grid = start_jd + np.arange(n) * coarse_days
    around = np.arange(-coarse_days, coarse_days + fine_days / 2, fine_days)

    def gap(f: pd.DataFrame, t: np.ndarray) -> np.ndarray:
        places = [positions(*[f[f"{c}_{s}"].to_numpy(float)[:, None] for c in ORBIT], t) for s in "ij"]
        return np.sqrt(((places[0] - places[1]) ** 2).sum(-1))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            size = max(1, 500_000 // n)
            for k in range(0, len(frame), size):
                f = frame.iloc[k : k + size]
                lowest = grid[gap(f, grid[None, :]).argmin(1)]
                t = np.clip(lowest[:, None] + around, start_jd, end_jd)
                d = gap(f, t)
                at = np.clip(d.argmin(1), 1, t.shape[1] - 2)
                rows = np.arange(len(f))
                t1, h = t[rows, at], fine_days
                # the squared distance of two nearly straight paths is a parabola in time
                d0, d1, d2 = (d[rows, at + k] ** 2 for k in (-1, 0, 1))
                bend = d0 - 2 * d1 + d2
                shift = np.clip(np.where(bend > 0, 0.5 * (d0 - d2) / np.where(bend > 0, bend, 1.0), 0.0), -1, 1)
                best = np.clip(t1 + shift * h, start_jd, end_jd)
                yield pd.DataFrame({"pair_id": f["pair_id"].to_numpy(), "t_min_jd": best, "dist_au": gap(f, best[:, None])[:, 0]})

    usable = pairs.dropna(subset=[f"{c}_{s}" for s in "ij" for c in ORBIT])
    found = usable.repartition(shuffle_partitions(pairs.sparkSession), "pair_id").mapInPandas(run, "pair_id bigint, t_min_jd double, dist_au double")
    return found if window is None else found.withColumn("in_window", F.col("t_min_jd").between(*window))


def common_epochs(one: DataFrame, two: DataFrame, time: str, value: str) -> DataFrame:
    """One row ``common, at, gap``: instants both series have, and where their values are closest."""
    both = one.select(time, F.col(value).alias("_a")).join(two.select(time, F.col(value).alias("_b")), time)
    gap = F.abs(F.col("_a") - F.col("_b"))
    return both.agg(F.count(F.lit(1)).alias("common"), F.min(F.struct(gap.alias("gap"), F.col(time).alias("at"))).alias("m")).select("common", "m.at", "m.gap")


def against_reference(masses: DataFrame, reference: DataFrame, key: str = "number") -> DataFrame:
    """Masses (``key, mass, sigma``) beside a reference list's: ratio, relative error and z."""
    ref = reference.select(key, F.col("mass").alias("ref_mass"), F.col("sigma").alias("ref_sigma"))
    spread = F.sqrt(F.col("sigma") * F.col("sigma") + F.col("ref_sigma") * F.col("ref_sigma"))
    both = masses.join(ref, key)
    return both.select(key, "mass", "ref_mass", (F.col("mass") / F.col("ref_mass")).alias("ratio"), F.when(spread > 0, (F.col("mass") - F.col("ref_mass")) / spread).alias("z"))
