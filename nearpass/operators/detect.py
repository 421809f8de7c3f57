"""From elements to encounters: time grid, propagation, scan, minimum per pair, refinement."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpass.functions.kepler import GAUSS_K, HIGH_ECC, positions, tracks
from nearpass.functions.physics import AU_KM, DAY_S
from nearpass.operators.spatial import min_per_pair, rows_within
from nearpass.session import is_small, shuffle_partitions

ORBIT = ["a_au", "ecc", "i_deg", "node_deg", "argperi_deg", "mean_anomaly_deg", "epoch_jd"]
RECENTRES = 4
#: Sectors of longitude that a scan is cut into; more than two.
SECTORS = 12
#: Places searched and pairs followed at a time, and rows of pairs at which minima are taken in between.
SCAN_ROWS, PAIR_ROWS, FOUND_ROWS = 50_000, 100_000, 2_000_000
#: Coarse steps told from one search, and how much wider its radius may become for that.
STRIDE, WIDEST = 16, 2.0


@dataclass(frozen=True)
class DetectRules:
    """Distances in AU, steps in days; ``refine`` off keeps coarse rows within the query radius.

    ``v_max_km_s`` bounds the relative speeds for which no pair is lost between coarse steps; 0 is for
    queries about the coarse steps themselves.
    """

    threshold_au: float = 0.05
    coarse_days: float = 0.5
    fine_days: float = 120.0 / 86400.0
    window_days: float = 0.25
    v_max_km_s: float = 25.0
    max_da: float | None = None
    max_di: float | None = None
    radial: bool = False
    refine: bool = True
    keep_wide: bool = False
    block_steps: int = 64
    decimals: int | None = None

    def query_radius(self) -> float:
        """The threshold, widened by what a pair can move in a step where coarse steps are used."""
        if self.coarse_days <= self.fine_days:
            return self.threshold_au
        return self.threshold_au + self.v_max_km_s * DAY_S / AU_KM * self.coarse_days

    def check(self) -> None:
        if self.refine and self.window_days < self.coarse_days / 2:
            raise ValueError("the refinement window must cover half a coarse step")


def time_grid(spark: SparkSession, start_jd: float, end_jd: float, step_days: float) -> DataFrame:
    """``step_idx, t_jd`` from start to end, the end inclusive within half a step."""
    n = max(0, int(np.ceil((end_jd + 0.5 * step_days - start_jd) / step_days - 1e-9)))
    return spark.range(n).select(F.col("id").alias("step_idx"), (F.lit(start_jd) + F.col("id") * F.lit(step_days)).alias("t_jd"))


def snapshot_for_window(snapshots: DataFrame, start_jd: float, end_jd: float, path: str = "path", epoch: str = "epoch_jd") -> DataFrame:
    """The dated snapshot whose epoch is nearest to the middle of a window (one row)."""
    gap = F.abs(F.col(epoch) - (start_jd + end_jd) / 2)
    dated = snapshots.where(F.col(epoch).isNotNull() & ~F.isnan(epoch))
    return dated.agg(F.min(F.struct(gap.alias("gap"), F.col(epoch).alias(epoch), F.col(path).alias(path))).alias("m")).where("m IS NOT NULL").select(f"m.{path}", f"m.{epoch}")


def usable_elements(elements: DataFrame, a_min: float = 0.0, a_max: float = float("inf"), only_numbered: bool = True) -> DataFrame:
    out = elements.where(F.col("a_au").between(a_min, a_max) & (F.col("a_au") > 0) & F.col("ecc").between(0, 0.999999))
    return out.where(F.col("number").isNotNull()) if only_numbered else out


def propagate(elements: DataFrame, ident: str, start_jd: float, end_jd: float, step_days: float, decimals: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """``ident, step_idx, t_jd, x, y, z`` and the elements to ``carry``: every body at every step, in NumPy over Arrow batches.

    Steps are made where the body is, so a row of elements is shuffled, not its trajectory.
    """
    carry = carry or []
    n = max(0, int(np.ceil((end_jd + 0.5 * step_days - start_jd) / step_days - 1e-9)))
    t = start_jd + np.arange(n) * step_days

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            size = max(1, 200_000 // max(n, 1))
            for k in range(0, len(frame), size):
                part = frame.iloc[k : k + size]
                args = [part[c].to_numpy(float)[:, None] for c in ORBIT]
                xyz = positions(*args, t[None, :]).reshape(-1, 3)
                xyz = xyz if decimals is None else np.round(xyz, decimals)
                yield pd.DataFrame({ident: np.repeat(part[ident].to_numpy(), n), "step_idx": np.tile(np.arange(n), len(part)), "t_jd": np.tile(t, len(part)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], **{c: np.repeat(part[c].to_numpy(float), n) for c in carry}})

    schema = ", ".join([f"{ident} bigint, step_idx bigint, t_jd double, x double, y double, z double", *[f"{c} double" for c in carry]])
    return elements.select(F.col(ident).cast("bigint").alias(ident), *ORBIT).dropna().mapInPandas(run, schema)


def sectors_met(orbits: list[np.ndarray], start_jd: float, end_jd: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """First sector of ecliptic longitude and number of sectors in which bodies, or places within ``reach`` of them, stand from start to end.

    Longitude runs one way along an orbit, so its two ends tell the range; where they may not, all sectors count.
    """
    a, ecc, tilt = orbits[0], orbits[1], np.cos(np.radians(orbits[2]))
    width = 2 * np.pi / SECTORS
    with np.errstate(all="ignore"):
        ends = positions(*[c[:, None] for c in orbits], np.array([start_jd, end_jd]))
        lon = np.arctan2(ends[..., 1], ends[..., 0])
        rho = a * (1.0 - ecc) * np.abs(tilt)
        side = np.arcsin(reach / rho) + 1e-6
        low = np.where(tilt > 0, lon[:, 0], lon[:, 1]) - side
        high = low + np.mod(np.sign(tilt) * (lon[:, 1] - lon[:, 0]), 2 * np.pi) + 2 * side
        first = np.floor(low / width)
        many = np.floor(high / width) - first + 1
        plain = (ecc <= 0.999999) & (rho > 1.001 * reach) & (end_jd - start_jd < 0.999 * 2 * np.pi / GAUSS_K * a**1.5) & (many < SECTORS)
    return np.where(plain, first, 0).astype(int) % SECTORS, np.where(plain, many, SECTORS).astype(int)


def _whole_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``part``, one part at a time."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        for part, rows in frame.groupby("part"):
            if held and held[0]["part"].iloc[0] != part:
                yield pd.concat(held)
                held = []
            held.append(rows)
    if held:
        yield pd.concat(held)


def _least(key: np.ndarray, dist: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once with its smallest distance and the first step of it."""
    order = np.argsort(key)
    key, dist, step = key[order], dist[order], step[order]
    heads = np.flatnonzero(np.diff(key, prepend=-1))
    if not len(heads):
        return key, dist, step
    low = np.minimum.reduceat(dist, heads)
    first = np.where(dist == np.repeat(low, np.diff(heads, append=len(key))), step, np.iinfo(step.dtype).max)
    return key[heads], low, np.minimum.reduceat(first, heads)


def _close_steps(orbits: list[np.ndarray], t: np.ndarray, first: np.ndarray, stride: int, last: int, edges: np.ndarray, radius: float, slack: float, rank: np.ndarray) -> list[tuple[np.ndarray, ...]] | None:
    """``i, j, dist, error, step`` of pairs in runs of ``stride`` steps from ``first``: the steps that may be their closest in the run.

    Places are searched once a run, at its middle, as far as a pair that is near at one of its steps can stand apart
    there; None if that is too far. ``dist`` follows from place, speed and pull in the middle and is true within ``error``.
    The smaller body by ``rank`` stands in the sector, or may at some step of the run.
    """
    a, ecc = orbits[:2]
    size, days = len(a), (t[1] - t[0] if len(t) > 1 else 0.0)
    half = (stride - 1) / 2 * days
    reach = radius + slack
    with np.errstate(all="ignore"):
        xyz = tracks(orbits, t[first] + half, stride > 1).reshape(len(first) * size, -1)
        peri = a * (1.0 - ecc)
        speed = GAUSS_K * np.sqrt((1.0 + ecc) / peri) if stride > 1 else np.zeros(size)  # the most on the orbit, as the next two
        pull, wobble = ((GAUSS_K / peri) ** 2, 2.0 * GAUSS_K**2 * speed / peri**3) if stride > 1 else (speed, speed)
        drift = np.tile(speed * half, len(first))
        before, after = (xyz[:, 1] * np.cos(e) - xyz[:, 0] * np.sin(e) for e in edges)
        at = np.flatnonzero((before >= -reach - drift - 1e-6) & (after <= reach + drift + 1e-6) & np.isfinite(xyz[:, :3]).all(1))
    if not len(at):
        return []
    group, body = at // size, at % size
    home = ((before >= -drift) & (after <= drift))[at]
    x = [np.ascontiguousarray(xyz[at, k]) for k in range(3)]
    steps = np.arange(stride)[:, None]
    if stride > 1:
        v = [np.ascontiguousarray(xyz[at, k]) for k in range(3, 6)]
        rho = np.hypot(x[0], x[1])
        inner = rho.min() - reach - 2.0 * speed.max() * half  # no place between a pair is nearer to the axis
        if inner <= 0:
            return None
        turn, shear = GAUSS_K * rho**-1.5, 1.0 - half * GAUSS_K * inner**-1.5
        own = np.sqrt((v[0] + turn * x[1]) ** 2 + (v[1] - turn * x[0]) ** 2 + v[2] ** 2)  # against circular motion, in which neighbours stay
        own = (0.5 * reach + half * (own + 0.5 * half * pull.max())) / shear + 1e-6
        if not (shear > 0 and 2.0 * own.max() <= WIDEST * reach):
            return None
        fall = -0.5 * GAUSS_K**2 * (x[0] ** 2 + x[1] ** 2 + x[2] ** 2) ** -1.5
        pulls = [c * fall for c in x]
        tau = steps * days - half
        p, q, dist = rows_within(group, *x, 2.0 * own.max())
        ok = np.flatnonzero(dist <= own[p] + own[q])
        p, q, dist = p[ok], q[ok], dist[ok]
    else:
        p, q, dist = rows_within(group, *x, reach)
    out = []
    for k in range(0, len(p), PAIR_ROWS):
        m, n, d = (c[k : k + PAIR_ROWS] for c in (p, q, dist))
        same = np.zeros(len(m), bool)
        if stride > 1:
            gap, pace = ([c[m] - c[n] for c in s] for s in (x, v))
            dots = lambda s, u: s[0] * u[0] + s[1] * u[1] + s[2] * u[2]
            xv, vv = dots(gap, pace), dots(pace, pace)
            when = np.clip(-xv / (vv + 1e-300), -half, half)
            ok = np.flatnonzero(d * d + when * (2.0 * xv + when * vv) <= (reach + half * half * pull.max()) ** 2)
            m, n, d, xv, vv, gap, pace = m[ok], n[ok], d[ok], xv[ok], vv[ok], [c[ok] for c in gap], [c[ok] for c in pace]
            bend = [c[m] - c[n] for c in pulls]
            same = (d == 0) & (vv == 0)
            d = (((dots(bend, bend) * tau + 2.0 * dots(pace, bend)) * tau + vv + 2.0 * dots(gap, bend)) * tau + 2.0 * xv) * tau + d * d
            d = np.sqrt(np.maximum(d, 0.0))
        else:
            d = d[None].copy()
        swap = rank[body[m]] > rank[body[n]]
        m, n = np.where(swap, n, m), np.where(swap, m, n)
        i, j = body[m], body[n]
        error = (wobble[i] + wobble[j]) * (half**3 / 6.0) + slack
        d[first[group[m]] + steps >= last] = np.inf
        near = (d <= np.minimum(d.min(0) + 2.0 * error, radius + error)) & home[m] & (rank[i] != rank[j])
        near[1:, same] = False  # one orbit: its first step tells all
        step, row = np.nonzero(near)
        out.append((i[row], j[row], d[step, row], error[row], first[group[m[row]]] + step))
    return out


def _scan_part(rows: pd.DataFrame, ident: str, t: np.ndarray, per_part: int, rules: DetectRules) -> Iterator[pd.DataFrame]:
    """Smallest coarse distance of each pair in one part: some steps of one sector. A pair is met where its smaller id stands,
    in both parts while that one passes from one to the other.
    """
    block, sector = divmod(int(rows["part"].iloc[0]), SECTORS)
    orbits = [rows[c].to_numpy(float) for c in ORBIT]
    names, code = np.unique(rows[ident].to_numpy(), return_inverse=True)
    a, ecc, i_deg = orbits[:3]
    edges = 2 * np.pi / SECTORS * np.array([sector, (sector + 1) % SECTORS])
    radius, size = rules.query_radius(), len(rows)
    slack = 1e-8 + (0.0 if rules.decimals is None else 2.0 * 10.0 ** (1 - rules.decimals))
    last = min(len(t), (block + 1) * per_part)
    maybe: list[tuple[np.ndarray, ...]] = []
    found: list[tuple[np.ndarray, ...]] = []

    def pairs(key: np.ndarray, dist: np.ndarray, step: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"idx_i": names[key // len(names)], "idx_j": names[key % len(names)], "t_coarse_jd": t[step], "d_coarse_au": dist})

    def settle() -> None:
        """Distances of the steps that may be a pair's closest, from the places themselves."""
        i, j, dist, error, step = (np.concatenate(c) for c in zip(*maybe, strict=True))
        maybe.clear()
        key = code[i].astype(np.int64) * len(names) + code[j]
        order = np.argsort(key)
        heads = np.flatnonzero(np.diff(key[order], prepend=-1))
        if len(heads):
            most = np.minimum.reduceat((dist + error)[order], heads)
            order = order[(dist - error)[order] <= np.repeat(most, np.diff(heads, append=len(key)))]
        for k in range(0, len(order), SCAN_ROWS):
            at = order[k : k + SCAN_ROWS]
            with np.errstate(all="ignore"):
                here, there = (positions(*[c[s[at]] for c in orbits], t[step[at]]) for s in (i, j))
            if rules.decimals is not None:
                here, there = np.round(here, rules.decimals), np.round(there, rules.decimals)
            x, y, z = (here - there).T
            exact = np.sqrt(x * x + y * y + z * z)
            at, exact = at[exact <= radius], exact[exact <= radius]
            if rules.decimals:
                exact = np.floor(exact * 10.0 ** (rules.decimals - 1) + 0.5) / 10.0 ** (rules.decimals - 1)
            found.append((key[at], exact, step[at]))
        if found:
            found[:] = [_least(*(np.concatenate(c) for c in zip(*found, strict=True)))]

    k, stride = block * per_part, STRIDE if ((a > 0) & (ecc >= 0) & (ecc < HIGH_ECC)).all() else 1
    while k < last:
        first = np.arange(k, last, stride)[: max(1, SCAN_ROWS // size)]
        near = _close_steps(orbits, t, first, stride, last, edges, radius, slack, code)
        if near is None:
            stride //= 2
            continue
        k = first[-1] + stride
        for part in near:
            i, j = part[:2]
            keep = np.ones(len(i), bool)
            if rules.max_da is not None:
                keep &= (np.abs(a[i] - a[j]) <= rules.max_da) & (np.abs(i_deg[i] - i_deg[j]) <= (rules.max_di or 180.0))
            if rules.radial:
                keep &= (a[i] * (1 - ecc[i]) - rules.threshold_au <= a[j] * (1 + ecc[j])) & (a[j] * (1 - ecc[j]) - rules.threshold_au <= a[i] * (1 + ecc[i]))
            maybe.append(tuple(c[keep] for c in part))
            if sum(len(m[0]) for m in maybe) > FOUND_ROWS:
                settle()
                if found and len(found[0][0]) > FOUND_ROWS // 2:  # minima so far; the rest of the pair's come later
                    yield pairs(*found.pop())
    if maybe:
        settle()
    if found:
        yield pairs(*found[0])


def scan(elements: DataFrame, ident: str, start_jd: float, end_jd: float, rules: DetectRules) -> DataFrame:
    """Candidates ``idx_i, idx_j, t_coarse_jd, d_coarse_au``: closest coarse step of each pair within the query radius.

    Bodies go to the parts, some steps of one sector of longitude, that they or places within the radius of them
    reach; a part makes its own trajectories and sends on one row a pair. The orbital filters (``max_da`` with
    ``max_di``, ``radial``) are applied there, before the minimum.
    """
    n = max(0, int(np.ceil((end_jd + 0.5 * rules.coarse_days - start_jd) / rules.coarse_days - 1e-9)))
    t = start_jd + np.arange(n) * rules.coarse_days
    per_part = max(1, min(128, int(64.0 / rules.coarse_days)))
    parts = -(-n // per_part) * SECTORS
    radius = rules.query_radius()

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            orbits = [frame[c].to_numpy(float) for c in ORBIT]
            for block, k in enumerate(range(0, n, per_part)):
                first, many = sectors_met(orbits, t[k], t[min(n, k + per_part) - 1], radius)
                rows = np.repeat(np.arange(len(frame)), many)
                turn = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
                yield frame.iloc[rows].assign(part=block * SECTORS + (first[rows] + turn) % SECTORS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_parts(frames):
            yield from _scan_part(rows, ident, t, per_part, rules)

    spread = shuffle_partitions(elements.sparkSession)
    bodies = elements.select(F.col(ident).cast("bigint").alias(ident), *[F.col(c).cast("double").alias(c) for c in ORBIT]).dropna().repartition(spread, ident)
    dealt = bodies.mapInPandas(deal, ", ".join([f"{ident} bigint", *[f"{c} double" for c in ORBIT], "part int"]))
    near = dealt.repartition(max(1, min(parts, 8 * spread)), "part").sortWithinPartitions("part").mapInPandas(run, "idx_i bigint, idx_j bigint, t_coarse_jd double, d_coarse_au double")
    return min_per_pair(near, ["idx_i", "idx_j"], "d_coarse_au", "t_coarse_jd")


def three_steps(pairs: DataFrame, elements: DataFrame, ident: str, start_jd: float, end_jd: float, step_days: float, decimals: int = 9) -> DataFrame:
    """``idx_i, idx_j, t0..t2, d0..d2``: distances at a pair's closest step (``t_jd``) and the two beside it.

    Only these three places of both bodies are computed, where the pair is. Minima at an end of the grid are left out.
    """
    n = max(0, int(np.ceil((end_jd + 0.5 * step_days - start_jd) / step_days - 1e-9)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            mid = np.rint((frame["t_jd"].to_numpy(float) - start_jd) / step_days)
            frame, mid = frame[(mid >= 1) & (mid <= n - 2)], mid[(mid >= 1) & (mid <= n - 2)]
            t = start_jd + (mid[:, None] + np.array([-1, 0, 1])) * step_days
            places = [np.round(positions(*[frame[f"{c}_{s}"].to_numpy(float)[:, None] for c in ORBIT], t), decimals) for s in "ij"]
            d = np.round(np.sqrt(((places[0] - places[1]) ** 2).sum(-1)), decimals - 1)
            yield pd.DataFrame({"idx_i": frame["idx_i"], "idx_j": frame["idx_j"], **{f"t{k}": t[:, k] for k in range(3)}, **{f"d{k}": d[:, k] for k in range(3)}})

    schema = "idx_i bigint, idx_j bigint, t0 double, t1 double, t2 double, d0 double, d1 double, d2 double"
    return with_orbits(pairs, elements, ident).mapInPandas(run, schema)


def with_orbits(pairs: DataFrame, elements: DataFrame, ident: str) -> DataFrame:
    """Pairs with both bodies' orbit columns, suffixed ``_i`` and ``_j``."""
    bodies = elements.select(F.col(ident).cast("bigint").alias("_id"), *ORBIT)
    small = is_small(bodies)  # counted once for both sides
    for s in ("i", "j"):
        side = bodies.select(F.col("_id").alias(f"idx_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ORBIT])
        pairs = pairs.join(F.broadcast(side) if small else side, f"idx_{s}")
    return pairs


def vertex(t0: Column, t1: Column, t2: Column, d0: Column, d1: Column, d2: Column) -> tuple[Column, Column]:
    """Time and depth of the parabola through three equally spaced samples.

    The time stays within the samples and the depth never exceeds the smallest of them;
    flat or concave samples give the smallest sample itself.
    """
    h = t1 - t0
    bend = d0 - 2.0 * d1 + d2
    shift = 0.5 * (d0 - d2) / F.nullif(bend, F.lit(0.0))
    lowest = F.least(d0, d1, d2)
    at_lowest = F.when(d0 == lowest, t0).when(d1 == lowest, t1).otherwise(t2)
    t = F.when(bend > 0, F.least(t2, F.greatest(t0, t1 + shift * h))).otherwise(at_lowest)
    s = (t - t1) / h
    value = d1 + 0.5 * (d2 - d0) * s + 0.5 * bend * s * s
    return t, F.when(bend > 0, F.least(value, lowest)).otherwise(lowest)


def vertex_np(t: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """NumPy twin of ``vertex`` for ``(n, 3)`` samples of any spacing."""
    h1, h2 = t[:, 1] - t[:, 0], t[:, 2] - t[:, 1]
    s1, s2 = (d[:, 1] - d[:, 0]) / h1, (d[:, 2] - d[:, 1]) / h2
    bend = (s2 - s1) / (h1 + h2)
    ok = bend > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        at = np.clip(0.5 * (t[:, 0] + t[:, 1]) - 0.5 * s1 / bend, t[:, 0], t[:, 2])
        deep = d[:, 0] + s1 * (at - t[:, 0]) + bend * (at - t[:, 0]) * (at - t[:, 1])
    low = d.argmin(1)
    rows = np.arange(len(d))
    return np.where(ok, at, t[rows, low]), np.where(ok, np.minimum(deep, d[rows, low]), d[rows, low])


def _refine_batch(frame: pd.DataFrame, rules: DetectRules) -> pd.DataFrame:
    orbits = [[frame[f"{c}_{s}"].to_numpy(float) for c in ORBIT] for s in ("i", "j")]

    def gap(rows: np.ndarray, t: np.ndarray) -> np.ndarray:
        return positions(*[c[rows][:, None] for c in orbits[0]], t) - positions(*[c[rows][:, None] for c in orbits[1]], t)

    half = int(round(rules.window_days / rules.fine_days))
    if half < 1:
        return pd.DataFrame({"idx_i": frame["idx_i"], "idx_j": frame["idx_j"], "jd_tdb": frame["t_coarse_jd"], "dist_au": frame["d_coarse_au"], "rel_vel_au_day": np.nan})
    offsets = np.arange(-half, half + 1) * rules.fine_days
    centre = frame["t_coarse_jd"].to_numpy(float).copy()
    at, deep = centre.copy(), frame["d_coarse_au"].to_numpy(float).copy()
    todo = np.arange(len(frame))
    for turn in range(RECENTRES + 1):
        t = centre[todo][:, None] + offsets
        d = np.linalg.norm(gap(todo, t), axis=-1)
        k = d.argmin(1)
        inside = (k > 0) & (k < len(offsets) - 1)
        rows = np.flatnonzero(inside)
        if len(rows):
            pick = k[rows][:, None] + np.array([-1, 0, 1])
            at[todo[rows]], deep[todo[rows]] = vertex_np(np.take_along_axis(t[rows], pick, 1), np.take_along_axis(d[rows], pick, 1))
        edge = np.flatnonzero(~inside)
        at[todo[edge]], deep[todo[edge]] = t[edge, k[edge]], d[edge, k[edge]]
        centre[todo[edge]] = t[edge, k[edge]]
        todo = todo[edge]
        if not len(todo):
            break
    everyone = np.arange(len(frame))
    ends = gap(everyone, at[:, None] + np.array([-rules.fine_days, rules.fine_days]))
    speed = np.linalg.norm(ends[:, 1] - ends[:, 0], axis=-1) / (2 * rules.fine_days)
    return pd.DataFrame({"idx_i": frame["idx_i"], "idx_j": frame["idx_j"], "jd_tdb": at, "dist_au": deep, "rel_vel_au_day": speed})


def refine(candidates: DataFrame, elements: DataFrame, ident: str, rules: DetectRules) -> DataFrame:
    """``idx_i, idx_j, jd_tdb, dist_au, rel_vel_au_day`` on the fine grid, kept up to the threshold.

    A minimum on the edge of its window moves the window there, up to four times. Batches
    are small enough that all samples of a batch fit in a few hundred MB.
    """
    per_batch = max(1, int(2_000_000 * rules.fine_days / max(rules.window_days, rules.fine_days) / 2))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), per_batch):
                yield _refine_batch(frame.iloc[k : k + per_batch].reset_index(drop=True), rules)

    out = with_orbits(candidates, elements, ident).mapInPandas(run, "idx_i bigint, idx_j bigint, jd_tdb double, dist_au double, rel_vel_au_day double")
    return out.where(F.col("dist_au") <= rules.threshold_au)


def detect_encounters(elements: DataFrame, ident: str, start_jd: float, end_jd: float, rules: DetectRules | None = None) -> DataFrame:
    """The closest encounter of every pair in the window as one lazy plan."""
    rules = rules or DetectRules()
    rules.check()
    found = scan(elements, ident, start_jd, end_jd, rules)
    if rules.refine:
        return refine(found, elements, ident, rules)
    coarse = found.select("idx_i", "idx_j", F.col("t_coarse_jd").alias("jd_tdb"), F.col("d_coarse_au").alias("dist_au"), F.lit(None).cast("double").alias("rel_vel_au_day"))
    return coarse if rules.keep_wide else coarse.where(F.col("dist_au") <= rules.threshold_au)


def named_encounters(found: DataFrame, elements: DataFrame) -> DataFrame:
    """Detected pairs keyed by number, with designations."""
    names = elements.select(F.col("number").cast("bigint").alias("_id"), "designation")
    small = is_small(names)
    for s, side in (("i", "1"), ("j", "2")):
        mine = names.select(F.col("_id").alias(f"idx_{s}"), F.col("designation").alias(f"designation_{side}"))
        found = found.join(F.broadcast(mine) if small else mine, f"idx_{s}", "left")
    return found.select(F.col("idx_i").cast("int").alias("number_1"), F.col("idx_j").cast("int").alias("number_2"), "designation_1", "designation_2", "jd_tdb", "dist_au", "rel_vel_au_day")
