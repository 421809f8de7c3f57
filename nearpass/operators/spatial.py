"""Exact radius self-joins through grid cells, and the minimum per pair."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_within(step: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers ``p, q`` and distance of finite places of equal ``step`` at most ``radius`` apart, each pair once.

    Rows are sorted by step, column of edge ``radius`` and height; a row's partners stand in five runs of that order,
    above it in its own column and within the radius in four neighbours. Columns repeat every 4096 and heights
    end at 1000 radii: beyond, rows meet that the distance then parts. A step has at most 19 bits.
    """
    cx, cy = (np.mod(np.floor(c / radius), 4096.0).astype(np.int64) for c in (x, y))
    height = ((np.clip(z / radius, -1000.0, 1000.0) + 1024.0) * 256.0).astype(np.int64)
    step = step.astype(np.int64) << 24
    key = (step + (cx << 12) + cy << 20) + height
    order = np.argsort(key)
    key, step, cx, cy, height, x, y, z = (c[order] for c in (key, step, cx, cy, height, x, y, z))
    rows = np.arange(len(key))
    out = []
    for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)):
        middle = key if dx == dy == 0 else (step + ((cx + dx & 4095) << 12) + (cy + dy & 4095) << 20) + height
        low = rows + 1 if dx == dy == 0 else np.searchsorted(key, middle - 257)
        many = np.searchsorted(key, middle + 257, "right") - low
        p = np.repeat(rows, many)
        q = np.arange(len(p)) + np.repeat(low - (np.cumsum(many) - many), many)
        a, b, c = x[p] - x[q], y[p] - y[q], z[p] - z[q]
        dist = np.sqrt(a * a + b * b + c * c)
        near = np.flatnonzero(dist <= radius)
        out.append((order[p[near]], order[q[near]], dist[near]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def radius_self_join(df: DataFrame, ident: str, dims: list[str], radius: float, by: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``by..., idx_i, idx_j, dist`` of all pairs at most ``radius`` apart, each once with ``idx_i < idx_j``.

    Rows meet in cells of edge ``4 * radius``: one side stands in its own cell, the other in
    every cell its ball reaches, one or two along each axis (3.4 in space on average), so
    each pair meets exactly once from the smaller id. It is an equi-join on ``by`` and cell, which Spark
    shuffles, or splits where a cell is crowded; no pair of bodies in far cells is formed.
    ``keep`` columns come out as ``<name>_i`` and ``<name>_j``; null and NaN places meet nobody.
    """
    by, keep = by or [], keep or []
    cells = [f"_c{k}" for k in range(len(dims))]
    usable = df
    for d in dims:
        usable = usable.where(F.col(d).isNotNull() & ~F.isnan(d))
    extra = [c for c in keep if c not in (ident, *dims)]
    cell = lambda x: F.floor(x / (4.0 * radius)).cast("bigint")
    build = usable.select(*by, *[cell(F.col(d)).alias(c) for d, c in zip(dims, cells, strict=True)], F.col(ident).alias("idx_j"), *[F.col(c).alias(f"{c}_j") for c in [*dims, *extra]])
    probe = usable.select(*by, F.col(ident).alias("idx_i"), *[F.col(c).alias(f"{c}_i") for c in [*dims, *extra]])
    for d, c in zip(dims, cells, strict=True):
        x = F.col(f"{d}_i")
        probe = probe.withColumn(c, F.explode(F.sequence(cell(x - radius), cell(x + radius))))
    squared = sum(((F.col(f"{d}_i") - F.col(f"{d}_j")) * (F.col(f"{d}_i") - F.col(f"{d}_j")) for d in dims), F.lit(0.0))
    met = probe.join(build, [*by, *cells]).where(F.col("idx_i") < F.col("idx_j")).withColumn("dist", F.sqrt(squared)).where(F.col("dist") <= radius)
    return met.select(*by, "idx_i", "idx_j", "dist", *[f"{c}_{s}" for c in keep for s in ("i", "j")])


def min_per_pair(df: DataFrame, keys: list[str], dist: str, time: str) -> DataFrame:
    """Smallest distance of each pair and its time; of equal distances the earlier one.

    A partial minimum per map task goes into the shuffle, not the rows.
    """
    return df.groupBy(*keys).agg(F.min(F.struct(F.col(dist).alias("d"), F.col(time).alias("t"))).alias("m")).select(*keys, F.col("m.t").alias(time), F.col("m.d").alias(dist))


def prefilter(a_1: Column, a_2: Column, i_1: Column, i_2: Column, max_da: float = 0.5, max_di: float = 30.0) -> Column:
    return (F.abs(a_1 - a_2) <= max_da) & (F.abs(i_1 - i_2) <= max_di)


def radial_overlap(q_1: Column, big_q_1: Column, q_2: Column, big_q_2: Column, tau: float) -> Column:
    """Whether two orbits' heliocentric distances come within ``tau`` at all."""
    return (q_1 - tau <= big_q_2) & (q_2 - tau <= big_q_1)


def interval_overlap_pairs(df: DataFrame, ident: str, low: str, high: str, tau: float, width: float, by: list[str] | None = None) -> DataFrame:
    """``by..., idx_i, idx_j`` of rows with equal ``by`` whose intervals come within ``tau``.

    Intervals stand in every bucket of ``width`` they reach; a pair is taken in the first
    bucket both stand in, so it comes out once without a distinct.
    """
    by = by or []
    bucket = lambda x: F.floor(x / width).cast("bigint")
    placed = df.where(F.col(low) <= F.col(high)).select(
        *by, ident, low, high, F.explode(F.sequence(bucket(F.col(low) - tau / 2), bucket(F.col(high) + tau / 2))).alias("_b")
    )
    a = placed.select(*by, "_b", F.col(ident).alias("idx_i"), F.col(low).alias("lo_i"), F.col(high).alias("hi_i"))
    b = placed.select(*by, "_b", F.col(ident).alias("idx_j"), F.col(low).alias("lo_j"), F.col(high).alias("hi_j"))
    first = bucket(F.greatest("lo_i", "lo_j") - tau / 2)
    met = a.join(b, [*by, "_b"]).where(F.col("idx_i") < F.col("idx_j"))
    met = met.where((F.col("lo_i") - tau <= F.col("hi_j")) & (F.col("lo_j") - tau <= F.col("hi_i")) & (F.col("_b") == first))
    return met.select(*by, "idx_i", "idx_j")
