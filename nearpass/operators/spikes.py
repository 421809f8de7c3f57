"""Implausible readings of a source, relative to how that source normally reads.

A source's readings form a profile matrix: a row per profile (one transit of a few
consecutive readings, several a day), a column per slot in it. Robust principal components
split that matrix into a low-rank part, the source's smooth motion, and a sparse part, the
spikes. Ranges, constant runs and labels are tested on their own. The matrices of many
sources are held as flat arrays of readings and worked on together; sums go by row,
column and source, so a batch costs a fixed number of array operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearpass.session import broadcast_if_small, shuffle_partitions, stage

_MAS = 3.6e6  # milliarcseconds in a degree
#: Readings of whole sources worked on together, and parts a profile is cut into for its first line.
BATCH, PARTS = 100_000, 12


@dataclass(frozen=True)
class SpikeRules:
    """Thresholds. A deviation must also be ``significant`` given the fit's own error. ``bend`` bounds the apparent acceleration, ``rate`` the apparent speed.

    ``near`` profiles on either side are compared for a profile's place in its visit.
    """

    times_scatter: float = 10.0
    ordinary: float = 6.0
    significant: float = 4.0
    run: int = 4
    solid: int = 4
    visit_gap: float = 1.0
    bend: float = 0.06
    rate: float = 1.5
    prior_rows: float = 20.0
    near: int = 8
    block_rows: int = 50_000
    halo_days: int = 3


def constant_runs(values: np.ndarray, least: int, group: np.ndarray | None = None) -> np.ndarray:
    """Marks readings equal to the one before (of the group) within a run of ``least`` or more; NaN ends a run."""
    if not len(values):
        return np.zeros(0, bool)
    same = np.r_[False, values[1:] == values[:-1]]
    if group is not None:
        same[1:] &= group[1:] == group[:-1]
    run = np.cumsum(~same)
    return same & (np.bincount(run)[run] >= least)


def _median(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Median of the values that are not NaN, by group; NaN for none."""
    return pd.Series(values).groupby(group).median().reindex(range(groups)).to_numpy(float)


def _joint(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Numbers of the pairs of two small whole numbers, and the pairs."""
    width = int(b.max()) + 1
    number, pairs = pd.factorize(a.astype(np.int64) * width + b)
    return number, (pairs // width, pairs % width)


@dataclass
class Profiles:
    """Readings of many sources as profile matrices: source, row and column of each reading.

    ``row_source`` and ``column_source`` say whose a row or column is; ``slot`` is the time of
    a column in its profile, ``when`` the time of a row.
    """

    source: np.ndarray
    row: np.ndarray
    column: np.ndarray
    row_source: np.ndarray
    column_source: np.ndarray
    slot: np.ndarray
    when: np.ndarray
    sources: int

    @classmethod
    def of(cls, source: np.ndarray, profile: pd.Series, t: np.ndarray, sources: int) -> Profiles:
        row, _ = _joint(source, pd.factorize(profile, use_na_sentinel=False)[0])
        rows = int(row.max()) + 1
        row_source = np.zeros(rows, np.int64)
        row_source[row] = source
        start = np.full(rows, np.inf)
        np.minimum.at(start, row, t)
        gap = np.where((np.diff(row) == 0) & (np.diff(t) > 0), np.diff(t), np.nan)
        step = np.nan_to_num(_median(gap, source[1:], sources), nan=1.0) if len(gap) else np.ones(sources)
        raw = np.rint((t - start[row]) / step[source])
        code, known = pd.factorize(raw)
        column, (column_source, place) = _joint(source, code)
        place = known[place]
        columns = np.bincount(column_source, minlength=sources)
        middle = np.bincount(column_source, place, sources) / np.maximum(columns, 1)
        return cls(source, row, column, row_source, column_source, (place - middle[column_source]) * step[column_source], start + (middle * step)[row_source], sources)

    def by_row(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, x, len(self.row_source))

    def by_column(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, x, len(self.slot))


def _start_lines(p: Profiles, v: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the line through two of its parts that leaves the smallest median deviation.

    A part is the median of neighbouring readings, a single one in profiles of up to ``PARTS``.
    """
    rows = len(p.row_source)
    order = np.lexsort((p.slot[p.column], p.row))
    order = order[known[order]]
    n = np.bincount(p.row[order], minlength=rows)
    place = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
    part = np.minimum(place * PARTS // np.maximum(n[p.row[order]], PARTS), PARTS - 1)
    grid = pd.DataFrame({"k": p.row[order] * PARTS + part, "x": p.slot[p.column[order]], "y": v[order]}).groupby("k").median()
    x, y = np.full(rows * PARTS, np.nan), np.full(rows * PARTS, np.nan)
    x[grid.index], y[grid.index] = grid["x"], grid["y"]
    x, y = x.reshape(rows, PARTS), y.reshape(rows, PARTS)
    parts = np.isfinite(y).sum(1)
    best, base, rate = np.full(rows, np.inf), np.zeros(rows), np.zeros(rows)
    single = parts == 1
    base[single] = y[single, 0]
    middle = np.minimum(parts // 2, PARTS - 1)
    for i in range(PARTS):
        for j in range(i + 1, PARTS):
            some = np.flatnonzero(parts > j)
            if not len(some):
                break
            dx = x[some, j] - x[some, i]
            with np.errstate(divide="ignore", invalid="ignore"):
                rise = (y[some, j] - y[some, i]) / dx
            left = np.abs(y[some] - y[some, i][:, None] - rise[:, None] * (x[some] - x[some, i][:, None]))
            score = np.sort(np.where(np.isfinite(left), left, np.inf), axis=1)[np.arange(len(some)), middle[some]]
            better = (score < best[some]) & np.isfinite(rise)
            who = some[better]
            best[who], rate[who], base[who] = score[better], rise[better], (y[some, i] - rise * x[some, i])[better]
    return base, rate


def robust_components(p: Profiles, values: list[np.ndarray], known: list[np.ndarray], rules: SpikeRules) -> dict:
    """Split the two profile matrices (``values``) of each source into ``centre + rate * profile`` and sparse spikes.

    Alternates between the sparse part (entries further than ``ordinary`` scatters from the
    low-rank part) and the two components, whose profile is drawn to uniform motion
    with the weight of ``prior_rows`` rows, so that a source of few profiles can't explain
    a spike by its own component. The scatter is pooled over both matrices and corrected
    for the two fitted numbers a row.
    """
    lines = [_start_lines(p, v, k) for v, k in zip(values, known, strict=True)]
    profile = p.slot.copy()
    many = [p.by_row(k) >= rules.solid for k in known]
    scale: np.ndarray | None = None
    fits: list[dict[str, np.ndarray]] = []
    for turn in range(8):
        at = profile[p.column]
        off = [np.where(k, v - c[p.row] - r[p.row] * at, 0.0) for v, k, (c, r) in zip(values, known, lines, strict=True)]
        if scale is None:
            size = np.concatenate([np.where(k & m[p.row] & (o != 0), np.abs(o), np.nan) for o, k, m in zip(off, known, many, strict=True)])
            scale = 2.5 * np.nan_to_num(_median(size, np.r_[p.source, p.source], p.sources))
        fits, lines = [], []
        sums, freedom = np.zeros(p.sources), np.zeros(p.sources)
        top, below, rows = np.zeros(len(p.slot)), np.zeros(len(p.slot)), np.zeros(p.sources)
        for v, k, o in zip(values, known, off, strict=True):
            good = k & (np.abs(o) <= (rules.ordinary * scale + 1e-9)[p.source])
            good |= k & (p.by_row(good) < 2)[p.row]
            n = p.by_row(good)
            mean_p = p.by_row(np.where(good, at, 0.0)) / np.maximum(n, 1)
            mean_v = p.by_row(np.where(good, v, 0.0)) / np.maximum(n, 1)
            dp = np.where(good, at - mean_p[p.row], 0.0)
            dv = np.where(good, v - mean_v[p.row], 0.0)
            spread = p.by_row(dp**2)
            rate = np.where(spread > 0, p.by_row(dp * dv) / np.where(spread > 0, spread, 1.0), 0.0)
            centre = mean_v - rate * mean_p
            left = np.where(good, v - centre[p.row] - rate[p.row] * at, 0.0)
            solid = n >= rules.solid
            sums += np.bincount(p.row_source, np.where(solid, p.by_row(left**2), 0.0), p.sources)
            freedom += np.bincount(p.row_source, np.where(solid, n - 2, 0.0), p.sources)
            weight = np.where(solid, rate, 0.0)[p.row]
            top += p.by_column(weight * np.where(good, v - centre[p.row], 0.0))
            below += p.by_column(weight**2 * good)
            rows += np.bincount(p.row_source, solid, p.sources)
            fits.append({"n": n, "rate": rate, "centre": centre, "spread": spread, "mean": mean_p, "good": good})
            lines.append((centre, rate))
        scale = np.where(freedom > 0, np.sqrt(sums / np.maximum(freedom, 1.0)), scale)
        columns = np.maximum(np.bincount(p.column_source, minlength=p.sources), 1)
        mean_below = np.bincount(p.column_source, below, p.sources) / columns
        prior = (rules.prior_rows * np.maximum(mean_below / np.maximum(rows, 1), 1e-30))[p.column_source]
        if turn < 6:
            profile = np.where((mean_below > 0)[p.column_source], (top + prior * p.slot) / (below + prior), profile)
    at, off = profile[p.column], []
    for v, k, f in zip(values, known, fits, strict=True):
        gap = np.where(k, v - f["centre"][p.row] - f["rate"][p.row] * at, 0.0)
        # a line drawn out far beyond its points proves little: allow for its own error there
        spread = np.where(f["spread"] > 0, f["spread"], np.nan)[p.row]
        lever = 1.0 / np.maximum(f["n"], 1)[p.row] + (at - f["mean"][p.row]) ** 2 / spread
        sure = np.abs(gap) > rules.significant * scale[p.source] * np.sqrt(1.0 + np.where(f["good"], 0.0, np.nan_to_num(lever, nan=1e12)))
        off.append(np.where(sure, gap, 0.0))
    return {"off": off, "fit": fits, "scale": scale, "sums": sums, "freedom": freedom, "profile": profile}


def source_flags(rows: pd.DataFrame, source: np.ndarray, rules: SpikeRules) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Deviation of every reading, and the moments of each source's scatter.

    ``rows`` are sorted by source and time; ``source`` numbers the sources from 0.
    Columns ``range, run, off`` (largest deviation in mas) and ``astray`` (profile off the path).
    """
    rows = rows.reset_index(drop=True)
    t = rows["epoch"].to_numpy(float)
    value = {a: rows[a].to_numpy(float) for a in ("ra", "dec")}
    out = pd.DataFrame({"range": False, "run": False, "off": 0.0, "astray": False}, index=rows.index)
    if not len(rows):
        return out, np.zeros(0), np.zeros(0)
    inside = {"ra": (value["ra"] >= 0) & (value["ra"] < 360), "dec": np.abs(value["dec"]) <= 90}
    usable = {}
    for a in value:
        there = ~np.isnan(value[a])
        run = constant_runs(value[a], rules.run, source)
        out["range"] |= there & ~inside[a]
        out["run"] |= run
        usable[a] = there & inside[a] & ~run
    p = Profiles.of(source, rows["profile"], t, int(source[-1]) + 1)
    m = len(p.row_source)
    delta, reference = {}, {}
    for a, x in value.items():
        known = np.where(usable[a], x, np.nan)
        if a == "ra":  # medians across 0 h: take them about the first usable reading of the row
            anchor = pd.Series(known).groupby(p.row).first().reindex(range(m)).to_numpy(float)
            turn = (known - anchor[p.row] + 180) % 360 - 180
            reference[a] = (anchor + _median(turn, p.row, m)) % 360
            delta[a] = (x - reference[a][p.row] + 180) % 360 - 180
        else:
            reference[a] = _median(known, p.row, m)
            delta[a] = x - reference[a][p.row]
    tilt = np.cos(np.radians(np.where(np.isnan(reference["dec"]), 0.0, reference["dec"])))
    known = [usable["ra"], usable["dec"]]
    values = [np.where(k, d, 0.0) * _MAS for k, d in zip(known, (delta["ra"] * tilt[p.row], delta["dec"]), strict=True)]
    fit = robust_components(p, values, known, rules)
    off = np.zeros(len(rows))
    for a, f, o, k, factor in zip(("ra", "dec"), fit["fit"], fit["off"], known, (tilt, np.ones(m)), strict=True):
        readings = p.by_row(k)
        with np.errstate(divide="ignore", invalid="ignore"):
            error = np.where((f["n"] >= rules.solid) & (f["spread"] > 0), fit["scale"][p.row_source] / np.sqrt(f["spread"]), np.inf)
        astray = _astray(p, reference[a], f, error, readings > 0, factor, fit["scale"], a == "ra", rules)
        here = k & (readings >= rules.solid)[p.row]
        off[here] = np.maximum(off[here], np.abs(o[here]))
        out["astray"] |= k & astray[p.row]
    out["off"] = off
    return out, fit["sums"], fit["freedom"]


def _astray(p: Profiles, reference: np.ndarray, f: dict, error: np.ndarray, have: np.ndarray, factor: np.ndarray, scale: np.ndarray, circle: bool, rules: SpikeRules) -> np.ndarray:
    """Profiles whose centre is off the path through the profiles around them."""
    off = np.zeros(len(p.when), bool)
    at = np.flatnonzero(have)
    if len(at) < 2:
        return off
    at = at[np.lexsort((p.when[at], p.row_source[at]))]
    when, owner = p.when[at], p.row_source[at]
    new = np.r_[True, (np.diff(when) > rules.visit_gap) | (np.diff(owner) != 0)]
    visit = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(at)])
    turn = (lambda d: (d + 180) % 360 - 180) if circle else (lambda d: d)
    zero, tilt = reference[at[first]], _median(factor[at], visit, len(first))
    shift = turn(reference[at] - zero[visit])
    centre = (shift * _MAS + f["centre"][at] / np.maximum(factor[at], 1e-6)) * tilt[visit]
    middle_when, middle = _median(when, visit, len(first)), zero + _median(shift, visit, len(first))
    # the places of the visits before and after, about this one's first
    beside, days = np.full((2, len(first)), np.nan), np.full((2, len(first)), np.nan)
    same = owner[first[1:]] == owner[first[:-1]]
    k = np.flatnonzero(same)
    beside[0, k + 1], days[0, k + 1] = turn(middle[k] - zero[k + 1]), np.abs(middle_when[k] - middle_when[k + 1])
    beside[1, k], days[1, k] = turn(middle[k + 1] - zero[k]), np.abs(middle_when[k + 1] - middle_when[k])
    lone = count == 1
    with np.errstate(invalid="ignore"):
        far = np.abs(beside) * factor[at[first]] > rules.rate * days + 1.0
    off[at[first[lone & far.all(0)]]] = True

    rate, sigma, readings = f["rate"][at], error[at], f["n"][at]
    left, right = [], []
    for step in range(1, rules.near + 1):
        i = np.flatnonzero(visit[step:] == visit[:-step])
        if not len(i):
            break
        left.append(i)
        right.append(i + step)
    if not left:
        return off
    left, right = np.concatenate(left), np.concatenate(right)
    dt = when[right] - when[left]
    sure = np.stack([np.isfinite(sigma[left]), np.isfinite(sigma[right])])
    measured = sure.sum(0)
    both = np.maximum(measured, 1)
    expect = (np.where(sure[0], rate[left], 0.0) + np.where(sure[1], rate[right], 0.0)) / both * dt
    slack = 10 * scale[owner[left]] + rules.bend * _MAS * dt * dt
    slack += np.where(measured > 0, 8 * (np.where(sure[0], sigma[left], 0.0) + np.where(sure[1], sigma[right], 0.0)) / both * dt, rules.rate * _MAS * dt)
    agree = np.abs(centre[right] - centre[left] - np.where(measured > 0, expect, 0.0)) <= slack
    split = np.unique(visit[left[~agree]])
    if not len(split):
        return off
    weight = np.where(np.isfinite(beside), 1.0 / np.maximum(days, 1e-3), 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        guess = (np.nan_to_num(beside) * weight).sum(0) / weight.sum(0) * _MAS * tilt
    order = np.argsort(visit[left], kind="stable")
    bounds = np.searchsorted(visit[left][order], np.c_[split, split + 1])
    for v, (low, high) in zip(split, bounds, strict=True):
        edges = order[low:high]
        mine = slice(first[v], first[v] + count[v])
        off[at[mine]] = _off_visit(left[edges] - first[v], right[edges] - first[v], agree[edges], centre[mine], readings[mine], float(guess[v]))
    return off


def _off_visit(left: np.ndarray, right: np.ndarray, agree: np.ndarray, centre: np.ndarray, n: np.ndarray, guess: float) -> np.ndarray:
    """Profiles of one visit that don't lie on the path of the others; ``guess`` settles draws.

    Two profiles agree when the motion between them fits the rates measured in them. The
    connected profiles holding most readings are the path.
    """
    group = list(range(len(centre)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i, j in zip(left[agree].tolist(), right[agree].tolist(), strict=True):
        a, b = sorted((root(i), root(j)))
        group[b] = a
    group = np.array([root(i) for i in range(len(centre))])
    names = np.unique(group)
    if len(names) == 1:
        return np.zeros(len(centre), bool)
    held = {g: int(n[group == g].sum()) for g in names}
    solid = {g: int((group == g).sum()) for g in names}
    off = {g: abs(float(np.median(centre[group == g])) - guess) if np.isfinite(guess) else 0.0 for g in names}
    draw = max(solid.values()) == 1 or list(solid.values()).count(max(solid.values())) > 1
    best = min(names, key=lambda g: (-min(solid[g], 2), off[g] if draw else 0.0, -held[g]))
    return group != best


def _judge(rules: SpikeRules) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Flags of whole sources (or blocks) out of frames sorted by source, block and time, many at a time."""

    def judged(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["source", "block", "epoch", "reading", "core"], kind="stable").drop_duplicates(["source", "block", "reading"])
        group = rows.groupby(["source", "block"], sort=True).ngroup().to_numpy()
        flags, sums, freedom = source_flags(rows, group, rules)
        flags = flags.assign(source=rows["source"].to_numpy(), reading=rows["reading"].to_numpy(), group=group)[rows["core"].to_numpy()]
        scale = np.sqrt(sums / np.maximum(freedom, 1.0))
        kinds = [
            ("range", flags[flags["range"]], 0.0), ("run", flags[flags["run"]], 0.0), ("path", flags[flags["astray"]], np.inf),
            ("path", flags[(flags["off"] > 0.5 * rules.times_scatter * scale[flags["group"]]) & (flags["off"] > 0)], None),
        ]
        out = [pd.DataFrame({"source": hit["source"], "reading": hit["reading"], "kind": kind, "value": hit["off"] if value is None else value, "freedom": 0.0}) for kind, hit, value in kinds]
        first = np.flatnonzero(np.r_[True, np.diff(group) != 0])
        out.append(pd.DataFrame({"source": rows["source"].to_numpy()[first], "reading": None, "kind": "scatter", "value": sums, "freedom": freedom}))
        return pd.concat([o.astype({"reading": "Int64", "source": "int64", "value": "float64"}) for o in out], ignore_index=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            kept.append(frame)
            size += len(frame)
            if size < BATCH:
                continue
            rows = pd.concat(kept, ignore_index=True)
            last = (rows["source"].to_numpy() == rows["source"].iloc[-1]) & (rows["block"].to_numpy() == rows["block"].iloc[-1])
            if not last.all():
                yield judged(rows[~last])
            kept, size = [rows[last]], int(last.sum())
        if size:
            yield judged(pd.concat(kept, ignore_index=True))

    return run


def _blocks(rows: DataFrame, rules: SpikeRules) -> DataFrame:
    """Rows with ``block`` and ``core``; a source beyond ``block_rows`` is cut by days.

    Days of such a source are laid into blocks of about ``block_rows`` rows, and the days at
    a block's ends are copied to its neighbour (``core`` false) so that runs and paths go on
    across the cut. The list of large sources has at most rows/block_rows entries.
    """
    day = F.floor("epoch").cast("bigint")
    per_day = rows.groupBy("source", day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    large = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rules.block_rows).select("source")
    if large.isEmpty():
        return rows.select("source", "reading", "profile", "epoch", "ra", "dec", F.lit(0).cast("bigint").alias("block"), F.lit(True).alias("core"))
    by_day = W.partitionBy("source").orderBy("day")
    laid = (
        per_day.join(broadcast_if_small(large), "source")
        .withColumn("block", F.floor((F.sum("n").over(by_day.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")) / rules.block_rows))
        .withColumn("from_start", F.row_number().over(W.partitionBy("source", "block").orderBy("day")))
        .withColumn("from_end", F.row_number().over(W.partitionBy("source", "block").orderBy(F.desc("day"))))
    )
    target = lambda block, core: F.struct(block.cast("bigint").alias("block"), F.lit(core).alias("core"))
    own = F.col("block")
    targets = F.array_compact(
        F.array(target(own, True), F.when(F.col("from_start") <= rules.halo_days, target(own - 1, False)), F.when(F.col("from_end") <= rules.halo_days, target(own + 1, False)))
    )
    placed = rows.withColumn("day", day).join(broadcast_if_small(laid.select("source", "day", targets.alias("targets"))), ["source", "day"], "left")
    whole = F.array(target(F.lit(0), True))
    return placed.withColumn("_to", F.explode(F.coalesce("targets", whole))).select("source", "reading", "profile", "epoch", "ra", "dec", "_to.block", "_to.core")


def implausible_readings(df: DataFrame, rules: SpikeRules | None = None, source: str = "source_id", reading: str = "observation_id", profile: str = "transit_id", label: str = "number_mp") -> DataFrame:
    """``reading, kind`` of every reading that cannot be right for its source.

    Kinds: ``range`` (outside the sphere), ``path`` (off the source's path by more than
    ``times_scatter`` of its scatter), ``run`` (stuck value) and ``label`` (not the source's
    usual number; of equally usual ones the smaller). A reading may have several kinds and
    a repeated row counts once. Null and NaN values are no cases and end a run; rows without
    source or reading id are left out, rows without a finite time take part in range and label only.
    """
    rules = rules or SpikeRules()
    named = df.select(F.col(source).cast("bigint").alias("source"), F.col(reading).cast("bigint").alias("reading"), F.col(profile).alias("profile"), F.col("epoch").cast("double").alias("epoch"), F.col("ra").cast("double").alias("ra"), F.col("dec").cast("double").alias("dec"), F.col(label).cast("double").alias("label"))
    named = named.where(F.col("source").isNotNull() & F.col("reading").isNotNull())
    timed = F.col("epoch").isNotNull() & (F.abs("epoch") < float("inf"))
    outside = ((F.col("ra") < 0) | (F.col("ra") >= 360)) & ~F.isnan("ra") | (F.abs("dec") > 90) & ~F.isnan("dec")
    untimed = named.where(~timed).where(outside).select("reading", F.lit("range").alias("kind"))
    # numbered partitions: merging them by bytes would leave the fits to a few tasks
    together = _blocks(named.where(timed).drop("label"), rules).repartition(shuffle_partitions(df.sparkSession), "source", "block").sortWithinPartitions("source", "block", "epoch")
    judged = stage(together.mapInPandas(_judge(rules), "source bigint, reading bigint, kind string, value double, freedom double"), "spikes")
    scatter = F.sqrt(F.sum("value") / F.nullif(F.sum("freedom"), F.lit(0.0)))
    of_source = judged.where(F.col("kind") == "scatter").groupBy("source").agg(scatter.alias("scatter"))
    found = judged.where(F.col("kind") != "scatter").join(of_source, "source")
    sure = found.where((F.col("kind") != "path") | (F.col("value") > rules.times_scatter * F.coalesce("scatter", F.lit(0.0)))).select("reading", "kind")

    labels = named.where(F.col("label").isNotNull() & ~F.isnan("label")).select("source", "reading", "label").dropDuplicates()
    counts = labels.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "label"))
    odd = counts.withColumn("_rank", rank).where(F.col("_rank") > 1).select("source", "label")
    mislabelled = labels.join(odd, ["source", "label"], "left_semi").select("reading", F.lit("label").alias("kind"))
    return sure.unionByName(untimed).unionByName(mislabelled).distinct()
