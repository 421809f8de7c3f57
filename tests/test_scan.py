"""The scan for pairs, its search and its trajectories against brute force."""

import numpy as np
import pandas as pd

from nearpass import session
from nearpass.functions.kepler import positions, tracks
from nearpass.operators import detect
from nearpass.operators.detect import DetectRules, scan
from nearpass.operators.spatial import rows_within
from nearpass.plans import detection


def test_rows_within_equals_brute_force_also_far_out():
    rng = np.random.default_rng(8)
    step = np.repeat(np.arange(3), 300)
    xyz = np.concatenate([rng.uniform(-1, 1, (860, 3)), rng.uniform(-1, 1, (40, 3)) * [0.1, 0.1, 0.1] + [4096 * 0.15, -900.0, 2e4]])
    xyz[0] = xyz[1]
    p, q, d = rows_within(step, *xyz.T, 0.15)
    far = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    i, j = np.nonzero(np.triu((far <= 0.15) & (step[:, None] == step[None]), 1))
    assert len(p) == len(i) > 100 and set(zip(np.minimum(p, q), np.maximum(p, q), strict=True)) == set(zip(i, j, strict=True))
    assert np.allclose(d, far[p, q])


def test_tracks_equal_positions():
    rng = np.random.default_rng(9)
    orbits = [rng.uniform(*r, 500) for r in ((0.4, 40), (0, 0.9999), (0, 180), (0, 360), (0, 360), (0, 360), (2450000, 2460000))]
    t = np.linspace(2457000, 2457900, 7)
    assert np.allclose(tracks(orbits, t), positions(*[c[None] for c in orbits], t[:, None]), rtol=0, atol=1e-12)


def test_scan_makes_trajectories_where_they_are_searched(spark):
    """Inner, retrograde, polar, distant and eccentric orbits over three parts of time; no places are staged."""
    rng = np.random.default_rng(10)
    n = 260
    a, ecc, tilt = rng.uniform(0.3, 1.2, n), rng.uniform(0, 0.3, n), np.repeat([2.0, 90.0, 178.0, 60.0], n // 4)
    a[:6], ecc[:6] = [30.0, 30.001, 3.0, 2.5, 5.0, 400.0], [0, 0, 0.97, 0.95, 0.999, 0.9999]
    rows = [(k + 1, float(a[k]), float(ecc[k]), float(tilt[k]), *map(float, rng.uniform(0, 360, 3)), 2457000.0) for k in range(n)]
    rows[1] = (2, 30.001, 0.0, *rows[0][3:])
    elements = spark.createDataFrame([*rows, (n + 1, None, 0.1, 1.0, 1.0, 1.0, 1.0, 2457000.0)], "number int, " + ", ".join(f"{c} double" for c in detect.ORBIT))
    staged, rules = list(session._STAGED), DetectRules(coarse_days=1.0, v_max_km_s=0.0, threshold_au=0.05, refine=False, decimals=9)
    found = scan(elements, "number", 2457000.0, 2457149.0, rules)
    assert session._STAGED == staged
    got = {(r.idx_i, r.idx_j): (r.d_coarse_au, r.t_coarse_jd) for r in found.collect()}
    t = 2457000.0 + np.arange(150)
    at = positions(*[np.array([r[k + 1] for r in rows])[:, None] for k in range(7)], t)
    want = {}
    for i in range(n):
        d = np.sqrt(((at[i] - at[i + 1 :]) ** 2).sum(-1))
        want |= {(i + 1, i + 2 + j): (d[j].min(), t[d[j].argmin()]) for j in np.flatnonzero((d <= 0.05).any(1))}
    assert set(got) == set(want) and (1, 2) in want and len(want) > 50
    assert all(abs(got[k][0] - d) < 1e-7 and (got[k][1] == when or k == (1, 2)) for k, (d, when) in want.items())


def test_minima_taken_in_between_are_the_same(monkeypatch):
    rng = np.random.default_rng(11)
    low = np.array([2.2, 0, 0, 0, 0, 25, 2457000.0])
    rows = pd.DataFrame(rng.uniform(low, low + [0.2, 0.1, 2, 0.1, 0.1, 30, 0], (300, 7)), columns=detect.ORBIT).assign(number=np.arange(300), part=1)
    rules, t = DetectRules(coarse_days=1.0, v_max_km_s=0.0, refine=False), 2457000.0 + np.arange(60)
    least = lambda: pd.concat(detect._scan_part(rows, "number", t, 64, rules)).groupby(["idx_i", "idx_j"]).d_coarse_au.min()
    once = least()
    monkeypatch.setattr(detect, "SCAN_ROWS", 3000)
    monkeypatch.setattr(detect, "FOUND_ROWS", 50)
    assert len(once) > 100 and least().equals(once)


def test_orbital_filters_take_pairs_before_their_minimum(spark):
    rng = np.random.default_rng(12)
    n = 300
    rows = [(k + 1, *map(float, rng.uniform([2.0, 0, 0, 0, 0, 0], [2.6, 0.01, 3, 360, 360, 40])), 2457000.0) for k in range(n)]
    elements = spark.createDataFrame([(*r[:4], 0.0, 0.0, *r[6:]) for r in rows], "number int, " + ", ".join(f"{c} double" for c in detect.ORBIT))
    orbit = {r[0]: r[1:4] for r in rows}
    pairs = lambda **changes: {(r.idx_i, r.idx_j): r.d_coarse_au for r in scan(elements, "number", 2457000.0, 2457020.0, DetectRules(threshold_au=0.02, v_max_km_s=200.0, decimals=9, **changes)).collect()}
    staged, everything = list(session._STAGED), pairs()
    ends = {k: (a * (1 - e) - 0.02, a * (1 + e)) for k, (a, e, _) in orbit.items()}
    radial = {k: d for k, d in everything.items() if ends[k[0]][0] <= ends[k[1]][1] and ends[k[1]][0] <= ends[k[0]][1]}
    close = {k: d for k, d in everything.items() if abs(orbit[k[0]][0] - orbit[k[1]][0]) <= 0.01 and abs(orbit[k[0]][2] - orbit[k[1]][2]) <= 1}
    assert 0 < len(radial) < len(everything) and pairs(radial=True) == radial
    assert 0 < len(close) < len(everything) and pairs(max_da=0.01, max_di=1.0) == close
    assert session._STAGED == staged


def test_places_are_made_once_a_run_and_give_every_step_s_minimum(monkeypatch):
    """Calm, eccentric and inner orbits: runs of 16 steps down to four; an orbit twice, and one nearly."""
    made, strides, t = [], [], 2457000.0 + 0.5 * np.arange(200)
    make, close = detect.tracks, getattr(detect, "_close_steps", None)
    monkeypatch.setattr(detect, "tracks", lambda orbits, at, *rest: made.append(len(at) * len(orbits[0])) or make(orbits, at, *rest))
    monkeypatch.setattr(detect, "_close_steps", lambda *args: strides.append(args[3]) or close(*args), raising=False)
    for seed, (axis, ecc, tilt, radius) in enumerate([((2.2, 3.2), 0.15, 8, 0.05), ((2.0, 3.2), 0.4, 20, 0.07), ((1.2, 1.5), 0.4, 20, 0.07), ((0.7, 1.3), 0.6, 40, 0.07)]):
        rng = np.random.default_rng(seed)
        low = np.array([axis[0], 0, 0, 0, 0, 0, 2457000.0])
        orbits = rng.uniform(low, [axis[1], ecc, tilt, 360, 360, 360, 2457001.0], (900, 7))
        orbits[1], orbits[2] = orbits[0], orbits[0] + [0, 1e-6, 0, 0, 0, 0, 0]
        rows = pd.DataFrame(orbits, columns=detect.ORBIT).assign(number=np.arange(900))
        rules = DetectRules(threshold_au=radius, v_max_km_s=0.0, refine=False, decimals=9)
        made.clear()
        found = [p for block in range(2) for k in range(detect.SECTORS) for p in detect._scan_part(rows.assign(part=block * detect.SECTORS + k), "number", t, 128, rules)]
        if seed == 0:
            assert sum(made) <= detect.SECTORS * len(rows) * len(t) / 8
        got = pd.concat(found).sort_values(["d_coarse_au", "t_coarse_jd"]).groupby(["idx_i", "idx_j"]).first()
        at = np.round(positions(*orbits.T[:, :, None], t), 9)
        want = {}
        for i in range(len(at)):
            d = np.sqrt(((at[i] - at[i + 1 :]) ** 2).sum(-1))
            d = np.where(d <= radius, np.floor(d * 1e8 + 0.5) / 1e8, np.inf)
            want |= {(i, i + 1 + j): (t[d[j].argmin()], d[j].min()) for j in np.flatnonzero(np.isfinite(d).any(1))}
        assert set(got.index) == set(want) and {(0, 1), (0, 2), (1, 2)} < set(want) and len(want) > 30
        assert want[0, 1] == (t[0], 0.0) and all(tuple(got.loc[k]) == v for k, v in want.items())
    assert {4, 16} < set(strides)


def test_vertex_query_reads_the_elements_once(spark, sf):
    out = detection.encounter_refine_vertex(spark, sf)
    assert not any("elements.parquet" in f for f in out.inputFiles())
