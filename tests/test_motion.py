"""Orbits, detection, refinement and characterisation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearpass.functions import kepler as K
from nearpass.functions.dynamics import GIANTS, Perturber, acceleration, energy, integrate
from nearpass.operators.characterize import characterize
from nearpass.operators.detect import DetectRules, detect_encounters, propagate, scan, snapshot_for_window, time_grid, usable_elements, vertex_np
from nearpass.operators.spatial import interval_overlap_pairs, min_per_pair, radius_self_join

SCHEMA = "number int, designation string, a_au double, ecc double, i_deg double, node_deg double, argperi_deg double, mean_anomaly_deg double, epoch_jd double, h_mag double"


def bodies(spark, rows):
    return spark.createDataFrame([(n, str(n), float(a), float(e), float(i), float(o), float(w), float(m), 2457000.0, h) for n, a, e, i, o, w, m, h in rows], SCHEMA)


def belt(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(k + 1, rng.uniform(2.2, 2.6), rng.uniform(0, 0.2), rng.uniform(0, 3), *rng.uniform(0, 360, 3), float(rng.uniform(5, 18))) for k in range(n)]


def test_three_bodies(spark):
    three = bodies(spark, [(1, 2.5, 0, 0, 0, 0, 0.0, None), (2, 2.5, 0, 0, 0, 0, 0.01, None), (3, 3.5, 0, 0, 0, 0, 0.0, None)])
    found = scan(three, "number", 2457000.0, 2457000.0, DetectRules(coarse_days=0.5)).collect()
    assert [(r.idx_i, r.idx_j) for r in found] == [(1, 2)]
    assert found[0].d_coarse_au == pytest.approx(4.36e-4, rel=1e-2)
    assert scan(bodies(spark, [(1, 2.5, 0, 0, 0, 0, 0, None), (2, 4.0, 0, 0, 0, 0, 0, None)]), "number", 2457000.0, 2457002.0, DetectRules()).columns == ["idx_i", "idx_j", "t_coarse_jd", "d_coarse_au"]


@pytest.mark.parametrize("window", [0.25, 2.0 / 24])
def test_crossing_pair_is_refined_wherever_the_window_starts(spark, window):
    pair = bodies(spark, [(1, 2.5, 0, 15, 0, 0, 180 - 0.0237, None), (2, 2.5, 0, 15, 180, 0, 0, None)])
    t = 2457000.0 + np.arange(-20000, 20000) * 5 / 86400
    args = [np.array([2.5]), 0.0, 15.0]
    d = np.linalg.norm(K.positions(*args, 0.0, 0.0, 180 - 0.0237, 2457000.0, t) - K.positions(*args, 180.0, 0.0, 0.0, 2457000.0, t), axis=1)
    true_t, true_d = t[d.argmin()], d.min()
    candidates = spark.createDataFrame([(1, 2, float(true_t - 5 / 24), 0.01)], "idx_i long, idx_j long, t_coarse_jd double, d_coarse_au double")
    from nearpass.operators.detect import refine

    row = refine(candidates, pair, "number", DetectRules(window_days=window, fine_days=60 / 86400)).first()
    assert abs(row.jd_tdb - true_t) * 86400 <= 60 and abs(row.dist_au - true_d) <= 1e-6


def test_window_must_cover_half_a_step():
    with pytest.raises(ValueError, match="half a coarse step"):
        DetectRules(coarse_days=0.5, window_days=2 / 24).check()


def test_detection_equals_brute_force(spark):
    rows = belt(60)
    elements = bodies(spark, rows)
    rules = DetectRules(threshold_au=0.15, coarse_days=0.5, window_days=0.25, fine_days=0.01, v_max_km_s=40.0)
    got = {(r.idx_i, r.idx_j): r for r in detect_encounters(elements, "number", 2457000.0, 2457010.0, rules).collect()}
    t = 2457000.0 + np.arange(-30, 1030) * 0.01
    xyz = np.array([K.positions(a, e, i, o, w, m, 2457000.0, t) for _, a, e, i, o, w, m, _ in rows])
    inside = (t >= 2457000.0) & (t <= 2457010.0)
    expect = {(i + 1, j + 1) for i in range(60) for j in range(i + 1, 60) if np.linalg.norm(xyz[i] - xyz[j], axis=1)[inside].min() <= 0.1499}
    assert expect and expect <= set(got)
    assert all(r.dist_au <= 0.15 and r.rel_vel_au_day > 0 for r in got.values())


def test_wide_rows_are_kept_only_on_demand(spark):
    elements = bodies(spark, belt(80))
    wide = DetectRules(threshold_au=0.02, coarse_days=0.5, refine=False, keep_wide=True, v_max_km_s=800.0)
    kept = detect_encounters(elements, "number", 2457000.0, 2457002.0, wide)
    assert kept.where("dist_au > 0.02").count() > 0
    narrow = DetectRules(threshold_au=0.02, coarse_days=0.5, refine=False, v_max_km_s=800.0)
    assert detect_encounters(elements, "number", 2457000.0, 2457002.0, narrow).where("dist_au > 0.02").count() == 0


def test_native_and_numpy_motion_agree(spark):
    elements = bodies(spark, belt(30))
    c = {k: F.col(k) for k in ("a_au", "ecc", "i_deg", "node_deg", "argperi_deg", "mean_anomaly_deg", "epoch_jd")}
    t = F.lit(2457123.25)
    big_e = K.eccentric_anomaly(K.mean_anomaly(c["mean_anomaly_deg"], c["a_au"], c["epoch_jd"], t), c["ecc"])
    native = elements.select("number", *[v.alias(k) for k, v in K.orbit_xyz(c["a_au"], c["ecc"], c["i_deg"], c["node_deg"], c["argperi_deg"], big_e).items()]).toPandas().set_index("number")
    arrow = propagate(elements, "number", 2457123.25, 2457123.25, 1.0).toPandas().set_index("number")
    assert np.abs(native[list("xyz")] - arrow.loc[native.index, list("xyz")]).to_numpy().max() < 1e-12


def test_states_and_elements_round_trip():
    rows = np.array([r[1:7] for r in belt(20)])
    state = K.elements_to_state(*rows.T, 2457000.0, 2457000.0)
    assert np.allclose(state[:, :3], K.positions(*rows.T, 2457000.0, 2457000.0), atol=1e-13)
    back = K.state_to_elements(state, 2457000.0)
    assert np.allclose(np.array([back[c] for c in ("a_au", "ecc", "i_deg", "node_deg", "argperi_deg", "mean_anomaly_deg")]).T, rows, atol=1e-7)


def test_integration_keeps_two_body_motion_and_runs_both_ways():
    rows = np.array([r[1:7] for r in belt(5)])
    state = K.elements_to_state(*rows.T, 2457000.0, 2457000.0)
    times = np.array([2456900.0, 2457000.0, 2457300.0])
    path = integrate(state, 2457000.0, times, acceleration(()), 2.0)
    for k, t in enumerate(times):
        assert np.abs(path[k, :, :3] - K.positions(*rows.T, 2457000.0, t)).max() < 1e-8
    assert np.abs(energy(path[2]) / energy(state) - 1).max() < 1e-9
    moved = integrate(state, 2457000.0, times, acceleration(GIANTS), 2.0)
    assert 1e-7 < np.abs(moved[2] - path[2]).max() < 1e-2
    heavy = Perturber(1e-9, dict(zip(("a_au", "ecc", "i_deg", "node_deg", "argperi_deg", "mean_anomaly_deg", "epoch_jd"), [*rows[0], 2457000.0], strict=True)))
    assert np.abs(integrate(state[1:], 2457000.0, times, acceleration((), (heavy,)), 2.0) - path[:, 1:]).max() > 1e-12


def test_vertex():
    t, d = vertex_np(np.array([[0.0, 1.0, 3.0], [0.0, 1.0, 2.0], [0.0, 1.0, 2.0]]), np.array([[4.0, 1.0, 1.0], [1.0, 1.0, 1.0], [0.0, 2.0, 3.0]]))
    assert t[0] == pytest.approx(2.0) and d[0] == pytest.approx(0.0)
    assert d[1] == 1.0 and (t[2], d[2]) == (0.0, 0.0)


def test_radius_join_equals_brute_force_with_nulls_and_negative_cells(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(-1, 1, (400, 3))
    rows = [(i, 0, *map(float, v), "k") for i, v in enumerate(p)] + [(900, 0, None, 0.0, 0.0, "k"), (901, 0, float("nan"), 0.0, 0.0, "k"), (902, 1, *map(float, p[0]), "k")]
    df = spark.createDataFrame(rows, "id long, step int, x double, y double, z double, dist string")
    got = {(r.idx_i, r.idx_j) for r in radius_self_join(df, "id", ["x", "y", "z"], 0.2, ["step"]).collect()}
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    assert got == {(i, j) for i in range(400) for j in range(i + 1, 400) if d[i, j] <= 0.2}


def test_interval_overlap(spark):
    rng = np.random.default_rng(2)
    lo = rng.uniform(0, 10, 80)
    hi = lo + rng.uniform(0, 1, 80)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lo, hi, strict=True))], "id long, lo double, hi double")
    rows = interval_overlap_pairs(df, "id", "lo", "hi", 0.05, 0.5).collect()
    got = {(r.idx_i, r.idx_j) for r in rows}
    assert len(rows) == len(got)
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if lo[i] - 0.05 <= hi[j] and lo[j] - 0.05 <= hi[i]}


def test_min_per_pair_takes_the_earlier_of_ties(spark):
    df = spark.createDataFrame([(0, 1, 10.0, 0.03), (0, 1, 9.0, 0.02), (2, 5, 1.0, 0.04), (0, 1, 8.0, 0.02), (2, 5, 3.0, 0.01)], "idx_i long, idx_j long, t double, d double")
    assert sorted(map(tuple, min_per_pair(df, ["idx_i", "idx_j"], "d", "t").collect())) == [(0, 1, 8.0, 0.02), (2, 5, 3.0, 0.01)]


def test_grid_ends_inclusive(spark):
    assert [r.t_jd for r in time_grid(spark, 0.0, 2.0, 0.5).orderBy("step_idx").collect()] == [0.0, 0.5, 1.0, 1.5, 2.0]
    assert time_grid(spark, 0.0, 2.2, 0.5).count() == 5 and time_grid(spark, 0.0, 2.3, 0.5).count() == 6


def test_snapshot_choice(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 20.0), ("c", None), ("d", float("nan"))], "path string, epoch_jd double")
    assert snapshot_for_window(df, 17.0, 19.0).first().path == "b"
    assert snapshot_for_window(df.where("path = 'c'"), 1.0, 2.0).count() == 0


def test_usable_elements(spark):
    df = bodies(spark, [(1, 2.0, 0.1, 0, 0, 0, 0, None), (2, 9.0, 0.1, 0, 0, 0, 0, None), (3, float("nan"), 0.1, 0, 0, 0, 0, None), (4, 2.0, 1.2, 0, 0, 0, 0, None)])
    assert [r.number for r in usable_elements(df, 1.5, 4.0).collect()] == [1]


ENC = "number_1 int, number_2 int, designation_1 string, designation_2 string, jd_tdb double, dist_au double, rel_vel_au_day double"


def test_larger_body_comes_first_and_missing_bodies_stay(spark):
    elements = bodies(spark, [(100, 2.5, 0.1, 5, 30, 40, 50, 4.0), (200, 3.0, 0.2, 10, 60, 70, 80, 14.0), (300, 2.4, 0.1, 1, 1, 1, 1, None)])
    rows = [(100, 200, "a", "b", 2457000.0, 0.01, 0.001), (200, 100, "b", "a", 2457010.0, 0.02, 0.002), (300, 200, "c", "b", 2457020.0, 0.02, 0.0), (999, 300, "x", "c", 2457030.0, 0.02, None)]
    physical = spark.createDataFrame([(200, 5.0, None)], "number int, diameter_km double, albedo double")
    out = {r.jd_tdb: r for r in characterize(spark.createDataFrame(rows, ENC), elements, physical).collect()}
    assert [(out[t].number_1, out[t].number_2, out[t].designation_1) for t in (2457000.0, 2457010.0)] == [(100, 200, "a")] * 2
    assert out[2457010.0].diameter_2_km == 5.0 and out[2457010.0].diameter_source_2 == "measured" and out[2457010.0].diameter_source_1 == "zone_albedo"
    assert (out[2457020.0].number_1, out[2457020.0].deflection_dv_m_s) == (200, None)
    last = out[2457030.0]
    assert (last.number_1, last.h_1, last.class_1, last.diameter_source_1, last.solar_elongation_1_deg, last.gaia_observable) == (999, None, "Other", "unknown", None, False)
    assert out[2457000.0].date_utc == "2014-12-08"


def test_parts_give_the_same_rows_as_the_whole(spark):
    elements = bodies(spark, belt(12))
    rows = [(i + 1, (i * 5) % 12 + 1, None, None, 2457000.0 + i, 0.01 + i * 1e-3, 0.001) for i in range(12)]
    whole = sorted(map(repr, characterize(spark.createDataFrame(rows, ENC), elements).collect()))
    parts = [r for k in range(0, 12, 5) for r in characterize(spark.createDataFrame(rows[k : k + 5], ENC), elements).collect()]
    assert sorted(map(repr, parts)) == whole


def test_kepler_at_any_eccentricity(spark):
    from pyspark.sql import functions as F

    from nearpass.functions.kepler import eccentric_anomaly, solve_kepler

    rng = np.random.default_rng(4)
    for most in (0.4, 0.79, 0.95, 0.999999):
        m, e = rng.uniform(0, 2 * np.pi, 20_000), rng.uniform(0, most, 20_000)
        m[:100], e[100:300] = rng.uniform(0, 1e-4, 100), most
        big_e = solve_kepler(m, e)
        assert np.abs(big_e - e * np.sin(big_e) - m).max() < 1e-13
        rows = spark.createDataFrame(list(zip(m[:300].tolist(), e[:300].tolist(), strict=True)), "m double, e double")
        got = np.array([r[0] for r in rows.select(eccentric_anomaly(F.col("m"), F.col("e"))).collect()])
        assert np.abs(got - big_e[:300]).max() < 1e-7
    assert solve_kepler(np.zeros(0), np.zeros(0)).size == 0
