"""Detection over the reference's whole window against dense brute force."""

import numpy as np
import pytest

from nearpass.functions.kepler import positions
from nearpass.plans import detection, registry


@pytest.fixture(scope="module")
def places(spark, sf):
    rows = detection.current_elements(spark, sf, detection.FULL).dropna(subset=["a_au", "ecc"]).orderBy("number").toPandas()
    args = [rows[c].to_numpy(float)[:, None] for c in ("a_au", "ecc", "i_deg", "node_deg", "argperi_deg", "mean_anomaly_deg", "epoch_jd")]
    return rows["number"].to_numpy(), lambda t: positions(*args, np.asarray(t)[None, :])


def minima(places, t):
    """``pair: (smallest distance, its time)`` on the grid ``t`` for all pairs."""
    numbers, at = places
    deep, when = np.full((len(numbers),) * 2, np.inf), np.zeros((len(numbers),) * 2)
    for x, now in zip(np.swapaxes(at(t), 0, 1), t, strict=True):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        less = d < deep
        deep[less], when[less] = d[less], now
    return {(int(numbers[i]), int(numbers[j])): (deep[i, j], when[i, j]) for i in range(len(numbers)) for j in range(i + 1, len(numbers))}


def test_window_is_the_reference_s(spark, sf):
    assert registry.QUERIES["time_grid_full"](spark, sf).count() == 2077
    assert detection.FULL.end_jd - detection.FULL.start_jd == pytest.approx(1038, abs=1e-3)


def test_full_coarse_detection_equals_brute_force_in_any_blocks(spark, sf, places, monkeypatch):
    t = detection.FULL.start_jd + 0.5 * np.arange(2077)
    want = {k: v for k, v in minima(places, t).items() if v[0] <= detection.RADIUS}
    assert any(not detection.START <= v[1] <= detection.END for v in want.values())
    monkeypatch.setattr(detection, "BLOCK_ROWS", len(places[0]) * 700)
    got = {(r.idx_i, r.idx_j): r for r in registry.QUERIES["encounter_detect_full"](spark, sf).collect()}
    assert set(got) == set(want)
    for k, (d, when) in want.items():
        assert got[k].dist_au == pytest.approx(d, abs=1e-7) and got[k].t_jd == pytest.approx(when, abs=1e-6)


def test_recentred_detection_covers_the_reference_s_window(spark, sf, places):
    t = np.arange(detection.FULL.start_jd, detection.FULL.end_jd, 0.05)
    dense = {k: v for k, v in minima(places, t).items() if v[0] <= detection.RADIUS - 1e-4}
    got = {(r.number_1, r.number_2): r for r in registry.QUERIES["encounter_refine_recentre"](spark, sf).collect()}
    assert dense and set(dense) <= set(got)
    assert all(got[k].dist_au <= d + 1e-6 and abs(got[k].jd_tdb - when) < 0.1 for k, (d, when) in dense.items())
