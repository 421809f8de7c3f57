"""General data problems: spikes, snapshot changes and heavy keys against brute force."""

import numpy as np
import pandas as pd
import pytest

from nearpass.operators.heavy_keys import heavy_keys, key_states, merge_states
from nearpass.operators.snapshots import snapshot_changes, validity_intervals
from nearpass.operators.spikes import SpikeRules, constant_runs, implausible_readings

ELEMENTS = "snapshot_path string, number int, a_au double, path string"
SNAPSHOTS = "path string, epoch_jd double, number int"


def changes(spark, rows, snaps):
    out = snapshot_changes(spark.createDataFrame(rows, ELEMENTS), spark.createDataFrame(snaps, SNAPSHOTS))
    return sorted(map(tuple, out.collect()))


SNAPS = [("c", 30.0, 0), ("a", 10.0, 0), ("b", 20.0, 0), ("a", 10.0, 9), ("x", None, 0), ("y", float("nan"), 0), ("z", 40.0, 0), (None, 5.0, 0)]


def test_changes_of_every_kind_and_dirt(spark):
    rows = [
        ("a", 1, 2.0, "-"), ("b", 1, 2.0, "-"), ("c", 1, 2.0 + 4e-8, "-"),  # noise is no change
        ("a", 2, 2.0, "-"), ("a", 2, 2.0, "-"), ("b", 2, 2.1, "-"), ("c", 2, None, "-"),  # changed twice, repeated row
        ("a", 3, 2.0, "-"), ("c", 3, 2.0, "-"),  # removed, then added again
        ("b", 4, None, "-"), ("c", 4, None, "-"),  # null equals null
        ("b", 5, float("nan"), "-"), ("c", 5, 1.0, "-"),  # NaN counts as missing
        ("a", None, 9.0, "-"), ("x", 6, 1.0, "-"), (None, 7, 1.0, "-"),  # no number, no epoch, no delivery
    ]
    assert changes(spark, rows, SNAPS) == sorted([("b", 2, "changed"), ("c", 2, "changed"), ("b", 3, "removed"), ("c", 3, "added"), ("b", 4, "added"), ("b", 5, "added"), ("c", 5, "changed")])


def test_small_drift_is_judged_step_by_step(spark):
    assert changes(spark, [("a", 1, 1.0, ""), ("b", 1, 1.0 + 4e-8, ""), ("c", 1, 1.0 + 8e-8, "")], SNAPS) == []


def test_empty_deliveries(spark):
    assert changes(spark, [], SNAPS) == []
    assert changes(spark, [("a", 1, 1.0, "")], []) == []


def test_changes_match_brute_force(spark):
    rng = np.random.default_rng(3)
    paths = list("abc")
    rows = [(p, int(n), float(rng.choice([1.0, 1.5])), "") for p in paths for n in rng.choice(60, 40)]
    first = {}
    for p, n, a, _ in rows:
        first[p, n] = min(a, first.get((p, n), a))
    expect = []
    for before, later in zip(paths, paths[1:], strict=False):
        for n in range(60):
            x, y = first.get((before, n)), first.get((later, n))
            kind = "added" if x is None and y is not None else "removed" if y is None and x is not None else "changed" if x != y else None
            expect += [(later, n, kind)] if kind else []
    assert changes(spark, rows, SNAPS) == sorted(expect)


def test_intervals_of_a_key(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, ""), ("b", 1, 1.0, ""), ("c", 1, 2.0, "")], ELEMENTS)
    order = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "snapshot_path string, seq int")
    assert sorted(map(tuple, validity_intervals(rows, order, "number", "a_au", 1e-9).collect())) == [(1, 1, 2, 1.0), (1, 3, 3, 2.0)]


KEYS = "encounter_id long, number_1 int, number_2 int, dist_au double, n long"


def test_heavy_keys_with_repeats_nulls_and_a_third_in_one_key(spark):
    rows = [(i, 7 if i < 40 else 100 + i, 5 if i < 3 else None, float(i), 1) for i in range(100)]
    rows += rows[:50] + [(None, 7, 5, 0.0, 1)] * 30
    df = spark.createDataFrame(rows, KEYS)
    found = sorted(map(tuple, heavy_keys(df, ["number_1", "number_2"], "encounter_id", 0.02).collect()))
    assert found == [("number_1", 7, 40, 100), ("number_2", 5, 3, 100)]


def test_states_of_pieces_add_up(spark):
    rows = [(i, i % 3, None, float("nan") if i == 0 else 0.1 * i, 1) for i in range(30)]
    whole = key_states(spark.createDataFrame(rows, KEYS), ["number_1"], "encounter_id", "dist_au")
    parts = [key_states(spark.createDataFrame(p, KEYS), ["number_1"], "encounter_id", "dist_au") for p in (rows[:11], rows[11:])]
    key = lambda df: sorted((r.position, r.key, r.n, r.nearest) for r in df.collect())
    assert key(merge_states(parts[0].unionByName(parts[1]))) == key(whole)
    assert [r[3] for r in key(whole)] == [pytest.approx(0.3), pytest.approx(0.1), pytest.approx(0.2)]


def test_heavy_keys_of_nothing(spark):
    assert heavy_keys(spark.createDataFrame([], KEYS), ["number_1"], "encounter_id").count() == 0


READINGS = "source_id long, observation_id long, transit_id long, number_mp int, epoch double, ra double, dec double, block string"


def motion(source, transits=6, readings=8, noise=0.3, seed=0, ra0=359.9999):
    """Readings of one body that moves across 0 h, scatter ``noise`` mas."""
    rng = np.random.default_rng([seed, source])
    rows = []
    for t in range(transits):
        for k in range(readings):
            e = 100.0 + t // 3 * 40 + (t % 3) * 0.074 + k * 5.6e-5
            d = e - 100.0
            dec = 10.0 + 0.1 * d
            rows.append([source, source * 1000 + t * 20 + k, source * 100 + t, 4, e, float((ra0 + 0.3 * d + rng.normal(0, noise) / 3.6e6 / np.cos(np.radians(dec))) % 360), float(dec + rng.normal(0, noise) / 3.6e6), "clash"])
    return rows


def flagged(spark, rows, rules=None):
    return {(r.reading, r.kind) for r in implausible_readings(spark.createDataFrame([tuple(r) for r in rows], READINGS), rules).collect()}


def test_clean_source_has_no_case(spark):
    assert flagged(spark, motion(1) + motion(2, noise=30.0)) == set()


@pytest.mark.parametrize("block_rows", [50_000, 10])
def test_every_kind_of_bad_reading(spark, block_rows):
    rows = motion(1) + motion(2, noise=30.0) + motion(3)
    rows[10][6] += 25 * 0.3 / 3.6e6  # spike in dec
    rows[48 + 11][5] += 25 * 30.0 / 3.6e6  # spike in ra of a noisy source
    rows[20][6] = 99.0  # outside
    rows[21][3] = 8  # another number
    for k in range(33, 37):
        rows[k][5] = rows[32][5]  # stuck: 32 is the first of five
    for r in rows[96 + 8 : 96 + 16]:
        r[5] /= 15.0  # a whole transit in hours
    expect = {(rows[10][1], "path"), (rows[59][1], "path"), (rows[20][1], "range"), (rows[21][1], "label")}
    expect |= {(rows[k][1], "run") for k in range(33, 37)} | {(r[1], "path") for r in rows[104:112]}
    assert flagged(spark, rows, SpikeRules(block_rows=block_rows)) >= expect
    if block_rows > 100:
        assert flagged(spark, rows) == expect


def test_blocks_and_batches_change_nothing(spark, sf):
    """Sources of some ninety readings, whole and in blocks of forty."""
    df = spark.read.parquet(f"{sf}/sso_observation.parquet")
    found = [{(r.reading, r.kind) for r in implausible_readings(df, rules).collect()} for rules in (SpikeRules(), SpikeRules(block_rows=40))]
    assert found[0] == found[1] and len(found[0]) > 5


def test_a_profile_of_its_own(spark):
    """A source whose transits are all traced at an uneven pace: the component learns it, and a spike shows."""
    rows = motion(1, transits=60)
    for k, r in enumerate(rows):
        late = 8e-6 * (-1) ** (k % 8)
        r[5], r[6] = r[5] + 0.3 * late, r[6] + 0.1 * late
    rows[100][6] += 25 * 0.3 / 3.6e6
    assert flagged(spark, rows) == {(rows[100][1], "path")}
    assert flagged(spark, rows, SpikeRules(prior_rows=1e9)) == set()  # along a straight line the bend passes for scatter


def test_readings_with_nulls_repeats_and_no_rows(spark):
    rows = motion(1)
    rows += rows[:5]  # repeated
    rows[7][5] = None
    rows[8][6] = float("nan")
    rows[9][3] = None
    rows += [[None, 1, 1, 4, 100.0, 400.0, 0.0, ""], [9, None, 1, 4, 100.0, 400.0, 0.0, ""], [9, 77, None, 4, None, -1.0, 0.0, ""], [9, 78, None, 4, 100.0, None, None, ""]]
    assert flagged(spark, rows) == {(77, "range")}
    assert flagged(spark, []) == set()


def test_equal_labels_keep_the_smaller(spark):
    rows = motion(1, transits=2, readings=4)
    for r in rows[4:]:
        r[3] = 5
    assert {k for k in flagged(spark, rows) if k[1] == "label"} == {(r[1], "label") for r in rows[4:]}


def test_constant_runs():
    x = np.array([1, 1, 1, 2, 2, 2, 2, np.nan, np.nan, np.nan, np.nan, 3])
    assert constant_runs(x, 4).tolist() == [False] * 4 + [True] * 3 + [False] * 5
    assert constant_runs(np.array([]), 4).tolist() == []
    assert pd.Series(constant_runs(np.array([5.0] * 4), 4)).sum() == 3
