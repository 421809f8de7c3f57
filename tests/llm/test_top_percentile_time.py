"""Percentiles, nearest time and top N against brute force, with dirt."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nearpass.llm.nearest_time import XFastTrie, nearest_in_time
from nearpass.llm.percentiles import merge_counts, percentiles_of, value_counts
from nearpass.llm.topn import top_n

ROWS = "rec long, g string, v double, day int, value long, pid string"


def answers(df):
    return {r.g: tuple(r)[1:] for r in df.select("g", "n", "p50", "p99").collect()}


def brute(rows):
    out = {}
    for g in {r[1] for r in rows}:
        vs = sorted(v for _, v in {(r[0], r[2]) for r in rows if r[1] == g and r[2] is not None and not math.isnan(r[2])})
        pick = lambda p: vs[max(1, math.ceil(p * len(vs))) - 1] if vs else None
        out[g] = (len(vs), pick(0.5), pick(0.99))
    return out


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(1)
    rows = [(int(i), ["hot", "b", None][i % 3 if i % 9 == 0 else 0], float(np.round(rng.standard_cauchy(), 2)), int(i % 4), 0, "x") for i in range(900)]
    rows += [(5000, "none", None, 0, 0, "x"), (5001, "none", float("nan"), 0, 0, "x"), (5002, "one", -0.0, 0, 0, "x"), (5003, "one", 0.0, 0, 0, "x")]
    return rows + rows[:200]


PROBS = {"p50": 0.5, "p99": 0.99}


def test_percentiles_match_brute_force(spark, values):
    df = spark.createDataFrame(values, ROWS)
    got = answers(percentiles_of(value_counts(df, "g", "v", ["rec"]), "g", PROBS))
    assert got == brute(values)


def test_states_of_days_can_be_put_together(spark, values):
    df = spark.createDataFrame(values, ROWS)
    days = [value_counts(df.where(F.col("day") == d), "g", "v", ["rec"]) for d in range(4)]
    assert answers(percentiles_of(merge_counts(*days, group="g"), "g", PROBS)) == brute(values)


def test_bounded_state_keeps_its_error(spark, values):
    df = spark.createDataFrame(values, ROWS)
    counts = value_counts(df, "g", "v", ["rec"], rel_error=0.05)
    got, want = answers(percentiles_of(counts, "g", PROBS)), brute(values)
    assert counts.count() < value_counts(df, "g", "v", ["rec"]).count()
    for g, (n, *qs) in want.items():
        assert got[g][0] == n
        for a, b in zip(got[g][1:], qs, strict=True):
            assert (a is None and b is None) or abs(a - b) <= 0.05 * abs(b) + 1e-12


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_null_is_a_group(spark, threshold):
    """Rows without group are one group, whichever join finds its ranks."""
    rows = [(i, [None, "a", "b"][i % 3], float(i % 50), 0, 0, "x") for i in range(600)] + [(600, "none", None, 0, 0, "x")]
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = spark.conf.get(names[0])
    try:
        for name in names:
            spark.conf.set(name, threshold)
        assert answers(percentiles_of(value_counts(spark.createDataFrame(rows, ROWS), "g", "v", ["rec"]), "g", PROBS)) == brute(rows)
    finally:
        spark.conf.set(names[0], before)
        spark.conf.unset(names[1])


def test_percentiles_of_nothing(spark):
    assert percentiles_of(value_counts(spark.createDataFrame([], ROWS), "g", "v", ["rec"]), "g", PROBS).count() == 0


def test_trie_finds_neighbours_of_its_entity():
    rng = np.random.default_rng(2)
    keys = np.unique((rng.integers(0, 4, 300) << 16) | rng.integers(0, 1 << 16, 300))
    asked = (rng.integers(0, 6, 500) << 16) | rng.integers(0, 1 << 16, 500)
    asked = np.r_[asked, keys[:20]]
    before, after = XFastTrie(keys, 16).neighbours(asked)
    for q, b, a in zip(asked, before, after, strict=True):
        mine = [k for k in keys if k >> 16 == q >> 16]
        low, high = [k for k in mine if k <= q], [k for k in mine if k >= q]
        assert (keys[b] if b >= 0 else None) == (max(low) if low else None)
        assert (keys[a] if a >= 0 else None) == (min(high) if high else None)


def test_trie_of_nothing():
    before, after = XFastTrie(np.array([], dtype=np.int64), 8).neighbours(np.array([3, 5]))
    assert before.tolist() == after.tolist() == [-1, -1]


EVENTS = "recno long, k int, t double, encounter_id string"
RECORDS = "encounter_id long, k int, t double, recno string"


def nearest(spark, events, records, tolerance=31.0, piece=65_536):
    out = nearest_in_time(spark.createDataFrame(events, EVENTS), spark.createDataFrame(records, RECORDS), ["k"], "t", "t", "recno", "encounter_id", tolerance, piece)
    return {r.recno: r.encounter_id for r in out.collect()}


@pytest.mark.parametrize("piece", [65_536, 6])
def test_tie_at_the_end_of_a_piece(spark, piece):
    """Records 5 and 9 share a time; later events get 5 wherever the piece ends."""
    records = [(5, 1, 100.0, ""), (9, 1, 100.0, ""), (3, 1, 99.0, "")]
    events = [(i, 1, 101.0 + i, "") for i in range(12)]
    assert nearest(spark, events, records, piece=piece) == dict.fromkeys(range(12), 5)


@pytest.mark.parametrize("piece", [65_536, 4])
def test_many_events_between_two_records(spark, piece):
    """Events that fill pieces without a record find the record before and the one after."""
    records = [(1, 1, 130.0, ""), (2, 1, 160.0, ""), (4, 1, 160.0, ""), (3, 2, 126.0, "")]
    events = [(i, 1, 131.0 + i, "") for i in range(25)] + [(100 + i, 1, 129.0, "") for i in range(10)] + [(200 + i, 2, 124.5, "") for i in range(9)]
    expect = {i: 1 if i <= 14 and i + 1 <= 29 - i else 2 for i in range(25)}
    expect.update({100 + i: 1 for i in range(10)} | {200 + i: 3 for i in range(9)})
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    try:
        spark.conf.set(batch, 3)
        assert nearest(spark, events, records, piece=piece) == expect
        assert nearest(spark, events, [], piece=piece) == {}
    finally:
        spark.conf.set(batch, before)


@pytest.mark.parametrize("piece", [65_536, 5])
def test_nearest_matches_brute_force(spark, piece):
    rng = np.random.default_rng(4)
    records = [(int(i), int(0 if i % 3 else rng.integers(0, 9)), float(2456000 + rng.uniform(0, 900)), "") for i in range(400)]
    records += records[:50] + [(1000 + i, 0, 2456100.25, "") for i in range(7)]
    events = [(int(i), int(0 if i % 3 else rng.integers(0, 12)), float(2456000 + rng.uniform(-60, 960)), "") for i in range(200)] + [(900, 0, 2456100.25, "")]
    expect = {}
    for i, k, t, _ in events:
        near = sorted((abs(rt - t), r) for r, rk, rt, _ in records if rk == k and abs(rt - t) <= 31)
        if near:
            expect[i] = near[0][1]
    assert nearest(spark, events, records, piece=piece) == expect


def test_nearest_with_dirt_ties_and_edges(spark):
    nan = float("nan")
    records = [(5, 1, 100.0, ""), (4, 1, 110.0, ""), (6, None, 105.0, ""), (7, 1, None, ""), (8, 1, nan, ""), (None, 1, 105.0, ""), (9, 2, 131.0, "")]
    events = [(1, 1, 105.0, ""), (2, 2, 100.0, ""), (3, 2, 99.9999, ""), (4, None, 105.0, ""), (5, 1, None, ""), (6, 3, 1.0, ""), (7, 1, nan, "")]
    assert nearest(spark, events, records) == {1: 4, 2: 9}
    assert nearest(spark, [], records) == {} and nearest(spark, events, []) == {}


ITEMS = "g int, i long, s double, v double, rank string"


@pytest.mark.parametrize("parts", [1, 7])
def test_top_n_matches_brute_force(spark, parts):
    rng = np.random.default_rng(5)
    rows = [(int(0 if j % 3 == 0 else rng.integers(0, 40)), int(j), float(rng.integers(0, 6)), None if j % 7 == 0 else float(rng.integers(0, 3)), "") for j in range(3000)]
    rows += rows[:400] + [(None, 1, 0.0, 0.0, ""), (1, None, 0.0, 0.0, "")]
    df = spark.createDataFrame(rows, ITEMS).repartition(parts)
    got = top_n(df, "g", "i", [F.col("s").asc(), F.col("v").desc_nulls_last(), F.col("i").asc()], 3)
    p = pd.DataFrame({(r[0], r[1], r[2], r[3]) for r in rows if r[0] is not None and r[1] is not None}, columns=["g", "i", "s", "v"])
    p["nv"] = -p.v.fillna(-1)
    want = p.sort_values(["g", "s", "nv", "i"]).groupby("g").head(3)
    assert sorted((r.g, r.i) for r in got.collect()) == sorted(zip(want.g, want.i, strict=True))


def test_item_repeated_with_other_score_counts_once(spark):
    rows = [(1, 10, 0.0, 0.0, ""), (1, 11, 1.0, 0.0, ""), (1, 10, 2.0, 0.0, ""), (1, 12, 3.0, 0.0, "")]
    got = top_n(spark.createDataFrame(rows, ITEMS), "g", "i", [F.col("s").asc(), F.col("i").asc()], 3)
    assert sorted((r.i, r.s) for r in got.collect()) == [(10, 0.0), (11, 1.0), (12, 3.0)]
    assert top_n(spark.createDataFrame([], ITEMS), "g", "i", [F.col("s").asc()], 3).count() == 0
