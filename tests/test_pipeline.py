"""Settings, observation readers and the resumable pipeline."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearpass.config import PipelineConfig, Window, build, deep_merge, load_config
from nearpass.functions.kepler import positions
from nearpass.operators.detect import DetectRules, detect_encounters, scan
from nearpass.plans import pipeline
from nearpass.plans.pipeline import run, scan_blocks, time_blocks
from nearpass.sources import observations as obs
from tests.test_motion import belt, bodies


def test_settings(tmp_path):
    base = {"window": {"start_jd": 1.0, "end_jd": 2.0}, "detect": {"threshold_au": 0.05}}
    (tmp_path / "c.json").write_text(json.dumps(base))
    (tmp_path / "local.json").write_text(json.dumps({"detect": {"coarse_days": 0.25}}))
    got = load_config(str(tmp_path / "c.json"), str(tmp_path / "local.json"))
    assert got.detect.threshold_au == 0.05 and got.detect.coarse_days == 0.25 and got.window == Window(1.0, 2.0)
    assert load_config(str(tmp_path / "c.json"), str(tmp_path / "absent.json")).detect.coarse_days == 0.5
    assert deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    with pytest.raises(ValueError, match="window"):
        build(PipelineConfig, {})
    with pytest.raises(ValueError, match="unknown nope"):
        build(PipelineConfig, {"window": {"start_jd": 1.0, "end_jd": 2.0}, "nope": 1})
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.json"))


def test_blocks_cover_every_step_once():
    blocks = time_blocks(0.0, 10.0, 0.5, 3.0)
    steps = [t for _, a, b in blocks for t in [a + 0.5 * k for k in range(int((b - a) / 0.5 + 1.5))]]
    assert steps == [0.5 * k for k in range(21)]


def test_resumed_pipeline_equals_one_plan(spark, tmp_path, monkeypatch):
    elements = bodies(spark, belt(60)).withColumn("h_mag", F.coalesce("h_mag", F.lit(15.0)))
    rules = DetectRules(threshold_au=0.15, coarse_days=0.5, window_days=0.25, fine_days=0.01, v_max_km_s=40.0)
    config = PipelineConfig(Window(2457000.0, 2457010.0), detect=rules, block_days=3.0)
    calls = []

    def breaks_off(*args):
        calls.append(args[2])
        if len(calls) == 3:
            raise RuntimeError("lost")
        return scan(*args)

    monkeypatch.setattr(pipeline, "scan", breaks_off)
    with pytest.raises(RuntimeError, match="lost"):
        run(elements, config, f"{tmp_path}/work", f"{tmp_path}/catalog")
    side = run(elements, config, f"{tmp_path}/work", f"{tmp_path}/catalog")
    assert len(calls) == len(set(calls)) + 1  # only the block that was lost is scanned twice
    want = detect_encounters(elements, "number", 2457000.0, 2457010.0, rules)
    pairs = lambda df, a, b: sorted((min(r[a], r[b]), max(r[a], r[b]), round(r["dist_au"], 9)) for r in df.collect())
    got = pairs(spark.read.parquet(f"{tmp_path}/catalog"), "number_1", "number_2")
    assert got == pairs(want, "idx_i", "idx_j") and side["rows"] == len(got)
    assert {g["number"] for g in side["gate"]} == {1, 2, 4, 10}
    other = PipelineConfig(Window(2457000.0, 2457004.0), detect=rules, block_days=3.0)
    before = len(calls)
    scan_blocks(elements, other, f"{tmp_path}/work/candidates")
    assert len(calls) == before + 2  # another window shares no block


def test_default_rules_lose_no_pair_near_the_threshold(spark, tmp_path):
    targets = [0.0490, 0.0499, 0.04995, 0.04999, 0.05002]
    rows = []
    for k, d in enumerate(targets):  # two circular orbits that cross at 18.8 km/s, nearest midway between two steps
        half = float(np.degrees(np.arcsin(d / (5 * np.cos(np.radians(30))))))
        rows += [(2 * k + 1, 2.5, 0, 30, 60 * k, 0, half, 15.0), (2 * k + 2, 2.5, 0, 30, 60 * k + 180, 0, 180 - half, 16.0)]
    t = np.arange(2456997.75, 2457002.25, 0.001)
    xyz = [positions(*r[1:7], 2457000.0, t) for r in rows]
    deep = {(2 * k + 1, 2 * k + 2): np.linalg.norm(xyz[2 * k] - xyz[2 * k + 1], axis=1).min() for k in range(len(targets))}
    assert list(deep.values()) == pytest.approx(targets, abs=1e-6)
    run(bodies(spark, rows), PipelineConfig(Window(2456997.75, 2457002.25)), f"{tmp_path}/work", f"{tmp_path}/catalog")
    got = {(min(r.number_1, r.number_2), max(r.number_1, r.number_2)): r.dist_au for r in spark.read.parquet(f"{tmp_path}/catalog").collect()}
    assert set(got) == {k for k, d in deep.items() if d <= 0.05}
    assert all(abs(got[k] - deep[k]) < 1e-6 for k in got)


def test_observation_reader(spark, tmp_path):
    df = spark.createDataFrame([(1, 10.0, 1.0, 2.0, "false"), (1, 20.0, 1.0, 2.0, "true"), (2, 10.0, 1.0, 2.0, None), (3, 10.0, 1.0, 2.0, "false")], "Number_MP int, epoch double, ra double, dec double, is_rejected string")
    df.write.parquet(str(tmp_path / "o"))
    rows = obs.load_observations(spark, str(tmp_path / "o"))
    wanted = spark.createDataFrame([(1,), (2,), (2,)], "number int")
    assert sorted(r.number_mp for r in obs.window_of(rows, wanted, 0.0, 30.0, "is_rejected").collect()) == [1, 2]
    assert obs.window_of(rows, None, 15.0, 30.0).count() == 1
    with pytest.raises(FileNotFoundError):
        obs.load_observations(spark, str(tmp_path / "absent"))
    with pytest.raises(ValueError, match="missing columns: g_mag"):
        obs.load_observations(spark, str(tmp_path / "o"), ("g_mag",))
    assert obs.key_ranges(1, 10, 3) == [(1, 4), (5, 8), (9, 10)]
    assert obs.max_key(rows, "number_mp", 5).first().max_key == 3 and obs.max_key(rows.limit(0), "number_mp", 5).first().max_key == 5


def test_published_tables(spark):
    a = spark.createDataFrame([(1, "2")], "k int, m string")
    b = spark.createDataFrame([(1, 3.0)], "k int, other double")
    both = obs.union_tables({"t1": a, "t2": b})
    assert sorted((r.source_table, r.m, r.other) for r in both.collect()) == [("t1", "2", None), ("t2", None, 3.0)]
    m = spark.createDataFrame([(1, "2.0", 2), (1, "1.0", 1), (2, "x", 1), (None, "1", 1)], "k int, m string, n int")
    got = {r.k: r.mass_kg for r in obs.masses(m, "k", "m", "n").collect()}
    assert got[1] == pytest.approx(1e-10 * obs.SUN_KG) and got[2] is None and len(got) == 2
    d = spark.createDataFrame([("2015-03-01",), (" 2015-03",), ("2015",), ("2015-02-30",), (None,)], "d string")
    jd, precision = obs.tolerant_date(F.col("d"))
    rows = d.select(jd.alias("jd"), precision.alias("p")).collect()
    assert [(r.jd, r.p) for r in rows] == [(2457082.5, "day"), (2457096.5, "month"), (2457206.0, "year"), (None, None), (None, None)]


def test_keyed_fetch_over_jdbc(spark):
    """Key ranges read by parallel tasks, and the rows without a key."""
    from nearpass.sources.observations import key_ranges, read_keyed

    url = "jdbc:derby:memory:keyed;create=true"
    rows = [(k, k * k) for k in range(103)] + [(None, -1), (None, -2)]
    try:
        spark.createDataFrame(rows, "K int, V int").write.jdbc(url, "t", mode="overwrite", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    except Exception as error:  # a Spark without the Derby driver
        pytest.skip(str(error)[:100])
    back = read_keyed(spark, url, "t", "K", 0, 102, 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert back.rdd.getNumPartitions() == 5 and sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert key_ranges(0, 102, 4) == [(0, 25), (26, 51), (52, 77), (78, 102)]


def test_html_tables_with_open_tags_and_blanks(spark):
    from nearpass.sources.observations import html_tables

    page = "<table><tr><th>a<tr><th>b<tr><td>1&nbsp;&nbsp;2<td><b>x</b> y<tr><td></td></table>outside<table><tr><td>only</table>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "no table")], "p int, html string")
    assert [tuple(r) for r in html_tables(df, "p", "html").collect()] == [("1", 0, 0, ["1 2", "x y"]), ("1", 0, 1, [None])]
