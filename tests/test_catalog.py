"""Catalogue questions, matching, merging, samples, series, sources, sinks and streams."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearpass.functions import physics as P
from nearpass.functions import timescale as TS
from nearpass.operators import catalog, crossmatch, hybrid, sampling, timeseries
from nearpass.schema import CATALOG, ELEMENTS, ENCOUNTERS, conform, empty, require
from nearpass.session import broadcast_if_small, stage
from nearpass.sources import elements as src
from nearpass.sources import sinks
from nearpass.streaming import live

CAT = "encounter_id long, number_1 int, number_2 int, dist_au double, date_utc string, gaia_observable boolean, class_1 string, class_2 string"
FOUR = [(1, 1, 11, 0.005, "2015-01-01", True, "MBA", "MBA"), (2, 4, 17, 0.008, "2015-04-10", True, "MBA", "NEA"), (3, 2, 23, 0.003, "2015-07-19", False, "MBA", "MBA"), (4, 100, 200, 0.009, "2015-10-27", True, "MBA", "MBA")]


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame(FOUR, CAT)


def test_filters(four):
    ids = lambda **k: sorted(r.encounter_id for r in catalog.filter_encounters(four, **k).collect())
    assert ids() == [1, 2, 3, 4]
    assert ids(body_ids=[1, 4]) == [1, 2] and ids(max_dist=0.001) == [] and ids(date_from="2015-04-01", date_to="2015-08-01") == [2, 3]
    assert ids(min_dist=0.005, max_dist=0.008) == [1, 2] and ids(observable=False) == [3] and ids(classes=["NEA"]) == [2]
    text = four.withColumn("gaia_observable", F.upper(F.col("gaia_observable").cast("string")))
    assert sorted(r.encounter_id for r in catalog.filter_encounters(text, observable=True).collect()) == [1, 2, 4]


def test_either_side_reaches_the_scan(four, tmp_path, spark):
    four.write.parquet(str(tmp_path / "c"))
    plan = catalog.filter_encounters(spark.read.parquet(str(tmp_path / "c")), body_ids=[1]).select("encounter_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "ReadSchema: struct<encounter_id:bigint,number_1:int,number_2:int>" in plan


def test_top_puts_missing_last(spark, four):
    more = four.unionByName(spark.createDataFrame([(5, 1, 2, None, None, True, None, None), (6, 1, 2, float("nan"), None, True, None, None)], CAT))
    assert [r.encounter_id for r in catalog.top_encounters(more, 6).collect()] == [3, 1, 2, 4, 5, 6]
    assert [r.encounter_id for r in catalog.top_encounters(more, 5, ascending=False).collect()] == [4, 2, 1, 3, 5]


def test_gate_lists_missing_bodies(four):
    rows = {r.number: (r.n, r.nearest_au, r.missing) for r in catalog.major_body_gate(four).collect()}
    assert rows == {1: (1, 0.005, False), 2: (1, 0.003, False), 4: (1, 0.008, False), 10: (0, None, True)}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 1.0, 2.0, None, float("nan"))], "v double")
    assert [r.n for r in catalog.equal_width_histogram(df, "v", 0.0, 1.0, 2).orderBy("bin").collect()] == [1, 2]
    assert [r.n for r in catalog.equal_width_histogram(df, "v", 0.0, 1.0, 2, clip=True).orderBy("bin").collect()] == [2, 3]
    assert [r.n for r in catalog.equal_width_histogram(df.limit(0), "v", 0.0, 1.0, 2).orderBy("bin").collect()] == [0, 0]


def test_diff_and_outcomes(spark):
    a = spark.createDataFrame([(1, 2, 0.1), (3, 2, 0.2), (None, 2, 0.1)], "number_1 int, number_2 int, dist_au double")
    b = spark.createDataFrame([(2, 1, 0.3), (5, 4, 0.2)], "number_1 int, number_2 int, dist_au double")
    got = {(r.lo, r.hi): r.side for r in crossmatch.catalog_diff(crossmatch.pair_minima(a), crossmatch.pair_minima(b)).collect()}
    assert got == {(1, 2): "both", (2, 3): "a", (4, 5): "b"}
    published = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 1, 3), (4, 1, 9), (5, 8, 9), (6, None, None)], "recno int, lo long, hi long")
    out = {r.recno: r.outcome for r in crossmatch.literature_outcomes(published, crossmatch.pair_minima(a), crossmatch.universe_of(a), 0.15).collect()}
    assert out == {1: "recovered", 2: "beyond_threshold", 3: "missed", 4: "one_body_unknown", 5: "both_unknown", 6: "both_unknown"}


def test_wilson(spark):
    low, high = P.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(0, 0), (5, 10), (10, 10)], "k long, n long").select(low.alias("a"), high.alias("b")).collect()
    assert rows[0].a is None and rows[1].a == pytest.approx(0.2366, abs=1e-4) and rows[1].b == pytest.approx(0.7634, abs=1e-4) and rows[2].b == pytest.approx(1.0)


def test_physics(spark):
    from nearpass.functions.kepler import orbit_class

    df = spark.createDataFrame([(2.0, 0.5), (2.5, 0.1), (5.205, 0.0), (5.5, 0.0), (10.0, 0.1), (30.0, 0.1), (40.0, 0.1), (1.5, 0.0), (None, 0.1)], "a double, e double")
    assert [r[0] for r in df.select(orbit_class(F.col("a"), F.col("e"))).collect()] == ["NEA", "MBA", "Trojan", "Trojan", "Centaur", "Centaur", "TNO", "Other", "Other"]
    one = spark.range(1)
    v = lambda c: one.select(c.alias("v")).first().v
    assert v(P.diameter_from_h(F.lit(15.0))) == pytest.approx(1329 / math.sqrt(0.14) * 1e-3)
    assert v(P.deflection_dv(F.lit(100.0), F.lit(0.0), F.lit(1.0), F.lit(2.0))) is None
    density = v(P.bulk_density_g_cm3(P.mass_from_diameter(F.lit(100.0)), F.lit(100.0)))
    assert density == pytest.approx(1.5)
    assert v(P.deflection_muas(F.lit(1e18), F.lit(0.0), F.lit(1.0))) is None
    east, north = P.tangent_residual_mas(F.lit(0.0), F.lit(1.0), F.lit(359.999), F.lit(1.0))
    assert v(east) == pytest.approx(3600 * math.cos(math.radians(1)), rel=1e-6) and v(north) == 0.0
    p = {"x": F.lit(0.3), "y": F.lit(0.4), "z": F.lit(0.5)}
    back = P.equatorial_to_ecliptic(P.ecliptic_to_equatorial(p))
    assert [v(back[k]) for k in "xyz"] == pytest.approx([0.3, 0.4, 0.5])
    turned = P.rotate(P.rotate(p, "z", 30.0), "z", -30.0)
    assert [v(turned[k]) for k in "xyz"] == pytest.approx([0.3, 0.4, 0.5])
    assert v(P.mahalanobis2(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(4.0), F.lit(0.0))) == pytest.approx(2.0)
    assert v(P.along_scan_variance(F.lit(1.0), F.lit(2.0), F.lit(5.0), F.lit(90.0))) == pytest.approx(1.0)


def test_time_scales(spark):
    texts = ["2016-02-29", "2015-02-29", " 2015-03-01T06:00 ", "2016.5", "2015.0", "03/01/2015", "", None, "2015-03-01T25:00", "2015"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(TS.parse_event_jd(F.col("t"))).collect()]
    assert got == [2457447.5, None, 2457082.75, 2457388.5 + 183, 2457023.5, None, None, None, None, None]
    jd = spark.createDataFrame([(2457204.4999,), (2457204.5001,), (2457754.6,)], "jd double")
    there = jd.select("jd", TS.utc_to_tdb(F.col("jd")).alias("tdb")).select("jd", "tdb", TS.tdb_to_utc(F.col("tdb")).alias("back"))
    for r, s in zip(there.collect(), (67.184, 68.184, 69.184), strict=True):
        assert (r.tdb - r.jd) * 86400 == pytest.approx(s, abs=1e-4) and r.back == pytest.approx(r.jd, abs=1e-9)
    assert spark.range(1).select(TS.tdb_to_tcb(TS.tcb_to_tdb(F.lit(2457000.5)))).first()[0] == pytest.approx(2457000.5, abs=1e-8)


def test_best_solution_prefers_clean_then_new(spark):
    schema = "number_1 int, number_2 int, t_min_kepler_jd double, error_message string, nbody_converged boolean, refine_day date, shard_id int, dist_au_nbody double, rel_vel_nbody double, delta_dist_au double"
    from datetime import date

    rows = [(1, 2, 1.0, None, False, date(2024, 1, 3), 0, 0.3, 0.0, 0.0), (1, 2, 1.0, None, True, date(2024, 1, 1), 0, 0.1, 0.0, 0.0), (1, 2, 1.0, "x", True, date(2024, 1, 9), 0, 0.9, 0.0, 0.0), (1, 2, 1.0, None, True, date(2024, 1, 2), 1, 0.2, 0.0, 0.0), (3, 4, 1.0, "x", False, date(2024, 1, 1), 0, None, None, None)]
    best = hybrid.best_solution(spark.createDataFrame(rows, schema))
    assert {r.number_1: r.dist_au_nbody for r in best.collect()} == {1: 0.2, 3: None}
    base = spark.createDataFrame([(1, 2, 1.0, 0.5, 0.1), (3, 4, 1.0, 0.6, 0.1)], "number_1 int, number_2 int, t_min_kepler_jd double, dist_au double, rel_vel_au_day double")
    assert {r.number_1: (r.dist_au, r.refinement_method) for r in hybrid.hybrid_merge(base, best).collect()} == {1: (0.2, "nbody"), 3: (0.6, "kepler")}
    counts = hybrid.coverage(base, best.where("nbody_converged"))
    with pytest.raises(ValueError, match="1 of 2"):
        hybrid.require_complete(counts)
    hybrid.require_complete(counts, allow_incomplete=True)


def test_ranks_fifths_and_quantiles(spark):
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(size=203), 1)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double")
    order = sorted(range(203), key=lambda k: (v[k], k))
    fifth = {r.i: r.fifth for r in hybrid.quintiles(df, "v", "i").collect()}
    want = np.repeat(np.arange(1, 6), [41, 41, 41, 40, 40])
    assert [fifth[k] for k in order] == want.tolist()
    q = hybrid.quantiles(df, "v", {"a": 0.5, "b": 0.9}).first()
    assert (q.n, q.largest) == (203, v.max()) and [q.a, q.b] == pytest.approx(np.quantile(v, [0.5, 0.9]))
    none = hybrid.quantiles(df.limit(0), "v", {"a": 0.5}).first()
    assert (none.n, none.a) == (0, None)


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("s", F.col("id") % 7)
    draw = lambda d: sorted(r.id for r in sampling.hash_sample(d, ["id"], 20, 3).collect())
    assert draw(df) == draw(df.repartition(13)) != sorted(r.id for r in sampling.hash_sample(df, ["id"], 20, 4).collect())
    strata = sampling.stratified_sample(df, ["s"], ["id"], 5, least=100).groupBy("s").count().collect()
    assert all(r["count"] == 5 for r in strata) and len(strata) == 7
    assert sampling.hash_sample(df.limit(3), ["id"], 20).count() == 3
    edges = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,)], "x double").select(sampling.band(F.col("x"), [1.0, 2.0])).collect()
    assert [r[0] for r in edges] == [0, 1, 2, None]


@pytest.mark.parametrize("block", [None, 1.0])
def test_sessions_across_blocks(spark, block):
    times = [0.0, 0.005, 0.015, 0.0251, 0.995, 1.0, 1.004, 1.5, 1.51]
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(times)] + [("other", 99, 1.0)], "k string, i long, t double")
    got = {r.i: r.session for r in timeseries.gap_sessions(df, "k", "t", 0.01, "i", block).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 0.0, 3: 0.0251, 4: 0.995, 5: 0.995, 6: 0.995, 7: 1.5, 8: 1.5 if 1.51 - 1.5 <= 0.01 else 1.51, 99: 1.0}


def test_step_model_finds_a_step(spark):
    rng = np.random.default_rng(1)
    x = np.linspace(-1, 1, 60)
    rows = [("step", float(a), float(0.3 * a + (a >= 0) * 2 + e)) for a, e in zip(x, rng.normal(0, 0.1, 60), strict=True)] + [("line", float(a), float(0.3 * a + e)) for a, e in zip(x, rng.normal(0, 0.1, 60), strict=True)] + [("few", 0.0, 1.0)]
    out = {r.k: r.delta_bic for r in timeseries.step_bic(spark.createDataFrame(rows, "k string, x double, y double"), "k", "x", "y", F.lit(0.0)).collect()}
    assert out["step"] > 50 and out["line"] < 2 and out["few"] is None
    design = np.stack([np.ones(60), x, x >= 0], 1)
    y = np.array([r[2] for r in rows[:60]])
    rss = lambda m: float(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum())
    assert out["step"] == pytest.approx(60 * math.log(rss(design[:, :2]) / 60) - 60 * math.log(rss(design) / 60) - math.log(60), rel=1e-6)


LINE = "{:<7} {:>5} {:>5} {:<5} {:>9} {:>10} {:>10} {:>10} {:>10}             {:>11}" + " " * 63 + "{:<28}"


def line(number, a, name, h="3.34", g="0.12", e="0.0785"):
    return LINE.format(number, h, g, "K205A", "45.00000", "73.597", "80.306", "10.587", e, a, name)


def test_element_file(spark, tmp_path):
    rows = [line("1", "2.7691652", "(1) Ceres"), line("J98S00A", "2.50", "2014 AA1"), line("00588", "5.2038", "(588) Achilles"), line("A0001", "2.2", "(100001) X", h="", g=""), "too short", line("4", "not", "x")]
    path = tmp_path / "MPCORB.DAT"
    path.write_text("\n".join(rows) + "\n")
    got = {r.number: r for r in src.read_elements(spark, str(path), a_min=1.5, a_max=4.0).collect()}
    assert set(got) == {1, 100001} and got[100001].h_mag is None and got[1].designation == "(1) Ceres"
    assert got[1].epoch_jd == 2458979.5 and got[1].a_au == 2.7691652 and got[1].argperi_deg == 73.597
    assert src.read_elements(spark, str(path), only_numbered=False).count() == 4
    assert src.first_epoch(spark, str(path)) == 2458979.5
    (tmp_path / "empty").write_text("")
    assert src.read_elements(spark, str(tmp_path / "empty")).collect() == []
    with pytest.raises(ValueError, match="no element line"):
        src.first_epoch(spark, str(tmp_path / "empty"))
    with pytest.raises(Exception, match="(?i)path"):
        src.read_elements(spark, str(tmp_path / "absent")).count()


def test_packed_values(spark):
    df = spark.createDataFrame([("123", "K205A"), ("A0001", "I00C V"[:5]), ("z9999", "J9611"), ("J98S00A", "K202V"), ("", None), (None, "")], "n string, e string")
    rows = df.select(src.unpack_number(F.col("n")).alias("n"), src.unpack_epoch(F.col("e")).alias("e")).collect()
    assert [r.n for r in rows] == [123, 100001, 619999, None, None, None]
    assert [r.e for r in rows] == [2458979.5, None, 2450083.5, None, None, None]


def test_registry_and_documents(spark, tmp_path):
    (tmp_path / "mpcorb_archive").mkdir()
    for name, meta in (("a", {"snapshot_date": "2015-01-01", "epoch_jd": 20.0}), ("b", {"snapshot_date": "x"}), ("c", {"epoch_jd": 10.0})):
        p = tmp_path / "mpcorb_archive" / f"MPCORB_{name}.DAT"
        p.write_text("x")
        p.with_name(p.name + ".json").write_text(json.dumps(meta))
    (tmp_path / "MPCORB.DAT").write_text("no sidecar")
    assert [r.epoch_jd for r in src.snapshot_registry(spark, str(tmp_path)).collect()] == [10.0, 20.0]
    docs = tmp_path / "fits"
    docs.mkdir()
    (docs / "1.json").write_text('{"mass": 1.0, "sigma": 0.1}')
    (docs / "2.json").write_text('{"mass": null, "sigma": 0.1}')
    (docs / "3.json").write_text("{broken")
    assert src.json_documents(spark, str(docs), ["mass", "sigma"]).count() == 1
    assert src.json_documents(spark, str(docs), ["other"]).count() == 0
    payload = spark.createDataFrame([('{"fields": ["spkid", "diameter"], "data": [["1", "939.4"], ["2", null], [null, "3"]]}',)], "body string")
    got = src.column_payload(payload, "body", "spkid").select("spkid", F.element_at("row", F.lit("diameter")).try_cast("double").alias("d")).collect()
    assert sorted(map(tuple, got)) == [("1", 939.4), ("2", None)]
    lists = spark.createDataFrame([("  10 Hygiea", "20 | 30 |40..."), ("1998 SF36", "1|2")], "name string, targets string")
    assert sorted(map(tuple, src.pipe_pairs(lists, "name", "targets").collect())) == [(10, "20", True), (10, "30", True), (10, "40", True)]
    gaps = src.interval_gaps(spark.createDataFrame([(1, 5), (2, 3), (8, 9), (10, 12)], "a int, b int"), "a", "b").collect()
    assert [tuple(r) for r in gaps] == [(6, 7)]


def test_typed_write_and_sidecar(spark, tmp_path, four):
    side = sinks.write_catalog(four, str(tmp_path / "out"), "run-1", {"k": 1})
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == [f.name for f in CATALOG.fields if f.name in ("run_id", *four.columns)]
    assert side["rows"] == 4 and side["observable"] == 3 and json.loads((tmp_path / "out.json").read_text())["nearest_au"] == 0.003
    (tmp_path / "out.json").unlink()
    assert sinks.backfill_sidecar(spark, str(tmp_path / "out"))["rows"] == 4
    assert sinks.write_catalog(four, str(tmp_path / "csv"), "run-1", fmt="csv")["rows"] == 4
    assert sinks.stage_key(a=1, b=[2]) == sinks.stage_key(b=[2], a=1) != sinks.stage_key(a=2, b=[2])
    assert "| — |" in sinks.markdown(spark.createDataFrame([(None, 1e6)], "a double, b double"))


def test_chunks_resume_and_remember_empty_ones(spark, tmp_path):
    path = str(tmp_path / "shards")
    chunks = lambda *ids: spark.createDataFrame([(i,) for i in ids], "chunk_id bigint")
    rows = lambda *r: spark.createDataFrame(list(r), "chunk_id bigint, v int")
    sinks.write_chunks(chunks(0, 20), rows((0, 1), (0, 2)), path)
    sinks.write_chunks(chunks(0, 20, 40), rows((0, 9), (40, 3)), path)
    assert sorted(r.chunk_id for r in sinks.done_chunks(spark, path).collect()) == [0, 20, 40]
    assert sorted((r.chunk_id, r.v) for r in sinks.read_chunks(spark, path).collect()) == [(0, 1), (0, 2), (40, 3)]


def test_schema_helpers(spark):
    df = spark.createDataFrame([("1", 2)], "dist_au string, extra int")
    assert conform(df, ENCOUNTERS).dtypes == [("dist_au", "double")]
    assert empty(spark, ELEMENTS).count() == 0
    with pytest.raises(ValueError, match="missing columns: a"):
        require(df, "a")


def test_stage_and_bounded_broadcast(spark):
    df = spark.range(100)
    assert stage(df).count() == 100
    assert "broadcast" in broadcast_if_small(df, 100)._jdf.queryExecution().logical().toString().lower()
    assert "hint" not in broadcast_if_small(df, 99)._jdf.queryExecution().logical().toString().lower()


def test_streams_match_batch(spark, tmp_path):
    from tests.test_motion import ENC, belt, bodies

    elements = bodies(spark, belt(12))
    rows = [(i % 12 + 1, (i * 5) % 12 + 1, None, None, 2457000.0 + i, 0.01 + i * 1e-3, 0.001) for i in range(30)]
    df = spark.createDataFrame(rows, ENC)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    from nearpass.operators.characterize import characterize

    stream = live.encounter_stream(spark, str(tmp_path / "in"), df.schema, 1)
    live.characterize_stream(stream, elements, None, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch_id")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, characterize(df, elements).collect()))
    query = live.gate_stream(live.encounter_stream(spark, str(tmp_path / "in"), df.schema, 1), "gate", str(tmp_path / "c2"))
    query.awaitTermination(120)
    got = {r.number: (r.n, r.nearest_au) for r in spark.table("gate").collect()}
    want = {r.number: (r.n, r.nearest_au) for r in catalog.major_body_gate(df).where("NOT missing").collect()}
    assert got == want


def test_spread_moves_only_scans_of_few_partitions(spark, tmp_path):
    from nearpass.session import spread

    one = spark.range(100).coalesce(1)
    one.write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert spread(scan, "id").rdd.getNumPartitions() == 4
    wide = spark.range(0, 100, 1, 9)
    assert spread(wide, "id") is wide
    shuffled = scan.groupBy("id").count()
    assert spread(shuffled, "id") is shuffled
