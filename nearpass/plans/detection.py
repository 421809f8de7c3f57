"""Queries from elements to encounters, and the enrichment of encounters, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpass.config import PipelineConfig, Window
from nearpass.functions.kepler import orbit_class
from nearpass.functions.physics import clean, diameter
from nearpass.functions.timescale import gaia_epoch_to_tdb, jd_to_iso_date, tdb_to_tcb, utc_to_tdb
from nearpass.operators.characterize import characterize
from nearpass.operators.detect import DetectRules, named_encounters, propagate, refine, scan, snapshot_for_window, three_steps, time_grid, usable_elements, vertex, with_orbits
from nearpass.operators.fits import nbody_refine
from nearpass.plans.pipeline import scan_blocks
from nearpass.session import shuffle_partitions, stage, stage_folder, table

#: The window of the queries with SQL, which is quadratic in the bodies.
START, END, STEP = 2457200.5, 2457212.5, 0.5
SHORT = Window(START, END)
#: The reference's window, 2014-07-25 to 2017-05-28 UTC, in TDB: 2077 steps.
FULL = Window(2456863.5 + 67.184 / 86400, 2457901.5 + 69.184 / 86400)
RADIUS = 0.05
#: Positions that a block of time holds for each partition of the session's shuffles.
BLOCK_ROWS = 20_000_000
_COLUMNS = ["designation", "h_mag", "g_slope", "epoch_jd", "mean_anomaly_deg", "argperi_deg", "node_deg", "i_deg", "ecc", "a_au"]


def current_elements(spark: SparkSession, sf: str, window: Window = SHORT) -> DataFrame:
    """One row per numbered body of the delivery nearest to the window."""
    chosen = snapshot_for_window(table(spark, sf, "mpcorb_snapshot"), window.start_jd, window.end_jd).select(F.col("path").alias("snapshot_path"))
    rows = usable_elements(table(spark, sf, "elements").join(F.broadcast(chosen), "snapshot_path", "left_semi"))  # one path
    return rows.groupBy("number").agg(*[F.min(c).alias(c) for c in _COLUMNS])


def coarse_rules(**changes: object) -> DetectRules:
    return DetectRules(threshold_au=RADIUS, coarse_days=STEP, v_max_km_s=0.0, refine=False, decimals=9, **changes)


def candidates(elements: DataFrame, rules: DetectRules, window: Window) -> DataFrame:
    """Closest coarse step of each pair; a long window goes in blocks of as many steps as the bodies allow."""
    if window == SHORT:
        return scan(elements, "number", START, END, rules)
    spark = elements.sparkSession
    elements = stage(elements, "bodies")
    steps = max(1, BLOCK_ROWS * shuffle_partitions(spark) // max(1, elements.count()))
    return scan_blocks(elements, PipelineConfig(window, detect=rules, block_days=steps * rules.coarse_days), stage_folder(spark, "candidates"))


def detect(spark: SparkSession, sf: str, window: Window = SHORT) -> DataFrame:
    found = candidates(current_elements(spark, sf, window), coarse_rules(), window)
    return found.select("idx_i", "idx_j", F.col("t_coarse_jd").alias("t_jd"), F.col("d_coarse_au").alias("dist_au"))


def snapshot_selection(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_for_window(table(spark, sf, "mpcorb_snapshot"), START, END)


def grid(spark: SparkSession, sf: str, window: Window = SHORT) -> DataFrame:
    return time_grid(spark, window.start_jd, window.end_jd, STEP)


def kepler_propagate(spark: SparkSession, sf: str) -> DataFrame:
    at = propagate(current_elements(spark, sf), "number", START, START, STEP)
    return at.select("number", *[F.round(c, 8).alias(c) for c in "xyz"])


def kepler_propagate_full(spark: SparkSession, sf: str) -> DataFrame:
    """Every body at every step of the reference's window."""
    elements = current_elements(spark, sf, FULL)
    at = propagate(elements.repartition(shuffle_partitions(spark), "number"), "number", FULL.start_jd, FULL.end_jd, STEP)
    return at.select("number", "step_idx", *[F.round(c, 8).alias(c) for c in "xyz"])


def encounter_prefiltered(spark: SparkSession, sf: str, window: Window = SHORT) -> DataFrame:
    found = candidates(current_elements(spark, sf, window), coarse_rules(max_da=0.5, max_di=30.0), window)
    return found.select("idx_i", "idx_j", F.col("d_coarse_au").alias("dist_au"))


def encounter_radial_overlap(spark: SparkSession, sf: str, window: Window = SHORT) -> DataFrame:
    """Detected pairs whose orbits' heliocentric ranges come within the threshold."""
    return candidates(current_elements(spark, sf, window), coarse_rules(radial=True), window).select("idx_i", "idx_j")


def encounter_refine_vertex(spark: SparkSession, sf: str, window: Window = SHORT) -> DataFrame:
    """Parabola through the coarse minimum and its neighbours, for minima inside the grid."""
    elements = stage(current_elements(spark, sf, window), "bodies")  # read by the scan and for both bodies of a pair
    pairs = candidates(elements, coarse_rules(), window).select("idx_i", "idx_j", F.col("t_coarse_jd").alias("t_jd"))
    rows = three_steps(pairs, elements, "number", window.start_jd, window.end_jd, STEP)
    t, d = vertex(*[F.col(c) for c in ("t0", "t1", "t2", "d0", "d1", "d2")])
    return rows.select("idx_i", "idx_j", F.round(t, 5).alias("t_jd"), F.round(d, 7).alias("dist_au"))


def refined_pairs(elements: DataFrame) -> DataFrame:
    """Widened scan of the reference's window in blocks, and fine refinement."""
    rules = DetectRules(threshold_au=RADIUS, coarse_days=STEP)
    rules.check()
    return refine(candidates(elements, rules, FULL), elements, "number", rules)


def encounter_refine_recentre(spark: SparkSession, sf: str) -> DataFrame:
    """The full pipeline over the reference's window: widened scan, fine refinement, names."""
    elements = current_elements(spark, sf, FULL)
    return named_encounters(refined_pairs(elements), elements)


def nbody_refined(spark: SparkSession, sf: str) -> DataFrame:
    """Detected pairs of the reference's window refined once more under the giant planets."""
    elements = current_elements(spark, sf, FULL)
    return nbody_refine(with_orbits(refined_pairs(elements), elements, "number"), ["idx_i", "idx_j"])


def orbit_classes(spark: SparkSession, sf: str) -> DataFrame:
    return current_elements(spark, sf).select("number", orbit_class(F.col("a_au"), F.col("ecc")).alias("orbit_class"))


def measured_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """``number, diameter_km, albedo`` of bodies whose size the catalogue calls measured."""
    rows = table(spark, sf, "encounters_catalog")
    parts = [rows.where(F.col(f"diameter_source_{s}") == "measured").select(F.col(f"number_{s}").alias("number"), F.col(f"diameter_{s}_km").alias("d")) for s in "12"]
    return parts[0].unionByName(parts[1]).where("number IS NOT NULL").groupBy("number").agg(F.min(clean(F.col("d"))).alias("diameter_km"), F.lit(None).cast("double").alias("albedo"))


def diameter_priority(spark: SparkSession, sf: str) -> DataFrame:
    rows = current_elements(spark, sf).join(measured_sizes(spark, sf), "number", "left")
    size, source = diameter(clean(F.col("h_mag")), F.col("a_au"), F.col("diameter_km"), F.col("albedo"))
    return rows.select("number", F.round(size, 6).alias("diameter_km"), source.alias("source"))


def characterized(spark: SparkSession, sf: str) -> DataFrame:
    """Every encounter of the catalogue characterised anew from elements and measured sizes."""
    rows = table(spark, sf, "encounters_catalog")
    once = rows.select("number_1", "number_2", F.lit(None).cast("string").alias("designation_1"), F.lit(None).cast("string").alias("designation_2"), "jd_tdb", clean(F.col("dist_au")).alias("dist_au"), clean(F.col("rel_vel_au_day")).alias("rel_vel_au_day")).distinct()
    out = characterize(once, current_elements(spark, sf), measured_sizes(spark, sf))
    digits = {"dist_km": 2, "rel_vel_km_s": 5, "h_1": 3, "h_2": 3, "diameter_1_km": 4, "diameter_2_km": 4, "solar_elongation_deg": 4, "solar_elongation_1_deg": 4, "solar_elongation_2_deg": 4, "app_mag_1": 4, "app_mag_2": 4}
    plain = [*[F.col(c).cast("double").alias(c) for c in ("number_1", "number_2")], "date_utc", "diameter_source_1", "diameter_source_2", "class_1", "class_2", "gaia_observable"]
    return out.select(*plain, F.round("jd_tdb", 6).alias("jd_tdb"), F.round("dist_au", 9).alias("dist_au"), F.round(F.col("deflection_dv_m_s") * 1e9, 3).alias("dv_nm_s"), *[F.round(c, k).alias(c) for c, k in digits.items()])


def time_scales(spark: SparkSession, sf: str) -> DataFrame:
    """Observation times as TDB Julian dates and back, per transit."""
    first = table(spark, sf, "sso_observation").groupBy("source_id", "transit_id").agg(F.min("epoch").alias("epoch"))
    jd = gaia_epoch_to_tdb(F.col("epoch"))
    return first.select("source_id", "transit_id", F.round(jd, 6).alias("jd_tdb"), F.round(tdb_to_tcb(jd) - 2455197.5, 6).alias("epoch"), F.round(utc_to_tdb(F.col("epoch") + 2455197.5), 6).alias("from_utc"), jd_to_iso_date(jd).alias("day"))


QUERIES = {
    "encounter_detect": detect, "snapshot_selection": snapshot_selection, "time_grid": grid, "kepler_propagate": kepler_propagate,
    "encounter_prefiltered": encounter_prefiltered, "encounter_radial_overlap": encounter_radial_overlap,
    "encounter_refine_vertex": encounter_refine_vertex, "time_grid_full": partial(grid, window=FULL), "kepler_propagate_full": kepler_propagate_full,
    "encounter_detect_full": partial(detect, window=FULL), "encounter_prefiltered_full": partial(encounter_prefiltered, window=FULL),
    "encounter_radial_overlap_full": partial(encounter_radial_overlap, window=FULL), "encounter_refine_vertex_full": partial(encounter_refine_vertex, window=FULL),
    "encounter_refine_recentre": encounter_refine_recentre,
    "nbody_refined": nbody_refined, "orbit_classes": orbit_classes, "diameter_priority": diameter_priority, "characterized": characterized, "time_scales": time_scales,
}

_MID = (START + END) / 2
ELEMENTS_SQL = f"""
chosen AS (SELECT path FROM mpcorb_snapshot WHERE epoch_jd IS NOT NULL AND NOT isnan(epoch_jd) ORDER BY abs(epoch_jd - {_MID}), epoch_jd, path LIMIT 1),
els AS (SELECT number, {", ".join(f"min({c}) AS {c}" for c in _COLUMNS)} FROM elements
  WHERE snapshot_path IN (SELECT path FROM chosen) AND number IS NOT NULL AND a_au > 0 AND NOT isnan(a_au) AND ecc BETWEEN 0 AND 0.999999 GROUP BY number)"""
_K = "0.01720209895"


def _positions_sql(steps: str, decimals: int) -> str:
    return f"""
mean AS (SELECT number, s, {START}::DOUBLE + s * {STEP}::DOUBLE AS t_jd, els.* EXCLUDE (number), (radians(mean_anomaly_deg) + {_K} / pow(a_au, 1.5) * ({START} + s * {STEP} - epoch_jd)) AS raw FROM els, {steps}),
turned AS (SELECT *, raw - 2 * pi() * floor(raw / (2 * pi())) AS ma FROM mean),
solved AS (SELECT *, list_reduce(list_prepend(ma, range(1, 16)::DOUBLE[]), lambda q, k: q + (ma - q + ecc * sin(q)) / (1 - ecc * cos(q))) AS big_e FROM turned),
placed AS (SELECT *, a_au * (1 - ecc * cos(big_e)) AS r, radians(argperi_deg) + 2 * atan2(sqrt(1 + ecc) * sin(big_e / 2), sqrt(1 - ecc) * cos(big_e / 2)) AS u, radians(node_deg) AS o, radians(i_deg) AS i FROM solved),
pos AS (SELECT number, s, t_jd, round(r * (cos(o) * cos(u) - sin(o) * sin(u) * cos(i)), {decimals}) AS x,
  round(r * (sin(o) * cos(u) + cos(o) * sin(u) * cos(i)), {decimals}) AS y, round(r * sin(u) * sin(i), {decimals}) AS z FROM placed)"""


_DETECT = f"""WITH {ELEMENTS_SQL}, {_positions_sql("(SELECT unnest(range(0, 25)) AS s)", 9)},
near AS (SELECT a.number AS idx_i, b.number AS idx_j, a.t_jd, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d
  FROM pos a JOIN pos b ON a.s = b.s AND a.number < b.number AND abs(a.x - b.x) <= {RADIUS} AND abs(a.y - b.y) <= {RADIUS} AND abs(a.z - b.z) <= {RADIUS}),
found AS (SELECT idx_i, idx_j, round(d, 8) AS d, t_jd FROM near WHERE d <= {RADIUS}),
best AS (SELECT idx_i::BIGINT AS idx_i, idx_j::BIGINT AS idx_j, arg_min(t_jd, (d, t_jd)) AS t_jd, min(d) AS dist_au FROM found GROUP BY ALL)"""

_DIAMETER = """CASE WHEN {m} > 0 THEN {m} WHEN {h} IS NOT NULL AND {a} IS NOT NULL THEN 1329 / sqrt(CASE WHEN {a} < 2.5 THEN 0.20 WHEN {a} < 2.82 THEN 0.13 ELSE 0.06 END::DOUBLE) * pow(10.0, -{h} / 5)
  WHEN {h} IS NOT NULL THEN 1329 / sqrt(0.14::DOUBLE) * pow(10.0, -{h} / 5) END"""
_SOURCE = "CASE WHEN {m} > 0 THEN 'measured' WHEN {h} IS NOT NULL AND {a} IS NOT NULL THEN 'zone_albedo' WHEN {h} IS NOT NULL THEN 'default_albedo' ELSE 'unknown' END"
_CLASS = """CASE WHEN {a} IS NULL OR {e} IS NULL THEN 'Other' WHEN {a} * (1 - {e}) < 1.3 THEN 'NEA' WHEN {a} >= 1.7 AND {a} < 5.5 AND NOT abs({a} - 5.205) < 0.5 THEN 'MBA'
  WHEN abs({a} - 5.205) < 0.5 THEN 'Trojan' WHEN {a} > 5.5 AND {a} <= 30 THEN 'Centaur' WHEN {a} > 30 THEN 'TNO' ELSE 'Other' END"""
_SIZES = """
sizes AS (SELECT number, min(CASE WHEN NOT isnan(d) THEN d END) AS diameter_km FROM (
  SELECT number_1 AS number, diameter_1_km AS d FROM encounters_catalog WHERE diameter_source_1 = 'measured'
  UNION ALL SELECT number_2, diameter_2_km FROM encounters_catalog WHERE diameter_source_2 = 'measured') WHERE number IS NOT NULL GROUP BY number)"""


def _body_sql(s: str) -> str:
    """Position of body ``s`` (``xs, ys, zs``) from its orbit columns."""
    return f"""
m{s} AS (SELECT *, (radians(ma_{s}) + {_K} / pow(a_{s}, 1.5) * (jd_tdb - ep_{s})) AS raw_{s} FROM {"swapped" if s == "1" else "p1"}),
k{s} AS (SELECT *, raw_{s} - 2 * pi() * floor(raw_{s} / (2 * pi())) AS t_{s} FROM m{s}),
e{s} AS (SELECT *, CASE WHEN t_{s} IS NOT NULL THEN list_reduce(list_prepend(t_{s}, range(1, 16)::DOUBLE[]), lambda q, k: q + (t_{s} - q + e_{s} * sin(q)) / (1 - e_{s} * cos(q))) END AS be_{s} FROM k{s}),
u{s} AS (SELECT *, a_{s} * (1 - e_{s} * cos(be_{s})) AS r_{s}, radians(w_{s}) + 2 * atan2(sqrt(1 + e_{s}) * sin(be_{s} / 2), sqrt(1 - e_{s}) * cos(be_{s} / 2)) AS u_{s} FROM e{s}),
p{s} AS (SELECT *, r_{s} * (cos(radians(o_{s})) * cos(u_{s}) - sin(radians(o_{s})) * sin(u_{s}) * cos(radians(i_{s}))) AS x{s},
  r_{s} * (sin(radians(o_{s})) * cos(u_{s}) + cos(radians(o_{s})) * sin(u_{s}) * cos(radians(i_{s}))) AS y{s}, r_{s} * sin(u_{s}) * sin(radians(i_{s})) AS z{s} FROM u{s})"""


_PAIRED = {"n": "number", "a": "a_au", "e": "ecc", "i": "i_deg", "o": "node_deg", "w": "argperi_deg", "ma": "mean_anomaly_deg", "ep": "epoch_jd", "h": "h_mag"}
_SWAPPED = ", ".join(f"CASE WHEN swap THEN {c}_{3 - s} ELSE {c}_{s} END AS {c}_{s}" for c in _PAIRED for s in (1, 2))
_ELONG = "CASE WHEN {z} IS NOT NULL THEN degrees(acos(greatest(-1, least(1, (({x} - ex) * -ex + ({y} - ey) * -ey + {z} * 0) / (sqrt(({x} - ex) ** 2 + ({y} - ey) ** 2 + {z} ** 2) * sqrt(ex * ex + ey * ey)))))) END"
_PHASE = "2.5 * log10(0.85 * exp(-3.33 * pow(tan(radians(20) / 2), 0.63)) + 0.15 * exp(-1.87 * pow(tan(radians(20) / 2), 1.22)))"
_LEAP = "(32.184 + CASE WHEN {t} >= 2457754.5 THEN 37 WHEN {t} >= 2457204.5 THEN 36 WHEN {t} >= 2456109.5 THEN 35 WHEN {t} >= 2454832.5 THEN 34 ELSE 33 END) / 86400"
_UTC = f"jd_tdb - {_LEAP.format(t='(jd_tdb - ' + _LEAP.format(t='jd_tdb') + ')')}"

SQL = {
    "encounter_detect": f"{_DETECT} SELECT * FROM best",
    "snapshot_selection": f"SELECT path, epoch_jd FROM mpcorb_snapshot WHERE epoch_jd IS NOT NULL AND NOT isnan(epoch_jd) ORDER BY abs(epoch_jd - {_MID}), epoch_jd, path LIMIT 1",
    "time_grid": f"SELECT s::BIGINT AS step_idx, {START} + s * {STEP}::DOUBLE AS t_jd FROM (SELECT unnest(range(0, 25)) AS s)",
    "kepler_propagate": f"WITH {ELEMENTS_SQL}, {_positions_sql('(SELECT 0 AS s)', 8)} SELECT number::BIGINT AS number, x, y, z FROM pos",
    "encounter_prefiltered": f"{_DETECT} SELECT idx_i, idx_j, dist_au FROM best JOIN els a ON a.number = idx_i JOIN els b ON b.number = idx_j WHERE abs(a.a_au - b.a_au) <= 0.5 AND abs(a.i_deg - b.i_deg) <= 30",
    "encounter_radial_overlap": f"""{_DETECT} SELECT idx_i, idx_j FROM best JOIN els a ON a.number = idx_i JOIN els b ON b.number = idx_j
  WHERE a.a_au * (1 - a.ecc) - {RADIUS} <= b.a_au * (1 + b.ecc) AND b.a_au * (1 - b.ecc) - {RADIUS} <= a.a_au * (1 + a.ecc)""",
    "encounter_refine_vertex": f"""{_DETECT},
series AS (SELECT idx_i, idx_j, best.t_jd AS t_min, a.t_jd, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 8) AS d
  FROM best JOIN pos a ON a.number = idx_i JOIN pos b ON b.number = idx_j AND b.s = a.s),
three AS (SELECT *, lag(d) OVER w AS d0, lead(d) OVER w AS d2, lag(t_jd) OVER w AS t0, lead(t_jd) OVER w AS t2 FROM series WINDOW w AS (PARTITION BY idx_i, idx_j ORDER BY t_jd)),
bent AS (SELECT *, d0 - 2 * d + d2 AS bend, t_jd - t0 AS h FROM three WHERE t_jd = t_min AND d0 IS NOT NULL AND d2 IS NOT NULL),
timed AS (SELECT *, CASE WHEN bend > 0 THEN least(t2, greatest(t0, t_jd + 0.5 * (d0 - d2) / bend * h)) WHEN d0 = least(d0, d, d2) THEN t0 WHEN d = least(d0, d, d2) THEN t_jd ELSE t2 END AS t FROM bent)
SELECT idx_i, idx_j, round(t, 5) AS t_jd, round(CASE WHEN bend > 0 THEN least(d + 0.5 * (d2 - d0) * ((t - t_jd) / h) + 0.5 * bend * ((t - t_jd) / h) * ((t - t_jd) / h), d0, d, d2) ELSE least(d0, d, d2) END, 7) AS dist_au FROM timed""",
    "orbit_classes": f"WITH {ELEMENTS_SQL} SELECT number, {_CLASS.format(a='a_au', e='ecc')} AS orbit_class FROM els",
    "diameter_priority": f"""WITH {ELEMENTS_SQL}, {_SIZES}, joined AS (SELECT els.number, CASE WHEN NOT isnan(h_mag) THEN h_mag END AS h, a_au AS a, diameter_km AS m FROM els LEFT JOIN sizes USING (number))
SELECT number, round({_DIAMETER.format(m="m", h="h", a="a")}, 6) AS diameter_km, {_SOURCE.format(m="m", h="h", a="a")} AS source FROM joined""",
    "characterized": f"""WITH {ELEMENTS_SQL}, {_SIZES},
once AS (SELECT DISTINCT number_1, number_2, jd_tdb, CASE WHEN NOT isnan(dist_au) THEN dist_au END AS dist_au, CASE WHEN NOT isnan(rel_vel_au_day) THEN rel_vel_au_day END AS v FROM encounters_catalog),
joined AS (SELECT jd_tdb, dist_au, v, number_1 AS n_1, number_2 AS n_2, {", ".join(f"{x}.{c} AS {k}_{s}" for k, c in _PAIRED.items() if k not in ("n", "h") for s, x in (("1", "b1"), ("2", "b2")))},
  CASE WHEN NOT isnan(b1.h_mag) THEN b1.h_mag END AS h_1, CASE WHEN NOT isnan(b2.h_mag) THEN b2.h_mag END AS h_2
  FROM once LEFT JOIN els b1 ON b1.number = number_1 LEFT JOIN els b2 ON b2.number = number_2),
marked AS (SELECT *, coalesce((h_1 IS NULL AND h_2 IS NOT NULL) OR h_2 < h_1, false) AS swap FROM joined),
swapped AS (SELECT jd_tdb, dist_au, v, {_SWAPPED} FROM marked),
{_body_sql("1")}, {_body_sql("2")},
sun AS (SELECT *, jd_tdb - 2451545.0 AS dn FROM p2),
sun2 AS (SELECT *, radians(357.528 + 0.9856003 * dn - 360 * floor((357.528 + 0.9856003 * dn) / 360)) AS sg, 280.460 + 0.9856474 * dn - 360 * floor((280.460 + 0.9856474 * dn) / 360) AS sl FROM sun),
sun3 AS (SELECT *, radians(sl + 1.915 * sin(sg) + 0.020 * sin(2 * sg)) AS lon, 1.00014 - 0.01671 * cos(sg) - 0.00014 * cos(2 * sg) AS sr FROM sun2),
earth AS (SELECT *, -sr * cos(lon) AS ex, -sr * sin(lon) AS ey FROM sun3),
sized AS (SELECT earth.*, s1.diameter_km AS m_1, s2.diameter_km AS m_2 FROM earth LEFT JOIN sizes s1 ON s1.number = n_1 LEFT JOIN sizes s2 ON s2.number = n_2),
done AS (SELECT *, {", ".join(f"{_DIAMETER.format(m=f'm_{s}', h=f'h_{s}', a=f'a_{s}')} AS d_{s}, {_ELONG.format(x=f'x{s}', y=f'y{s}', z=f'z{s}')} AS el_{s}, h_{s} + 5 * log10(sqrt(x{s} ** 2 + y{s} ** 2 + z{s} ** 2) * sqrt((x{s} - ex) ** 2 + (y{s} - ey) ** 2 + z{s} ** 2)) - {_PHASE} AS mag_{s}" for s in "12")},
  {_ELONG.format(x="(x1 + x2) / 2", y="(y1 + y2) / 2", z="((z1 + z2) / 2)")} AS el FROM sized)
SELECT n_1::DOUBLE AS number_1, n_2::DOUBLE AS number_2, strftime(make_timestamp(CAST(floor({_UTC} - 2440587.5) AS BIGINT) * 86400000000), '%Y-%m-%d') AS date_utc,
  {_SOURCE.format(m="m_1", h="h_1", a="a_1")} AS diameter_source_1, {_SOURCE.format(m="m_2", h="h_2", a="a_2")} AS diameter_source_2,
  {_CLASS.format(a="a_1", e="e_1")} AS class_1, {_CLASS.format(a="a_2", e="e_2")} AS class_2,
  coalesce(el_1 > 45 AND mag_1 < 21, false) OR coalesce(el_2 > 45 AND mag_2 < 21, false) AS gaia_observable,
  round(jd_tdb, 6) AS jd_tdb, round(dist_au, 9) AS dist_au,
  round(CASE WHEN dist_au > 0 AND v > 0 THEN 2 * 6.674e-11 * pi() / 6 * coalesce(CASE WHEN a_1 < 2.5 THEN 2700 WHEN a_1 < 2.82 THEN 2000 WHEN a_1 IS NOT NULL THEN 1300 END, 2000) * pow(d_1 * 1000, 3)
    / (dist_au * 149597870700 * v * 149597870700 / 86400) END * 1e9, 3) AS dv_nm_s,
  round(dist_au * 149597870.7, 2) AS dist_km, round(v * (149597870.7 / 86400), 5) AS rel_vel_km_s, round(h_1, 3) AS h_1, round(h_2, 3) AS h_2, round(d_1, 4) AS diameter_1_km, round(d_2, 4) AS diameter_2_km,
  round(el, 4) AS solar_elongation_deg, round(el_1, 4) AS solar_elongation_1_deg, round(el_2, 4) AS solar_elongation_2_deg, round(mag_1, 4) AS app_mag_1, round(mag_2, 4) AS app_mag_2 FROM done""",
    "time_scales": f"""WITH first AS (SELECT source_id, transit_id, min(epoch) AS e FROM sso_observation GROUP BY ALL),
jd AS (SELECT *, e + 2455197.5 - 1.550519768e-8 * (e + 2455197.5 - 2443144.5003725) AS jd_tdb FROM first)
SELECT source_id, transit_id, round(jd_tdb, 6) AS jd_tdb, round((jd_tdb - 1.550519768e-8 * 2443144.5003725) / (1 - 1.550519768e-8) - 2455197.5, 6) AS epoch,
  round(e + 2455197.5 + {_LEAP.format(t="(e + 2455197.5)")}, 6) AS from_utc, strftime(make_timestamp(CAST(floor({_UTC} - 2440587.5) AS BIGINT) * 86400000000), '%Y-%m-%d') AS day FROM jd""",
}
