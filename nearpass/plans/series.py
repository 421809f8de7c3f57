"""Queries over observation series, parsers and JSON, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpass.functions.physics import clean, ra_dec_deg, tangent_residual_mas
from nearpass.operators import catalog, fits
from nearpass.operators import timeseries as ts
from nearpass.plans.detection import ELEMENTS_SQL, current_elements
from nearpass.session import checkpoint_root, table
from nearpass.sources import elements as src
from nearpass.streaming import live

SPLIT_EPOCH = 2100.0


def readings(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Every reading once, with the columns a query needs."""
    rows = table(spark, sf, "sso_observation").select("source_id", "observation_id", "epoch", *[clean(F.col(c)).alias(c) if c in ("ra", "dec", "g_mag") else c for c in columns])
    return rows.distinct()


def fov_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Readings and length of each session of a source; blocks of days keep a hot source spread."""
    rows = ts.gap_sessions(readings(spark, sf).select("source_id", "observation_id", "epoch"), "source_id", "epoch", 0.01, "observation_id", block_days=30.0)
    return rows.groupBy("source_id", "session").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("epoch") - F.min("epoch"), 9).alias("days"))


def before_after_welch(spark: SparkSession, sf: str) -> DataFrame:
    out = ts.before_after(readings(spark, sf, "g_mag"), "source_id", F.col("g_mag"), F.col("epoch") < SPLIT_EPOCH, F.col("epoch") >= SPLIT_EPOCH)
    return out.select("source_id", "n_before", "n_after", *[F.round(c, 10).alias(c) for c in ("mean_before", "mean_after")], F.round("welch_t", 5).alias("welch_t"), "significant")


def step_model_bic(spark: SparkSession, sf: str) -> DataFrame:
    rows = readings(spark, sf, "g_mag").withColumn("x", (F.col("epoch") - SPLIT_EPOCH) / 1000.0)
    return ts.step_bic(rows, "source_id", "x", "g_mag", F.lit(0.0)).select("source_id", "n", F.round("delta_bic", 4).alias("delta_bic"))


def icc_anova(spark: SparkSession, sf: str) -> DataFrame:
    return ts.icc_anova(readings(spark, sf, "transit_id", "g_mag"), "source_id", "transit_id", F.col("g_mag") - 18.0).select("source_id", "k", "n", F.round("icc", 5).alias("icc"))


def jackknife_sigma(spark: SparkSession, sf: str) -> DataFrame:
    out = ts.jackknife(readings(spark, sf, "g_mag"), "source_id", F.col("g_mag") - 18.0)
    return out.select("source_id", "n", F.round("mean", 10).alias("mean"), F.round("jackknife_sigma", 10).alias("jackknife_sigma"), F.round("top_share", 5).alias("top_share"))


def loo_floor(spark: SparkSession, sf: str) -> DataFrame:
    """Floor of the distance correction per bin without the bin itself."""
    per = table(spark, sf, "refined").groupBy("bin_id").agg(F.avg(clean(F.col("delta_dist_au"))).alias("m"))
    return ts.leave_one_out_floor(per, "bin_id", F.col("m")).select("bin_id", F.round("floor", 9).alias("floor"))


def sky_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """Largest residual of each source's readings against its own first reading of the transit."""
    rows = readings(spark, sf, "transit_id", "ra", "dec").where("ra >= 0 AND ra < 360 AND abs(dec) <= 90")
    first = rows.groupBy("source_id", "transit_id").agg(F.min(F.struct("epoch", "observation_id", "ra", "dec")).alias("f"))
    both = rows.join(first, ["source_id", "transit_id"])
    east, north = tangent_residual_mas(F.col("ra"), F.col("dec"), F.col("f.ra"), F.col("f.dec"))
    return both.groupBy("source_id", "transit_id").agg(F.round(F.max(F.abs(east)), 3).alias("east_mas"), F.round(F.max(F.abs(north)), 3).alias("north_mas"))


def spacecraft_direction(spark: SparkSession, sf: str) -> DataFrame:
    """Direction of the spacecraft from the Sun at the first reading of each transit."""
    first = readings(spark, sf, "transit_id", "x_gaia", "y_gaia", "z_gaia").groupBy("source_id", "transit_id").agg(F.min(F.struct("epoch", "observation_id", "x_gaia", "y_gaia", "z_gaia")).alias("f"))
    ra, dec = ra_dec_deg({"x": F.col("f.x_gaia"), "y": F.col("f.y_gaia"), "z": F.col("f.z_gaia")})
    return first.select("source_id", "transit_id", F.round(ra, 6).alias("ra"), F.round(dec, 6).alias("dec"))


def fixed_width_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Element lines printed and parsed again."""
    rows = current_elements(spark, sf).withColumn("packed_epoch", F.lit("K156Q"))
    back = src.element_columns(rows.select(src.element_lines(rows).alias("value")))
    return back.select("number", "h_mag", "epoch_jd", *[F.round(c, 5).alias(c) for c in ("mean_anomaly_deg", "argperi_deg", "node_deg", "i_deg")], F.round("ecc", 7).alias("ecc"), F.round("a_au", 7).alias("a_au"))


def json_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies per delivery as one payload, read back into rows."""
    rows = table(spark, sf, "elements").where("number IS NOT NULL").groupBy("number").agg(F.min("a_au").alias("a"))
    payload = rows.select(F.to_json(F.struct(F.array(F.lit("number"), F.lit("a_au")).alias("fields"), F.array(F.array(F.col("number").cast("string"), F.col("a").cast("string"))).alias("data"))).alias("body"))
    return src.column_payload(payload, "body", "number").select(F.col("number").try_cast("bigint").alias("number"), F.element_at("row", F.lit("a_au")).try_cast("double").alias("a_au"))


def pipe_list(spark: SparkSession, sf: str) -> DataFrame:
    """Targets per perturber printed as a pipe list and exploded again."""
    events = table(spark, sf, "goffin_2014_encounters").where("pert IS NOT NULL AND targ IS NOT NULL").select("pert", "targ").distinct()
    lists = events.groupBy("pert").agg(F.concat_ws(" | ", F.sort_array(F.collect_list(F.col("targ").cast("string")))).alias("targets"))
    return src.pipe_pairs(lists.withColumn("name", F.col("pert").cast("string")), "name", "targets").select("perturber", F.col("target").cast("bigint").alias("target"))


def step_specificity(spark: SparkSession, sf: str) -> DataFrame:
    rows = readings(spark, sf, "g_mag").withColumn("x", (F.col("epoch") - SPLIT_EPOCH) / 1000.0)
    out = ts.step_specificity(rows, "source_id", "x", "g_mag", F.lit(0.0), [k / 20.0 for k in range(-10, 11) if k])
    return out.select("source_id", *[F.round(c, 3).alias(c) for c in ("real", "other", "specificity")], "flag")


def bootstrap_sigma(spark: SparkSession, sf: str) -> DataFrame:
    return fits.bootstrap_means(readings(spark, sf, "g_mag"), "source_id", "observation_id", "g_mag")


def mass_status(spark: SparkSession, sf: str) -> DataFrame:
    """The status rule on each bin's mean correction and its error."""
    v = clean(F.col("delta_dist_au"))
    g = table(spark, sf, "refined").groupBy("bin_id").agg(F.avg(v).alias("mass"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sigma"))
    return g.select("bin_id", fits.mass_status_column(F.col("mass"), F.col("sigma")).alias("status"))


def percentile_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each bin's corrections below 1e-5 AU."""
    rows = table(spark, sf, "refined").select("bin_id", clean(F.col("delta_dist_au")).alias("v"))
    probes = rows.select("bin_id", F.lit(1e-5).alias("probe")).distinct()
    return ts.percentile_rank(rows, "bin_id", "v", probes).select("bin_id", F.round("rank", 9).alias("rank"))


def secondary_perturbers(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies other than number 1 that met its targets in 2015."""
    rows = table(spark, sf, "encounters_catalog").select("encounter_id", "number_1", "number_2", "dist_au", "jd_tdb").distinct()
    targets = catalog.sides(rows).where("number = 1 AND partner IS NOT NULL").select(F.col("partner").alias("number"))
    return catalog.secondary_perturbers(rows, 1, targets, 0.03, 2457023.5, 2457388.5).select("encounter_id", "number", "partner", "massive")


def gate_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The gate of required bodies kept as a running aggregate over the catalogue read as a stream."""
    name = f"gate_{uuid.uuid4().hex}"
    batch = table(spark, sf, "encounters_catalog")
    stream = live.encounter_stream(spark, f"{sf}/encounters_catalog.parquet", batch.schema)
    query = live.gate_stream(stream.select("number_1", "number_2", "dist_au"), name, f"{checkpoint_root(spark)}/nearpass/{name}")
    query.awaitTermination()
    return spark.table(name)


QUERIES = {
    f.__name__: f
    for f in (fov_sessions, before_after_welch, step_model_bic, icc_anova, jackknife_sigma, loo_floor, sky_residuals, spacecraft_direction, fixed_width_round_trip, json_payload, pipe_list, step_specificity, bootstrap_sigma, mass_status, percentile_rank, secondary_perturbers, gate_streamed)
}

_READ = "r AS (SELECT DISTINCT source_id, observation_id, transit_id, number_mp, epoch, CASE WHEN NOT isnan(ra) THEN ra END AS ra, CASE WHEN NOT isnan(dec) THEN dec END AS dec, CASE WHEN NOT isnan(g_mag) THEN g_mag END AS g, x_gaia, y_gaia, z_gaia FROM sso_observation)"
SQL = {
    "fov_sessions": f"""WITH {_READ}, m AS (SELECT *, CASE WHEN lag(epoch) OVER w IS NULL OR epoch - lag(epoch) OVER w > 0.01 THEN epoch END AS s FROM r WINDOW w AS (PARTITION BY source_id ORDER BY epoch, observation_id)),
n AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY epoch, observation_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM m)
SELECT source_id, session, count(*) AS n, round(max(epoch) - min(epoch), 9) AS days FROM n GROUP BY 1, 2""",
    "before_after_welch": f"""WITH {_READ}, s AS (SELECT source_id, count(g) FILTER (epoch < {SPLIT_EPOCH}) AS n_before, count(g) FILTER (epoch >= {SPLIT_EPOCH}) AS n_after, avg(g) FILTER (epoch < {SPLIT_EPOCH}) AS mb, avg(g) FILTER (epoch >= {SPLIT_EPOCH}) AS ma,
  stddev_pop(g) FILTER (epoch < {SPLIT_EPOCH}) AS sb, stddev_pop(g) FILTER (epoch >= {SPLIT_EPOCH}) AS sa FROM r GROUP BY 1),
t AS (SELECT *, sqrt(sb * sb / nullif(n_before, 0) + sa * sa / nullif(n_after, 0)) AS sp FROM s), w AS (SELECT *, CASE WHEN sp > 0 THEN (ma - mb) / sp END AS t FROM t)
SELECT source_id, n_before, n_after, round(mb, 10) AS mean_before, round(ma, 10) AS mean_after, round(t, 5) AS welch_t, coalesce(abs(t) >= 3, false) AS significant FROM w""",
    "step_model_bic": f"""WITH {_READ}, p AS (SELECT source_id, (epoch - {SPLIT_EPOCH}) / 1000 AS x, g AS y, CASE WHEN epoch >= {SPLIT_EPOCH} THEN 1.0::DOUBLE ELSE 0 END AS s FROM r WHERE g IS NOT NULL),
q AS (SELECT source_id, count(*) AS n, sum(s) AS ss, count(*) * covar_pop(x, y) AS cxy, count(*) * var_pop(x) AS vx, count(*) * var_pop(y) AS vy, count(*) * covar_pop(s, x) AS csx, count(*) * covar_pop(s, y) AS csy, count(*) * var_pop(s) AS vs FROM p GROUP BY 1),
l AS (SELECT *, greatest(0, vy - CASE WHEN vx > 0 THEN cxy * cxy / vx ELSE 0 END) AS r1, vs - CASE WHEN vx > 0 THEN csx * csx / vx ELSE 0 END AS sv, csy - CASE WHEN vx > 0 THEN csx * cxy / vx ELSE 0 END AS sc FROM q),
m AS (SELECT *, greatest(0, r1 - CASE WHEN sv > 0 THEN sc * sc / sv ELSE 0 END) AS r2 FROM l)
SELECT source_id, n, round(CASE WHEN n >= 10 AND ss >= 3 AND n - ss >= 3 THEN (n * ln(greatest(r1 / n, 1e-300)) + 2 * ln(n)) - (n * ln(greatest(r2 / n, 1e-300)) + 3 * ln(n)) END, 4) AS delta_bic FROM m""",
    "icc_anova": f"""WITH {_READ}, c AS (SELECT source_id, transit_id, count(*) AS m, sum(g - 18) AS s, sum((g - 18) * (g - 18)) AS q FROM r WHERE g IS NOT NULL GROUP BY 1, 2),
t AS (SELECT source_id, count(*) AS k, sum(m)::BIGINT AS n, sum(s) AS s, sum(q) AS q, sum(s * s / m) AS b, sum(m * m) AS mm FROM c GROUP BY 1),
u AS (SELECT *, (b - s * s / n) / nullif(k - 1, 0) AS msb, (q - b) / nullif(n - k, 0) AS msw, (n - mm / n) / nullif(k - 1, 0) AS m0 FROM t)
SELECT source_id, k, n, round((msb - msw) / nullif(msb + (m0 - 1) * msw, 0), 5) AS icc FROM u""",
    "jackknife_sigma": f"""WITH {_READ}, t AS (SELECT source_id, count(g) AS n, avg(g - 18) AS mean, var_pop(g) * count(g) AS ss, min(g - 18) AS lo, max(g - 18) AS hi FROM r WHERE g IS NOT NULL GROUP BY 1)
SELECT source_id, n, round(mean, 10) AS mean, round(sqrt(ss / (n * (n - 1))), 10) AS jackknife_sigma, round(CASE WHEN ss > 0 THEN greatest((hi - mean) * (hi - mean), (mean - lo) * (mean - lo)) / ss END, 5) AS top_share FROM t WHERE n >= 3""",
    "loo_floor": """WITH p AS (SELECT bin_id, avg(CASE WHEN NOT isnan(delta_dist_au) THEN delta_dist_au END) AS m FROM refined GROUP BY 1), q AS (SELECT bin_id, m * m AS q FROM p WHERE m IS NOT NULL)
SELECT bin_id, round(sqrt(((SELECT sum(q) FROM q) - q) / nullif((SELECT count(*) FROM q) - 1, 0)), 9) AS floor FROM q""",
    "sky_residuals": f"""WITH {_READ}, ok AS (SELECT * FROM r WHERE ra >= 0 AND ra < 360 AND abs(dec) <= 90), f AS (SELECT source_id, transit_id, min((epoch, observation_id, ra, dec)) AS f FROM ok GROUP BY ALL),
d AS (SELECT ok.*, f[3] AS ra0, f[4] AS dec0, ra - f[3] + 540 AS t FROM ok JOIN f USING (source_id, transit_id))
SELECT source_id, transit_id, round(max(abs((t - 360 * floor(t / 360) - 180) * cos(radians(dec0)) * 3.6e6)), 3) AS east_mas, round(max(abs((dec - dec0) * 3.6e6)), 3) AS north_mas FROM d GROUP BY ALL""",
    "spacecraft_direction": f"""WITH {_READ}, f AS (SELECT source_id, transit_id, min((epoch, observation_id, x_gaia, y_gaia, z_gaia)) AS f FROM r GROUP BY ALL),
v AS (SELECT source_id, transit_id, degrees(atan2(f[4], f[3])) AS a, degrees(asin(f[5] / sqrt(f[3] * f[3] + f[4] * f[4] + f[5] * f[5]))) AS d FROM f)
SELECT source_id, transit_id, round(a - 360 * floor(a / 360), 6) AS ra, round(d, 6) AS dec FROM v""",
    "fixed_width_round_trip": f"WITH {ELEMENTS_SQL} SELECT number, round(h_mag, 2) AS h_mag, 2457199.5::DOUBLE AS epoch_jd, round(mean_anomaly_deg, 5) AS mean_anomaly_deg, round(argperi_deg, 5) AS argperi_deg, round(node_deg, 5) AS node_deg, round(i_deg, 5) AS i_deg, round(ecc, 7) AS ecc, round(a_au, 7) AS a_au FROM els",
    "json_payload": "SELECT number::BIGINT AS number, min(a_au) AS a_au FROM elements WHERE number IS NOT NULL GROUP BY number",
    "pipe_list": "SELECT DISTINCT pert AS perturber, targ::BIGINT AS target FROM goffin_2014_encounters WHERE pert IS NOT NULL AND targ IS NOT NULL",
    "mass_status": """WITH g AS (SELECT bin_id, avg(v) AS m, stddev_samp(v) / sqrt(count(v)) AS s FROM (SELECT bin_id, CASE WHEN NOT isnan(delta_dist_au) THEN delta_dist_au END AS v FROM refined) GROUP BY 1)
SELECT bin_id, CASE WHEN m IS NULL OR s IS NULL THEN 'unknown' WHEN m <= 0 THEN 'non_physical' WHEN m >= 3 * s THEN 'measured' ELSE 'not_identifiable' END AS status FROM g""",
    "percentile_rank": "SELECT bin_id, round(avg(CASE WHEN delta_dist_au IS NOT NULL AND NOT isnan(delta_dist_au) THEN (delta_dist_au < 1e-5)::INTEGER END), 9) AS rank FROM refined GROUP BY 1",
    "secondary_perturbers": f"""WITH once AS (SELECT DISTINCT * EXCLUDE (run_id) FROM encounters_catalog),
t AS (SELECT number_2 AS n FROM once WHERE number_1 = 1 UNION SELECT number_1 FROM once WHERE number_2 = 1),
s AS (SELECT encounter_id, number_1 AS number, number_2 AS partner, dist_au, jd_tdb FROM once UNION ALL SELECT encounter_id, number_2, number_1, dist_au, jd_tdb FROM once)
SELECT encounter_id, number, partner, partner IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 15, 16, 52, 65, 87, 88, 107, 121, 128) AS massive FROM s WHERE dist_au <= 0.03 AND NOT isnan(dist_au) AND jd_tdb BETWEEN 2457023.5 AND 2457388.5 AND partner IS NOT NULL AND partner <> 1 AND number IN (SELECT n FROM t WHERE n IS NOT NULL)""",
    "step_specificity": f"""WITH {_READ}, p AS (SELECT source_id, (epoch - {SPLIT_EPOCH}) / 1000 AS x, g AS y, k / 20.0::DOUBLE AS spot FROM r, (SELECT unnest(range(-10, 11)) AS k) WHERE g IS NOT NULL),
q0 AS (SELECT source_id, x, y, spot, CASE WHEN x >= spot THEN 1.0::DOUBLE ELSE 0 END AS s FROM p),
q AS (SELECT source_id, spot, count(*) AS n, sum(s) AS ss, count(*) * covar_pop(x, y) AS cxy, count(*) * var_pop(x) AS vx, count(*) * var_pop(y) AS vy, count(*) * covar_pop(s, x) AS csx, count(*) * covar_pop(s, y) AS csy, count(*) * var_pop(s) AS vs FROM q0 GROUP BY 1, 2),
l AS (SELECT *, greatest(0, vy - CASE WHEN vx > 0 THEN cxy * cxy / vx ELSE 0 END) AS r1, vs - CASE WHEN vx > 0 THEN csx * csx / vx ELSE 0 END AS sv, csy - CASE WHEN vx > 0 THEN csx * cxy / vx ELSE 0 END AS sc FROM q),
m AS (SELECT *, greatest(0, r1 - CASE WHEN sv > 0 THEN sc * sc / sv ELSE 0 END) AS r2 FROM l),
d AS (SELECT source_id, spot, CASE WHEN n >= 10 AND ss >= 3 AND n - ss >= 3 THEN (n * ln(greatest(r1 / n, 1e-300)) + 2 * ln(n)) - (n * ln(greatest(r2 / n, 1e-300)) + 3 * ln(n)) END AS g FROM m),
b AS (SELECT source_id, max(g) FILTER (spot = 0) AS a, max(g) FILTER (spot <> 0) AS o FROM d GROUP BY 1)
SELECT source_id, round(a, 3) AS real, round(o, 3) AS other, round(a - o, 3) AS specificity, coalesce(a - o > 2, false) AS flag FROM b""",
    "gate_streamed": "SELECT number, count(*) AS n, min(CASE WHEN NOT isnan(dist_au) THEN dist_au END) AS nearest_au FROM (SELECT number_1 AS number, dist_au FROM encounters_catalog UNION ALL SELECT number_2, dist_au FROM encounters_catalog) WHERE number IN (1, 2, 4, 10) GROUP BY 1",
}
