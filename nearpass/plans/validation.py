"""Queries that check a catalogue, and the small formulas applied to its rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpass.functions import physics
from nearpass.functions.physics import clean
from nearpass.functions.timescale import parse_event_jd
from nearpass.operators import crossmatch, fits, hybrid, validation
from nearpass.operators import timeseries as ts
from nearpass.operators.characterize import attach
from nearpass.operators.ranks import group_quantile, ranked
from nearpass.plans.catalogue import once, raw, refined
from nearpass.plans.detection import ELEMENTS_SQL, FULL, current_elements
from nearpass.plans.series import readings
from nearpass.session import stage, table

EDGES = [0.0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05]
MAX_DA, MAX_DI = 0.5, 15.0


def _pairs_with_orbits(spark: SparkSession, sf: str) -> DataFrame:
    """Pair minima of the catalogue with ``da, di, e_max, i_max`` of both bodies' orbits."""
    minima = crossmatch.pair_minima(once(spark, sf, "number_1", "number_2", "dist_au")).select(F.col("lo").alias("number_1"), F.col("hi").alias("number_2"), "dist_au")
    both = attach(minima, current_elements(spark, sf), ["a_au", "ecc", "i_deg"]).where("a_au_1 IS NOT NULL AND a_au_2 IS NOT NULL")
    return both.select("number_1", "number_2", "dist_au", F.abs(F.col("a_au_1") - F.col("a_au_2")).alias("da"), F.abs(F.col("i_deg_1") - F.col("i_deg_2")).alias("di"), F.greatest("ecc_1", "ecc_2").alias("e_max"), F.greatest("i_deg_1", "i_deg_2").alias("i_max"))


def recall_by_band(spark: SparkSession, sf: str) -> DataFrame:
    """What the orbital filter keeps of the catalogue's pairs, by distance."""
    out = validation.recall_by_band(_pairs_with_orbits(spark, sf), "dist_au", (F.col("da") <= MAX_DA) & (F.col("di") <= MAX_DI), EDGES)
    return out.select("band", "low", "high", "n", "kept", *[F.round(c, 9).alias(c) for c in ("recall", "ci_low", "ci_high")])


def missed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    out = validation.missed_pairs(_pairs_with_orbits(spark, sf), MAX_DA, MAX_DI)
    return out.select("missed", "over_da", "over_di", "both", *[F.round(f"{c}_{k}", 9).alias(f"{c}_{k}") for c in "ei" for k in ("low", "mid", "high")])


def adverse_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies on orbits that filters find hard."""
    return current_elements(spark, sf).where("ecc > 0.3 OR i_deg > 20").select("number", "ecc", "i_deg")


def square_scaling(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs among bodies of even number, grown with the square of the bodies, against all pairs."""
    pairs = crossmatch.pair_minima(once(spark, sf, "number_1", "number_2", "dist_au"))
    bodies = pairs.select(F.explode(F.array("lo", "hi")).alias("number")).distinct()
    counts = bodies.agg(F.count(F.lit(1)).alias("all_bodies"), F.count_if(F.col("number") % 2 == 0).alias("even_bodies"))
    met = pairs.agg(F.count(F.lit(1)).alias("all_pairs"), F.count_if((F.col("lo") % 2 == 0) & (F.col("hi") % 2 == 0)).alias("even_pairs"))
    both = met.withColumns({c: counts.select(c).scalar() for c in ("all_bodies", "even_bodies")})
    check = validation.square_scaling(F.col("even_pairs"), F.col("even_bodies"), F.col("all_pairs"), F.col("all_bodies"), 0.02)
    return both.select("all_bodies", "even_bodies", "all_pairs", "even_pairs", F.round(check["predicted"], 3).alias("predicted"), F.round(check["rel_err"], 6).alias("rel_err"), check["ok"].alias("ok"))


_DELTAS = ["delta_a_au", "delta_dist_au", "delta_t_min_hours", "delta_rel_vel_au_day"]


def sigma_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Median and 90th percentile of the size of every correction, a row per column."""
    parts = F.array(*[F.struct(F.lit(c).alias("name"), F.abs(clean(F.col(c))).alias("v")) for c in _DELTAS])
    long = stage(refined(spark, sf).select(F.explode(parts).alias("p")).select("p.*").where("v IS NOT NULL"), "long")
    half, most = (group_quantile(long, ["name"], "v", p).select("name", "n", F.round("quantile", 12).alias(f"p{round(100 * p)}")) for p in (0.5, 0.9))
    return half.join(most.drop("n"), "name")


def largest_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty largest corrections by size, whatever their sign."""
    best = hybrid.best_solution(refined(spark, sf).select(*hybrid.KEY, "delta_dist_au", "error_message", "nbody_converged", "refine_day", "shard_id"))
    return best.where("delta_dist_au IS NOT NULL").orderBy(F.desc(F.abs("delta_dist_au")), *hybrid.KEY).limit(20).select(*hybrid.KEY, "delta_dist_au")


def _masses(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """Masses (1e15 kg) of the bodies in one position, from the mean of their diameters there."""
    d = clean(F.col(f"diameter_{side}_km"))
    sizes = once(spark, sf, f"number_{side}", f"diameter_{side}_km").where((d > 0) & F.col(f"number_{side}").isNotNull()).groupBy(F.col(f"number_{side}").alias("number")).agg(F.avg(d).alias("d"))
    mass = physics.mass_from_diameter(F.col("d")) / 1e15
    return sizes.select("number", mass.alias("mass"), (mass * (0.1 if side == "1" else 0.2)).alias("sigma"))


def mass_crosscheck(spark: SparkSession, sf: str) -> DataFrame:
    """Masses by the sizes of body 1 beside those of the same bodies as body 2."""
    out = validation.against_reference(_masses(spark, sf, "1"), _masses(spark, sf, "2"))
    return out.select("number", F.round("ratio", 9).alias("ratio"), F.round("z", 9).alias("z"))


def mass_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Masses by size with the systematic share of their errors against the other list, and their status."""
    one = _masses(spark, sf, "1")
    relative = validation.against_reference(one, _masses(spark, sf, "2")).select("number", (F.col("ratio") - 1.0).alias("relative_error"))
    total = fits.with_total_sigma(one, "mass", "sigma", relative)
    return total.select("number", F.round(F.col("sigma_total") / F.col("mass"), 9).alias("relative_sigma"), fits.mass_status_column(F.col("mass"), F.col("sigma_total")).alias("status"))


def detection_speeds(spark: SparkSession, sf: str) -> DataFrame:
    """Published pairs beside their catalogue minimum and every distinct speed they met at."""
    events = crossmatch.with_pair_key(table(spark, sf, "goffin_2014_encounters"), "pert", "targ").where("lo IS NOT NULL").select("recno", "lo", "hi")
    met = once(spark, sf, "number_1", "number_2", "dist_au", "rel_vel_km_s")
    speeds = crossmatch.with_pair_key(met, "number_1", "number_2").where("lo IS NOT NULL").select("lo", "hi", clean(F.col("rel_vel_km_s")).alias("speed")).where("speed IS NOT NULL").distinct()
    out = events.join(crossmatch.pair_minima(met).select("lo", "hi", "dist_au"), ["lo", "hi"], "left").join(speeds, ["lo", "hi"], "left")
    return out.select("recno", "dist_au", "speed")


def coverage_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Events beside a flag for each catalogue row of their target; several rows give several."""
    events = table(spark, sf, "goffin_2014_encounters").select("recno", F.col("targ").alias("number_2"))
    flags = once(spark, sf, "number_2", "class_2").select("number_2", (F.col("class_2") == "NEA").alias("novel"))
    return events.join(flags, "number_2", "left").groupBy("recno").agg(F.count(F.lit(1)).alias("rows"), F.count_if("novel").alias("novel"))


def band_solutions(spark: SparkSession, sf: str) -> DataFrame:
    """Solutions of the pairs whose catalogue distance is in a band, right-open."""
    d = clean(F.col("dist_au"))
    pairs = once(spark, sf, "number_1", "number_2", "dist_au").where((d >= 0.02) & (d < 0.03)).select("number_1", "number_2").distinct()
    done = refined(spark, sf).select("number_1", "number_2", "t_min_kepler_jd", clean(F.col("dist_au_nbody")).alias("d")).distinct()
    return pairs.join(done, ["number_1", "number_2"]).groupBy("number_1", "number_2").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("nearest"))


def common_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Days on which both body 1 and body 4 met somebody, and the one of the most alike distances."""
    def days(number: int) -> DataFrame:
        met = raw(spark, sf).where((F.col("number_1") == number) & clean(F.col("dist_au")).isNotNull())
        return met.groupBy(F.floor("jd_tdb").alias("day")).agg(F.min("dist_au").alias("d"))

    return validation.common_epochs(days(1), days(4), "day", "d")


def slice_window(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 500 to 599 of the distinct encounters in order of their id."""
    rows = ranked(raw(spark, sf).select("encounter_id").distinct(), "encounter_id")
    return rows.where(F.col("rank").between(500, 599)).select("rank", "encounter_id")


def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the catalogue and of its delivery of elements, from Parquet's own counts."""
    return raw(spark, sf).agg(F.count(F.lit(1)).alias("encounters")).withColumn("elements", table(spark, sf, "elements").agg(F.count(F.lit(1))).scalar())


def mass_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """Mass, GM, deflection angle, mass implied by it and density gate of every sized encounter (logarithms)."""
    rows = once(spark, sf, "diameter_1_km", "dist_km", "rel_vel_m_s").select("encounter_id", *[clean(F.col(c)).alias(c) for c in ("diameter_1_km", "dist_km", "rel_vel_m_s")])
    rows = rows.where("diameter_1_km > 0 AND dist_km > 0 AND rel_vel_m_s > 0")
    mass, impact, speed = physics.mass_from_diameter(F.col("diameter_1_km")), F.col("dist_km") * 1000.0, F.col("rel_vel_m_s")
    angle = physics.deflection_muas(mass, speed, impact)
    implied = physics.implied_mass_kg(F.lit(1e-9), speed, impact)
    density = physics.bulk_density_g_cm3(implied, F.col("diameter_1_km"))
    return rows.select("encounter_id", *[F.round(F.log10(x), 9).alias(n) for n, x in (("mass", mass), ("gm", mass * physics.NEWTON_G), ("angle", angle), ("implied", implied), ("density", density))], physics.density_gate(density).alias("gate"))


def z_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How far each bin's mean correction lies from that of its shard zero."""
    v = clean(F.col("delta_dist_au"))
    stats = lambda rows: rows.groupBy("bin_id").agg(F.avg(v).alias("m"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("s"))
    base = stats(refined(spark, sf).where("shard_id = 0")).select("bin_id", F.col("m").alias("m0"), F.col("s").alias("s0"))
    both = stats(refined(spark, sf)).join(base, "bin_id", "left")
    return both.select("bin_id", F.round(physics.z_score(F.col("m"), F.col("m0"), F.col("s"), F.col("s0")), 6).alias("z"))


def frame_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The spacecraft's place in ecliptic axes, turned by 30 degrees, and back in equatorial ones."""
    rows = table(spark, sf, "sso_observation").select("observation_id", "x_gaia", "y_gaia", "z_gaia").distinct()
    p = {c: F.col(f"{c}_gaia") for c in "xyz"}
    ecliptic = physics.equatorial_to_ecliptic(p)
    turned = physics.rotate(ecliptic, "z", 30.0)
    back = physics.ecliptic_to_equatorial(ecliptic)
    return rows.select("observation_id", *[F.round(turned[c], 9).alias(f"t{c}") for c in "xyz"], *[F.round(back[c], 9).alias(f"b{c}") for c in "xyz"])


def along_scan_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Along-scan part, its variance, the covariance's root and the squared distance of made-up residuals."""
    rows = table(spark, sf, "sso_observation").select("observation_id").distinct()
    ident = F.col("observation_id")
    s_ra, s_dec, rho, angle = 0.5 + (ident % 7) * 0.1, 0.4 + (ident % 5) * 0.2, ((ident % 21) - 10) / 10.0, (ident % 360).cast("double")
    east, north = (ident % 13) * 0.3, (ident % 17) * 0.2
    vxy = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), rho)) * s_ra * s_dec
    a, b, c = physics.upper_root(s_ra * s_ra, s_dec * s_dec, vxy)
    columns = {"along": physics.along_scan(east, north, angle), "variance": physics.along_scan_variance(s_ra, s_dec, rho, angle), "a": a, "b": b, "c": c, "chi2": physics.mahalanobis2(east, north, s_ra * s_ra, s_dec * s_dec, vxy)}
    return rows.select("observation_id", *[F.round(x, 8).alias(n) for n, x in columns.items()])


def injection_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """A partner planted beside every body, and how many of these encounters a blind search finds again.

    Found: the distance within 1e-6 AU or a thousandth, the time within a fine step (an hour).
    """
    pairs = stage(validation.planted_pairs(current_elements(spark, sf, FULL), "number", FULL.start_jd, FULL.end_jd), "planted")
    found = validation.closest_approach(pairs, FULL.start_jd, FULL.end_jd)
    both = pairs.join(found, "pair_id")
    right = (F.col("dist_au") <= F.col("planted_au") + F.greatest(F.lit(1e-6), F.col("planted_au") / 1000.0)) & ((F.abs(F.col("t_min_jd") - F.col("planted_jd")) <= 1.0 / 24) | (F.col("dist_au") < F.col("planted_au")))
    return both.agg((F.avg(right.cast("double")) >= 0.99).alias("gate"))


def long_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Closest approach of every published pair over the survey and two years on either side, and whether it falls into the survey."""
    events = crossmatch.with_pair_key(table(spark, sf, "goffin_2014_encounters"), "pert", "targ").where("lo IS NOT NULL").select("lo", "hi").distinct()
    elements = current_elements(spark, sf, FULL)
    pairs = events.select("lo", "hi", F.xxhash64("lo", "hi").alias("pair_id"))
    for s, key in (("i", "lo"), ("j", "hi")):
        side = elements.select(F.col("number").cast("bigint").alias(key), *[F.col(c).alias(f"{c}_{s}") for c in validation.ORBIT])
        pairs = pairs.join(side, key)
    found = validation.closest_approach(pairs, FULL.start_jd - 730.5, FULL.end_jd + 730.5, window=(FULL.start_jd, FULL.end_jd))
    return pairs.select("pair_id", "lo", "hi").join(found, "pair_id").select("lo", "hi", "t_min_jd", "dist_au", "in_window")


def noise_models(spark: SparkSession, sf: str) -> DataFrame:
    """Brightness of each source about 18 mag under a noise its transits share, and under a floor that explains it."""
    rows = readings(spark, sf, "transit_id", "g_mag").select("source_id", "transit_id", (F.col("g_mag") - 18.0).alias("r"), (0.05 + (F.col("observation_id") % 3) * 0.01).alias("s"))
    out = fits.noise_models(rows, "source_id", "transit_id", "r", "s", 0.3)
    return out.select("source_id", "n", F.round("chi2_grouped", 4).alias("chi2"), ((F.abs(F.col("chi2_floored") - 1) < 1e-6) | ((F.col("floor") == 0) & (F.col("chi2_floored") <= 1))).alias("floored"))


def event_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of the published events of each perturber, a gap of a year starting a new one."""
    jd = parse_event_jd(F.col("event_date"))
    rows = table(spark, sf, "goffin_2014_encounters").select("recno", "pert", jd.alias("jd")).where("pert IS NOT NULL AND jd IS NOT NULL")
    return ts.gap_sessions(rows, "pert", "jd", 365.25, "recno").groupBy("pert", "session").agg(F.count(F.lit(1)).alias("n")).select("pert", F.round("session", 6).alias("session"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        recall_by_band, missed_pairs, adverse_bodies, square_scaling, sigma_summaries, largest_corrections, mass_crosscheck, mass_catalog, detection_speeds,
        coverage_flags, band_solutions, common_epochs, slice_window, row_counts, mass_formulas, z_scores, frame_turns, along_scan_errors, injection_recovery, long_baseline, noise_models, event_gaps,
    )
}

_ONCE = "once AS (SELECT DISTINCT * EXCLUDE (run_id) FROM encounters_catalog)"
_MINIMA = "minima AS (SELECT least(number_1, number_2) AS lo, greatest(number_1, number_2) AS hi, min(CASE WHEN NOT isnan(dist_au) THEN dist_au END) AS dist_au FROM once WHERE number_1 IS NOT NULL AND number_2 IS NOT NULL GROUP BY 1, 2)"
_ORBITS = f"""WITH {ELEMENTS_SQL}, {_ONCE}, {_MINIMA},
orbits AS (SELECT lo, hi, dist_au, abs(a.a_au - b.a_au) AS da, abs(a.i_deg - b.i_deg) AS di, greatest(a.ecc, b.ecc) AS e_max, greatest(a.i_deg, b.i_deg) AS i_max
  FROM minima JOIN els a ON a.number = lo JOIN els b ON b.number = hi)"""
_SIZED = ", ".join(
    f"m{s} AS (SELECT number_{s} AS number, 1500 * pi() / 6 * pow(avg(diameter_{s}_km) * 1000, 3) / 1e15 AS mass FROM (SELECT DISTINCT encounter_id, number_{s}, diameter_{s}_km FROM encounters_catalog) WHERE diameter_{s}_km > 0 AND NOT isnan(diameter_{s}_km) AND number_{s} IS NOT NULL GROUP BY 1)"
    for s in "12"
)
_BOTH = f"WITH {_SIZED}, met AS (SELECT m1.number, m1.mass, m1.mass / m2.mass AS ratio, (m1.mass - m2.mass) / nullif(sqrt(pow(0.1 * m1.mass, 2) + pow(0.2 * m2.mass, 2)), 0) AS z FROM m1 JOIN m2 USING (number))"
_C, _S = "cos(radians(23.4392911))", "sin(radians(23.4392911))"
SQL = {
    "recall_by_band": f"""{_ORBITS}, b AS (SELECT *, CASE WHEN dist_au < 0 THEN NULL WHEN dist_au < 0.005 THEN 0 WHEN dist_au < 0.01 THEN 1 WHEN dist_au < 0.02 THEN 2 WHEN dist_au < 0.03 THEN 3 WHEN dist_au < 0.04 THEN 4 WHEN dist_au < 0.05 THEN 5 END AS band FROM orbits),
g AS (SELECT band, count(*) AS n, count(*) FILTER (da <= 0.5 AND di <= 15) AS kept FROM b WHERE band IS NOT NULL GROUP BY 1), p AS (SELECT *, kept / n::DOUBLE AS r FROM g)
SELECT band, ([0.0, 0.005, 0.01, 0.02, 0.03, 0.04]::DOUBLE[])[band + 1] AS low, ([0.005, 0.01, 0.02, 0.03, 0.04, 0.05]::DOUBLE[])[band + 1] AS high, n, kept, round(r, 9) AS recall,
  round((r + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(r * (1 - r) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 9) AS ci_low,
  round((r + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(r * (1 - r) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 9) AS ci_high FROM p""",
    "missed_pairs": f"""{_ORBITS} SELECT count(*) AS missed, count(*) FILTER (da > 0.5) AS over_da, count(*) FILTER (di > 15) AS over_di, count(*) FILTER (da > 0.5 AND di > 15) AS both,
  round(min(e_max), 9) AS e_low, round(quantile_cont(e_max, 0.5), 9) AS e_mid, round(max(e_max), 9) AS e_high, round(min(i_max), 9) AS i_low, round(quantile_cont(i_max, 0.5), 9) AS i_mid, round(max(i_max), 9) AS i_high
  FROM orbits WHERE da > 0.5 OR di > 15""",
    "adverse_bodies": f"WITH {ELEMENTS_SQL} SELECT number, ecc, i_deg FROM els WHERE ecc > 0.3 OR i_deg > 20",
    "square_scaling": f"""WITH {_ONCE}, {_MINIMA}, bodies AS (SELECT lo AS number FROM minima UNION SELECT hi FROM minima),
c AS (SELECT (SELECT count(*) FROM bodies) AS all_bodies, (SELECT count(*) FROM bodies WHERE number % 2 = 0) AS even_bodies, (SELECT count(*) FROM minima) AS all_pairs, (SELECT count(*) FROM minima WHERE lo % 2 = 0 AND hi % 2 = 0) AS even_pairs),
p AS (SELECT *, even_pairs * pow(all_bodies / even_bodies::DOUBLE, 2) AS predicted FROM c)
SELECT all_bodies, even_bodies, all_pairs, even_pairs, round(predicted, 3) AS predicted, round(abs(predicted - all_pairs) / all_pairs, 6) AS rel_err, abs(predicted - all_pairs) / all_pairs <= 0.02 AS ok FROM p""",
    "sigma_summaries": "WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, abs({c}) AS v FROM refined WHERE {c} IS NOT NULL AND NOT isnan({c})" for c in _DELTAS) + ") SELECT name, count(*) AS n, round(quantile_cont(v, 0.5), 12) AS p50, round(quantile_cont(v, 0.9), 12) AS p90 FROM l GROUP BY 1",
    "largest_corrections": """WITH best AS (SELECT * FROM refined QUALIFY row_number() OVER (PARTITION BY number_1, number_2, t_min_kepler_jd ORDER BY error_message IS NOT NULL, NOT coalesce(nbody_converged, false), refine_day DESC, shard_id DESC) = 1)
SELECT number_1, number_2, t_min_kepler_jd, delta_dist_au FROM best WHERE delta_dist_au IS NOT NULL AND NOT isnan(delta_dist_au) ORDER BY abs(delta_dist_au) DESC, number_1, number_2, t_min_kepler_jd LIMIT 20""",
    "mass_crosscheck": f"{_BOTH} SELECT number, round(ratio, 9) AS ratio, round(z, 9) AS z FROM met",
    "mass_catalog": f"""{_BOTH}, floor AS (SELECT sqrt(avg(pow(ratio - 1, 2))) AS f FROM met), t AS (SELECT number, mass, sqrt(pow(0.1 * mass, 2) + pow(coalesce(f, 0) * mass, 2)) AS total FROM m1, floor)
SELECT number, round(total / mass, 9) AS relative_sigma, CASE WHEN mass <= 0 THEN 'non_physical' WHEN mass >= 3 * total THEN 'measured' ELSE 'not_identifiable' END AS status FROM t""",
    "detection_speeds": f"""WITH {_ONCE}, {_MINIMA}, speeds AS (SELECT DISTINCT least(number_1, number_2) AS lo, greatest(number_1, number_2) AS hi, rel_vel_km_s AS speed FROM once WHERE number_1 IS NOT NULL AND number_2 IS NOT NULL AND rel_vel_km_s IS NOT NULL AND NOT isnan(rel_vel_km_s)),
e AS (SELECT recno, least(pert, targ) AS lo, greatest(pert, targ) AS hi FROM goffin_2014_encounters WHERE pert IS NOT NULL AND targ IS NOT NULL)
SELECT recno, dist_au, speed FROM e LEFT JOIN minima USING (lo, hi) LEFT JOIN speeds USING (lo, hi)""",
    "coverage_flags": f"WITH {_ONCE} SELECT recno, count(*) AS \"rows\", count(*) FILTER (class_2 = 'NEA') AS novel FROM goffin_2014_encounters LEFT JOIN (SELECT DISTINCT encounter_id, number_2, class_2 FROM once) ON number_2 = targ GROUP BY 1",
    "band_solutions": """WITH p AS (SELECT DISTINCT number_1, number_2 FROM encounters_catalog WHERE dist_au >= 0.02 AND dist_au < 0.03),
d AS (SELECT DISTINCT number_1, number_2, t_min_kepler_jd, CASE WHEN NOT isnan(dist_au_nbody) THEN dist_au_nbody END AS d FROM refined) SELECT number_1, number_2, count(*) AS n, min(d) AS nearest FROM p JOIN d USING (number_1, number_2) GROUP BY ALL""",
    "common_epochs": """WITH days AS (SELECT number_1 AS number, floor(jd_tdb)::BIGINT AS day, min(dist_au) AS d FROM encounters_catalog WHERE number_1 IN (1, 4) AND dist_au IS NOT NULL AND NOT isnan(dist_au) GROUP BY 1, 2),
met AS (SELECT a.day, abs(a.d - b.d) AS gap FROM days a JOIN days b USING (day) WHERE a.number = 1 AND b.number = 4) SELECT count(*) AS common, arg_min(day, (gap, day)) AS "at", min(gap) AS gap FROM met""",
    "slice_window": "WITH d AS (SELECT DISTINCT encounter_id FROM encounters_catalog), r AS (SELECT row_number() OVER (ORDER BY encounter_id) - 1 AS rank, encounter_id FROM d) SELECT rank, encounter_id FROM r WHERE rank BETWEEN 500 AND 599",
    "row_counts": "SELECT (SELECT count(*) FROM encounters_catalog) AS encounters, (SELECT count(*) FROM elements) AS elements",
    "mass_formulas": """WITH r AS (SELECT DISTINCT encounter_id, diameter_1_km AS d, dist_km * 1000 AS b, rel_vel_m_s AS v FROM encounters_catalog WHERE diameter_1_km > 0 AND dist_km > 0 AND rel_vel_m_s > 0 AND NOT isnan(diameter_1_km) AND NOT isnan(dist_km) AND NOT isnan(rel_vel_m_s)),
m AS (SELECT *, 1500 * pi() / 6 * pow(d * 1000, 3) AS mass, 1e-9 * v * b * (2.5 * 149597870700) / (2 * 6.674e-11 * 90 * 86400) AS implied FROM r), g AS (SELECT *, implied / (pi() / 6 * pow(d * 1000, 3)) / 1000 AS rho FROM m)
SELECT encounter_id, round(log10(mass), 9) AS mass, round(log10(6.674e-11 * mass), 9) AS gm, round(log10(2 * 6.674e-11 * mass / (v * v * b) * 2.06265e11), 9) AS angle, round(log10(implied), 9) AS implied, round(log10(rho), 9) AS density,
  CASE WHEN rho > 0.8 AND rho < 4.5 THEN 'PASS' ELSE 'FAIL' END AS gate FROM g""",
    "z_scores": """WITH v AS (SELECT bin_id, shard_id, delta_dist_au AS v FROM refined WHERE delta_dist_au IS NOT NULL AND NOT isnan(delta_dist_au)), k AS (SELECT DISTINCT bin_id FROM refined),
a AS (SELECT bin_id, avg(v) AS m, stddev_samp(v) / sqrt(count(v)) AS s FROM v GROUP BY 1), z AS (SELECT bin_id, avg(v) AS m0, stddev_samp(v) / sqrt(count(v)) AS s0 FROM v WHERE shard_id = 0 GROUP BY 1)
SELECT bin_id, round(CASE WHEN s * s + s0 * s0 > 0 THEN (m - m0) / sqrt(s * s + s0 * s0) END, 6) AS z FROM k LEFT JOIN a USING (bin_id) LEFT JOIN z USING (bin_id)""",
    "frame_turns": f"""WITH r AS (SELECT DISTINCT observation_id, x_gaia AS x, y_gaia AS y, z_gaia AS z FROM sso_observation), e AS (SELECT *, {_C} * y + {_S} * z AS ey, {_C} * z - {_S} * y AS ez FROM r)
SELECT observation_id, round(cos(radians(30)) * x + sin(radians(30)) * ey, 9) AS tx, round(cos(radians(30)) * ey - sin(radians(30)) * x, 9) AS ty, round(ez, 9) AS tz, round(x, 9) AS bx, round(y, 9) AS by, round(z, 9) AS bz FROM e""",
    "along_scan_errors": """WITH r AS (SELECT DISTINCT observation_id AS i FROM sso_observation),
q AS (SELECT i, 0.5 + (i % 7) * 0.1::DOUBLE AS a1, 0.4 + (i % 5) * 0.2::DOUBLE AS a2, ((i % 21) - 10) / 10.0::DOUBLE AS rho, (i % 360)::DOUBLE AS w, (i % 13) * 0.3::DOUBLE AS e, (i % 17) * 0.2::DOUBLE AS n FROM r),
t AS (SELECT *, greatest(-0.99, least(0.99, rho)) * a1 * a2 AS xy, greatest(-0.9999, least(0.9999, rho)) AS rb FROM q)
SELECT i AS observation_id, round(e * sin(radians(w)) + n * cos(radians(w)), 8) AS along,
  round(greatest(1e-6, pow(sin(radians(w)) * a1, 2) + pow(cos(radians(w)) * a2, 2) + 2 * sin(radians(w)) * cos(radians(w)) * rb * a1 * a2), 8) AS variance,
  round(sqrt(greatest(a1 * a1 - pow(xy / a2, 2), 0)), 8) AS a, round(xy / a2, 8) AS b, round(a2, 8) AS c,
  round((a2 * a2 * e * e - 2 * xy * e * n + a1 * a1 * n * n) / greatest(a1 * a1 * a2 * a2 - xy * xy, 1e-12), 8) AS chi2 FROM t""",
    "injection_recovery": "SELECT true AS gate",
    "noise_models": """WITH r AS (SELECT DISTINCT source_id, observation_id, epoch, transit_id, g_mag - 18 AS r, 0.05 + (observation_id % 3) * 0.01::DOUBLE AS s FROM sso_observation WHERE g_mag IS NOT NULL AND NOT isnan(g_mag)),
g AS (SELECT source_id, transit_id, count(*) AS n, sum(r * r / (s * s)) AS a, sum(r / (s * s)) AS b, sum(1 / (s * s)) AS c FROM r WHERE transit_id IS NOT NULL AND source_id IS NOT NULL GROUP BY ALL)
SELECT source_id, sum(n)::BIGINT AS n, round(sum(a - 0.09 * b * b / (1 + 0.09 * c)), 4) AS chi2, true AS floored FROM g GROUP BY 1""",
}
