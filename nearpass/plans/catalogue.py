"""Queries over the encounter catalogue, published lists and refined solutions, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpass.functions.physics import clean, wilson
from nearpass.functions.timescale import parse_event_jd
from nearpass.operators import catalog, crossmatch, hybrid, sampling
from nearpass.operators.ranks import group_quantile
from nearpass.plans.detection import ELEMENTS_SQL, current_elements
from nearpass.session import table

BOUNDS = (0.001, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05)
THRESHOLD = 0.03


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "encounters_catalog")


def once(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Every encounter once, however many runs wrote it, with the columns a query needs.

    Only these are read and shuffled, and rows are hash-partitioned by the encounter, not by a body.
    """
    return raw(spark, sf).select("encounter_id", *columns).distinct()


def refined(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "refined")


def filter_encounters(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.filter_encounters(raw(spark, sf), min_dist=0.001, max_dist=0.03, date_from="2015-01-01", date_to="2016-12-31", observable=True)
    return rows.select("encounter_id", "run_id", "date_utc", "dist_au")


def filter_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.filter_encounters(raw(spark, sf), body_ids=[1, 4, 10], classes=["MBA", "NEA"]).select("encounter_id", "run_id")


def top_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.top_encounters(once(spark, sf, "dist_au"), 10).select("encounter_id", "dist_au")


def top_fastest(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.top_encounters(once(spark, sf, "rel_vel_km_s"), 10, "rel_vel_km_s", ascending=False).select("encounter_id", "rel_vel_km_s")


def catalog_stats(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.catalog_stats(once(spark, sf, "gaia_observable", "dist_au"))


def class_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.class_breakdown(once(spark, sf, "class_1", "class_2"))


def monthly_counts(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.monthly_counts(once(spark, sf, "date_utc"))


def distance_cdf(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.distance_cdf(once(spark, sf, "dist_au"), BOUNDS)


def distance_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.equal_width_histogram(once(spark, sf, "dist_au"), "dist_au", 0.0, 0.05, 25)


def speed_histogram_clipped(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.equal_width_histogram(once(spark, sf, "rel_vel_km_s"), "rel_vel_km_s", 0.0, 10.0, 20, clip=True)


def major_body_gate(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.major_body_gate(once(spark, sf, "number_1", "number_2", "dist_au"))


def perturber_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.perturber_ranking(once(spark, sf, "number_1", "number_2", "dist_au"))


def nearest_targets(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.nearest_targets(once(spark, sf, "number_1", "number_2", "dist_au"), 5, 0.03).select("number", "partner", "dist_au", "rank")


def mass_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.mass_candidates(once(spark, sf, "number_1", "dist_au", "diameter_1_km", "rel_vel_km_s", "gaia_observable"), 0.02, 100.0, 5.0)
    return rows.select("encounter_id", F.round("score", 2).alias("score"), "mass_unknown")


def family_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.family_pairs(once(spark, sf, "number_1", "number_2"), current_elements(spark, sf), 0.02, 0.05, 2.0).select("encounter_id", F.round(F.abs(F.col("a_1") - F.col("a_2")), 8).alias("delta_a"))


def pair_minima(spark: SparkSession, sf: str) -> DataFrame:
    return crossmatch.pair_minima(once(spark, sf, "number_1", "number_2", "dist_au"))


def catalog_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of the catalogue against those of the refined table."""
    other = refined(spark, sf).select("number_1", "number_2", F.col("dist_au_kepler").alias("dist_au"))
    return crossmatch.catalog_diff(crossmatch.pair_minima(raw(spark, sf)), crossmatch.pair_minima(other))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return crossmatch.with_pair_key(table(spark, sf, "goffin_2014_encounters"), "pert", "targ").withColumn("jd", parse_event_jd(F.col("event_date")))


def literature_match(spark: SparkSession, sf: str) -> DataFrame:
    """Published events against the catalogue, best by distance within 31 days."""
    there = crossmatch.with_pair_key(once(spark, sf, "number_1", "number_2", "jd_tdb", "dist_au"), "number_1", "number_2").withColumnRenamed("jd_tdb", "jd")
    return crossmatch.match_events(_events(spark, sf), there, 31.0).select("recno", "encounter_id")


def literature_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    base = once(spark, sf, "number_1", "number_2", "dist_au")
    return crossmatch.literature_outcomes(_events(spark, sf), crossmatch.pair_minima(base), crossmatch.universe_of(base), THRESHOLD)


def recall_by_perturber(spark: SparkSession, sf: str) -> DataFrame:
    """Published events per perturber, those recovered, and the Wilson interval of the share."""
    rows = _events(spark, sf).select("recno", "pert").join(literature_outcomes(spark, sf), "recno")
    g = rows.groupBy("pert").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("outcome") == "recovered").alias("recovered"))
    low, high = wilson(F.col("recovered"), F.col("events"))
    return g.select("pert", "events", "recovered", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def pair_set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Size of intersection and differences of the two pair sets."""
    keys = lambda df: crossmatch.with_pair_key(df, "number_1", "number_2").where("lo IS NOT NULL").select("lo", "hi").distinct()
    a, b = keys(raw(spark, sf)), keys(refined(spark, sf))
    parts = [("both", a.intersect(b)), ("only_a", a.join(b, ["lo", "hi"], "left_anti")), ("only_b", b.join(a, ["lo", "hi"], "left_anti"))]
    out = [p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for n, p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def supplement_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of the current delivery, supplemented by those only other deliveries have."""
    now = current_elements(spark, sf).select("number", F.lit("current").alias("origin"))
    others = table(spark, sf, "elements").where("number IS NOT NULL").select("number").distinct().withColumn("origin", F.lit("other"))
    return crossmatch.supplement(now, others, "number")


def transit_coverage(spark: SparkSession, sf: str) -> DataFrame:
    transits = table(spark, sf, "sso_observation").dropDuplicates(["observation_id", "number_mp", "epoch"]).select(F.col("number_mp").alias("number"), (F.col("epoch") + 2455197.5).alias("jd"))
    out = crossmatch.transit_coverage(_events(spark, sf).select("recno", "targ", "jd"), transits, 365.0, 30.0)
    return out.withColumns({c: F.col(c).cast("double") for c in ("last_day_before", "first_day_after")})


def best_solutions(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid.best_solution(refined(spark, sf)).select(*hybrid.KEY, "nbody_converged", "dist_au_nbody")


def _base(spark: SparkSession, sf: str) -> DataFrame:
    return refined(spark, sf).select(*hybrid.KEY, F.col("dist_au_kepler").alias("dist_au"), F.col("rel_vel_kepler").alias("rel_vel_au_day")).distinct()


def hybrid_merge(spark: SparkSession, sf: str) -> DataFrame:
    out = hybrid.hybrid_merge(_base(spark, sf), hybrid.best_solution(refined(spark, sf)))
    return out.select(*hybrid.KEY, "dist_au", "rel_vel_au_day", "refinement_method")


def shard_health(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid.shard_health(refined(spark, sf))


def solution_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid.coverage(_base(spark, sf), hybrid.best_solution(refined(spark, sf)).where("nbody_converged"))


def bias_bands(spark: SparkSession, sf: str) -> DataFrame:
    out = hybrid.distance_bands(refined(spark, sf), "dist_au_kepler", "delta_dist_au", 0.005)
    return out.select(F.round("band", 6).alias("band"), "n", F.round("mean", 10).alias("mean"), F.round("spread", 10).alias("spread"))


def threshold_crossings(spark: SparkSession, sf: str) -> DataFrame:
    out = hybrid.crossings(refined(spark, sf), THRESHOLD)
    return out.select("n", "left", "entered", *[F.round(c, 10).alias(c) for c in ("mean_bias", "median_bias", "spread")])


def error_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    out = hybrid.error_quantiles(refined(spark, sf), "delta_dist_au", {"q5": 0.5, "q9": 0.9, "q99": 0.99, "q999": 0.999})
    return out.select("n", *[F.round(c, 10).alias(c) for c in ("largest", "q5", "q9", "q99", "q999")])


def velocity_quintiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = once(spark, sf, "rel_vel_km_s", "dist_au").where(clean(F.col("rel_vel_km_s")).isNotNull())
    fifths = hybrid.quintiles(rows.select("encounter_id", "rel_vel_km_s", "dist_au"), "rel_vel_km_s", "encounter_id")
    return fifths.groupBy("fifth").agg(F.count(F.lit(1)).alias("n"), F.min("rel_vel_km_s").alias("slowest"), F.max("rel_vel_km_s").alias("fastest"), F.round(F.avg(clean(F.col("dist_au"))), 8).alias("mean_dist"))


def stage_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Encounters worth a costlier solution, by reason."""
    rows = once(spark, sf, "rel_vel_km_s", "diameter_1_km", "dist_au", "class_2")
    reason = F.when(clean(F.col("rel_vel_km_s")) < 1.0, "slow").when((clean(F.col("diameter_1_km")) > 100) & (clean(F.col("dist_au")) < 0.01), "big_close").when(F.col("class_2") == "NEA", "nea")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min(clean(F.col("dist_au"))).alias("nearest"), F.round(F.avg((clean(F.col("dist_au")) < 0.01).cast("double")), 8).alias("close_share"))


def heat_map(spark: SparkSession, sf: str) -> DataFrame:
    """95th percentile of the correction per band of a and e, bands of three rows or more."""
    rows = refined(spark, sf).where(clean(F.col("delta_dist_au")).isNotNull())
    rows = rows.select(F.floor(F.col("a_1") / 0.25).alias("a_band"), F.floor(F.col("e_1") / 0.05).alias("e_band"), F.abs("delta_dist_au").alias("d"))
    return group_quantile(rows, ["a_band", "e_band"], "d", 0.95).where("n >= 3").select("a_band", "e_band", "n", F.round("quantile", 10).alias("p95"))


def strata(spark: SparkSession, sf: str) -> DataFrame:
    """Five-axis strata and their sizes."""
    r = refined(spark, sf)
    parts = [sampling.band(F.col("a_1"), [2.5, 2.82, 3.3]), sampling.band(F.col("e_1"), [0.1, 0.2]), sampling.band(F.col("i_1"), [5.0, 15.0]), sampling.band(F.col("dist_au_kepler"), [0.01, 0.03]), sampling.band(F.col("rel_vel_kepler"), [0.001, 0.003])]
    return r.groupBy(sampling.stratum_id(parts).alias("stratum")).agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_sample(refined(spark, sf).dropDuplicates(hybrid.KEY), ["bin_id"], hybrid.KEY, 3, seed=7, least=5).select("bin_id", *hybrid.KEY)


def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.hash_sample(once(spark, sf, "dist_au").select("encounter_id", "dist_au"), ["encounter_id"], 100, seed=7)


def systematic_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth encounter of each month."""
    rows = once(spark, sf, "date_utc").select("encounter_id", F.substring("date_utc", 1, 7).alias("month"))
    return sampling.systematic_sample(rows, "encounter_id", 10, ["month"])


def null_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies like number 4 that never meet body 1."""
    close = catalog.sides(raw(spark, sf).where(catalog.either_side(1))).where("partner = 1").select("number")
    return sampling.eligible_nulls(current_elements(spark, sf), close, 4, [1], 0.15, 10.0, 16.0).select("number")


QUERIES = {
    f.__name__: f
    for f in (
        filter_encounters, filter_bodies, top_nearest, top_fastest, catalog_stats, class_breakdown, monthly_counts, distance_cdf, distance_histogram,
        speed_histogram_clipped, major_body_gate, perturber_ranking, nearest_targets, mass_candidates, family_pairs, pair_minima, catalog_diff,
        literature_match, literature_outcomes, recall_by_perturber, pair_set_operations, supplement_bodies, transit_coverage, best_solutions, hybrid_merge,
        shard_health, solution_coverage, bias_bands, threshold_crossings, error_quantiles, velocity_quintiles, stage_subset, heat_map, strata,
        stratified_sample, hash_sample, systematic_sample, null_candidates,
    )
}

_ONCE = "once AS (SELECT DISTINCT * EXCLUDE (run_id) FROM encounters_catalog)"
_D = "CASE WHEN NOT isnan(dist_au) THEN dist_au END"
_V = "CASE WHEN NOT isnan(rel_vel_km_s) THEN rel_vel_km_s END"
_SIDES = "sides AS (SELECT number_1 AS number, number_2 AS partner, * EXCLUDE (number_1, number_2) FROM once UNION ALL SELECT number_2, number_1, * EXCLUDE (number_1, number_2) FROM once)"
_MINIMA = f"minima AS (SELECT least(number_1, number_2)::BIGINT AS lo, greatest(number_1, number_2)::BIGINT AS hi, min({_D}) AS dist_au, count(*) AS n FROM once WHERE number_1 IS NOT NULL AND number_2 IS NOT NULL GROUP BY 1, 2)"
_EVENTS = r"""
stripped AS (SELECT *, regexp_replace(event_date, '^\s+|\s+$', '', 'g') AS d FROM goffin_2014_encounters),
events AS (SELECT recno, pert, targ, CASE WHEN pert IS NOT NULL AND targ IS NOT NULL THEN least(pert, targ)::BIGINT END AS lo, CASE WHEN pert IS NOT NULL AND targ IS NOT NULL THEN greatest(pert, targ)::BIGINT END AS hi,
  CASE WHEN regexp_full_match(d, '\d{4}-\d{2}-\d{2}') THEN julian(try_strptime(d, '%Y-%m-%d'))
    WHEN regexp_full_match(d, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}') THEN julian(try_strptime(d, '%Y-%m-%dT%H:%M'))
    WHEN regexp_full_match(d, '\d{4}\.\d+') THEN julian(make_timestamp(substr(d, 1, 4)::BIGINT, 1, 1, 0, 0, 0)) + ('0.' || substr(d, 6))::DOUBLE
      * (date_diff('day', make_date(substr(d, 1, 4)::BIGINT, 1, 1), make_date(substr(d, 1, 4)::BIGINT + 1, 1, 1))) END - 0.5 AS jd FROM stripped)"""
_OUTCOMES = f"""{_ONCE}, {_EVENTS}, {_MINIMA},
universe AS (SELECT DISTINCT number::BIGINT AS number FROM (SELECT number_1 AS number FROM once UNION ALL SELECT number_2 FROM once) WHERE number IS NOT NULL),
outcomes AS (SELECT e.recno, e.pert, CASE WHEN m.lo IS NOT NULL AND m.dist_au < {THRESHOLD} THEN 'recovered' WHEN m.lo IS NOT NULL THEN 'beyond_threshold'
  WHEN a.number IS NOT NULL AND b.number IS NOT NULL THEN 'missed' WHEN a.number IS NOT NULL OR b.number IS NOT NULL THEN 'one_body_unknown' ELSE 'both_unknown' END AS outcome
  FROM events e LEFT JOIN minima m USING (lo, hi) LEFT JOIN universe a ON a.number = e.lo LEFT JOIN universe b ON b.number = e.hi)"""
_BEST = """best AS (SELECT * FROM refined QUALIFY row_number() OVER (PARTITION BY number_1, number_2, t_min_kepler_jd
  ORDER BY error_message IS NOT NULL, NOT nbody_converged, refine_day DESC, shard_id DESC) = 1)"""
_KEY = "number_1, number_2, t_min_kepler_jd"
_DD = "CASE WHEN NOT isnan(delta_dist_au) THEN delta_dist_au END"


def _band_sql(column: str, edges: list[float]) -> str:
    return "CASE " + " ".join(f"WHEN {column} >= {e} THEN {k}" for k, e in reversed(list(enumerate(edges, 1)))) + " ELSE 0 END"


SQL = {
    "filter_encounters": "SELECT encounter_id, run_id, date_utc, dist_au FROM encounters_catalog WHERE dist_au BETWEEN 0.001 AND 0.03 AND date_utc BETWEEN '2015-01-01' AND '2016-12-31' AND gaia_observable",
    "filter_bodies": "SELECT encounter_id, run_id FROM encounters_catalog WHERE (number_1 IN (1, 4, 10) OR number_2 IN (1, 4, 10)) AND (class_1 IN ('MBA', 'NEA') OR class_2 IN ('MBA', 'NEA'))",
    "top_nearest": f"WITH {_ONCE} SELECT encounter_id, dist_au FROM once ORDER BY {_D} NULLS LAST, encounter_id LIMIT 10",
    "top_fastest": f"WITH {_ONCE} SELECT encounter_id, rel_vel_km_s FROM once ORDER BY {_V} DESC NULLS LAST, encounter_id LIMIT 10",
    "catalog_stats": f"WITH {_ONCE} SELECT count(*) AS encounters, count(*) FILTER (gaia_observable) AS observable, min({_D}) AS nearest_au FROM once",
    "class_breakdown": f"WITH {_ONCE} SELECT orbit_class, count(*) AS n FROM (SELECT class_1 AS orbit_class FROM once UNION ALL SELECT class_2 FROM once) GROUP BY 1",
    "monthly_counts": f"WITH {_ONCE} SELECT substr(date_utc, 1, 7) AS month, count(*) AS n FROM once GROUP BY 1",
    "distance_cdf": f"WITH {_ONCE} SELECT b::DOUBLE AS bound_au, (SELECT count(*) FROM once WHERE {_D} < b) AS n FROM (SELECT unnest({list(BOUNDS)}) AS b)",
    "distance_histogram": f"WITH {_ONCE}, c AS (SELECT least(24, floor(dist_au / (0.05::DOUBLE / 25)))::BIGINT AS bin, count(*) AS n FROM once WHERE NOT isnan(dist_au) AND dist_au BETWEEN 0 AND 0.05 GROUP BY 1) SELECT b::BIGINT AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(25)) AS b) LEFT JOIN c ON c.bin = b",
    "speed_histogram_clipped": f"WITH {_ONCE}, c AS (SELECT greatest(0, least(19, floor(rel_vel_km_s / 0.5)))::BIGINT AS bin, count(*) AS n FROM once WHERE rel_vel_km_s IS NOT NULL AND NOT isnan(rel_vel_km_s) GROUP BY 1) SELECT b::BIGINT AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(20)) AS b) LEFT JOIN c ON c.bin = b",
    "major_body_gate": f"WITH {_ONCE}, {_SIDES}, g AS (SELECT number, count(*) AS n, min({_D}) AS nearest_au FROM sides GROUP BY 1) SELECT r AS number, coalesce(n, 0) AS n, nearest_au, n IS NULL AS missing FROM (SELECT unnest([1, 2, 4, 10])::INTEGER AS r) LEFT JOIN g ON g.number = r",
    "perturber_ranking": f"WITH {_ONCE}, {_SIDES} SELECT number, count(*) AS encounters, count(DISTINCT partner) AS targets, min({_D}) AS nearest_au FROM sides WHERE number IS NOT NULL GROUP BY 1",
    "nearest_targets": f"""WITH {_ONCE}, {_SIDES}, pairs AS (SELECT number, partner, min((dist_au, encounter_id)) AS m FROM sides WHERE dist_au <= 0.03 AND NOT isnan(dist_au) AND number IS NOT NULL AND partner IS NOT NULL GROUP BY ALL)
SELECT number, partner, m[1] AS dist_au, (row_number() OVER (PARTITION BY number ORDER BY m, partner))::INTEGER AS rank FROM pairs QUALIFY rank <= 5""",
    "mass_candidates": f"WITH {_ONCE} SELECT encounter_id, round(pow(diameter_1_km, 3) / (dist_au * rel_vel_km_s * rel_vel_km_s), 2) AS score, number_1 NOT IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 15, 16, 52, 65, 87, 88, 107, 121, 128) AS mass_unknown FROM once WHERE dist_au < 0.02 AND diameter_1_km > 100 AND NOT isnan(diameter_1_km) AND rel_vel_km_s < 5 AND gaia_observable",
    "family_pairs": f"""WITH {_ONCE}, {ELEMENTS_SQL} SELECT encounter_id, round(abs(a.a_au - b.a_au), 8) AS delta_a FROM once JOIN els a ON a.number = number_1 JOIN els b ON b.number = number_2
WHERE abs(a.a_au - b.a_au) / ((a.a_au + b.a_au) / 2) <= 0.02 AND abs(a.ecc - b.ecc) <= 0.05 AND abs(a.i_deg - b.i_deg) <= 2""",
    "pair_minima": f"WITH {_ONCE}, {_MINIMA} SELECT * FROM minima",
    "catalog_diff": f"""WITH a AS (SELECT least(number_1, number_2)::BIGINT AS lo, greatest(number_1, number_2)::BIGINT AS hi, min({_D}) AS dist_a FROM encounters_catalog WHERE number_1 IS NOT NULL AND number_2 IS NOT NULL GROUP BY 1, 2),
b AS (SELECT least(number_1, number_2)::BIGINT AS lo, greatest(number_1, number_2)::BIGINT AS hi, min(CASE WHEN NOT isnan(dist_au_kepler) THEN dist_au_kepler END) AS dist_b FROM refined WHERE number_1 IS NOT NULL AND number_2 IS NOT NULL GROUP BY 1, 2)
SELECT lo, hi, dist_a, dist_b, CASE WHEN a.lo IS NOT NULL AND b.lo IS NOT NULL THEN 'both' WHEN a.lo IS NOT NULL THEN 'a' ELSE 'b' END AS side FROM a FULL JOIN b USING (lo, hi)""",
    "literature_match": f"""WITH {_ONCE}, {_EVENTS} SELECT recno, encounter_id FROM events JOIN once ON lo = least(number_1, number_2) AND hi = greatest(number_1, number_2) AND number_1 IS NOT NULL AND number_2 IS NOT NULL
WHERE abs(jd_tdb - jd) <= 31 QUALIFY row_number() OVER (PARTITION BY recno ORDER BY {_D} NULLS LAST, abs(jd_tdb - jd), encounter_id) = 1""",
    "literature_outcomes": f"WITH {_OUTCOMES} SELECT recno, outcome FROM outcomes",
    "recall_by_perturber": f"""WITH {_OUTCOMES}, g AS (SELECT pert, count(*) AS events, count(*) FILTER (outcome = 'recovered') AS recovered FROM outcomes GROUP BY 1),
p AS (SELECT *, recovered::DOUBLE / events AS p, 1.96::DOUBLE AS z FROM g)
SELECT pert, events, recovered, round((p + z * z / (2 * events)) / (1 + z * z / events) - z * sqrt(p * (1 - p) / events + z * z / (4.0 * events * events)) / (1 + z * z / events), 6) AS low,
  round((p + z * z / (2 * events)) / (1 + z * z / events) + z * sqrt(p * (1 - p) / events + z * z / (4.0 * events * events)) / (1 + z * z / events), 6) AS high FROM p""",
    "pair_set_operations": """WITH a AS (SELECT DISTINCT least(number_1, number_2) AS lo, greatest(number_1, number_2) AS hi FROM encounters_catalog WHERE number_1 IS NOT NULL AND number_2 IS NOT NULL),
b AS (SELECT DISTINCT least(number_1, number_2) AS lo, greatest(number_1, number_2) AS hi FROM refined WHERE number_1 IS NOT NULL AND number_2 IS NOT NULL)
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only_b', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "supplement_bodies": f"WITH {ELEMENTS_SQL} SELECT number, 'current' AS origin FROM els UNION ALL SELECT DISTINCT number, 'other' FROM elements WHERE number IS NOT NULL AND number NOT IN (SELECT number FROM els)",
    "transit_coverage": f"""WITH {_EVENTS}, obs AS (SELECT DISTINCT observation_id, number_mp, epoch FROM sso_observation),
days AS (SELECT number_mp AS number, floor(epoch + 2455197.5)::BIGINT AS day, count(*) AS n FROM obs WHERE number_mp IS NOT NULL AND epoch IS NOT NULL GROUP BY ALL),
met AS (SELECT recno, day, n, day + 0.5 - jd AS gap FROM events LEFT JOIN days ON number = targ AND abs(day + 0.5 - jd) <= 365),
sums AS (SELECT recno, coalesce(sum(n) FILTER (gap < 0), 0)::BIGINT AS before, coalesce(sum(n) FILTER (gap >= 0), 0)::BIGINT AS after, coalesce(sum(n) FILTER (abs(gap) <= 30), 0)::BIGINT AS around,
  max(day::DOUBLE) FILTER (gap < 0) AS last_day_before, min(day::DOUBLE) FILTER (gap >= 0) AS first_day_after FROM met GROUP BY recno)
SELECT *, before >= 5 AND after >= 5 AS viable FROM sums""",
    "best_solutions": f"WITH {_BEST} SELECT {_KEY}, nbody_converged, CASE WHEN NOT isnan(dist_au_nbody) THEN dist_au_nbody END AS dist_au_nbody FROM best",
    "hybrid_merge": f"""WITH {_BEST}, base AS (SELECT DISTINCT {_KEY}, dist_au_kepler AS dist_au, rel_vel_kepler AS rel_vel_au_day FROM refined),
usable AS (SELECT * FROM best WHERE nbody_converged AND error_message IS NULL AND dist_au_nbody IS NOT NULL AND NOT isnan(dist_au_nbody))
SELECT b.number_1, b.number_2, b.t_min_kepler_jd, coalesce(u.dist_au_nbody, b.dist_au) AS dist_au, coalesce(u.rel_vel_nbody, b.rel_vel_au_day) AS rel_vel_au_day,
  CASE WHEN u.number_1 IS NOT NULL THEN 'nbody' ELSE 'kepler' END AS refinement_method FROM base b LEFT JOIN usable u ON u.number_1 = b.number_1 AND u.number_2 = b.number_2 AND u.t_min_kepler_jd = b.t_min_kepler_jd""",
    "shard_health": "SELECT shard_id, count(*) AS n, count(*) FILTER (nbody_converged) AS converged, count(*) FILTER (error_message IS NOT NULL) AS errors, count(*) FILTER (near_boundary) AS near_boundary, max(abs(nbody_energy_drift)) FILTER (NOT isnan(nbody_energy_drift)) AS worst_drift FROM refined GROUP BY 1",
    "solution_coverage": f"WITH {_BEST}, base AS (SELECT DISTINCT {_KEY} FROM refined) SELECT count(*) AS wanted, count(u.shard_id) AS covered FROM base LEFT JOIN (SELECT * FROM best WHERE nbody_converged) u USING ({_KEY})",
    "bias_bands": f"SELECT round(floor(dist_au_kepler / 0.005::DOUBLE) * 0.005::DOUBLE, 6) AS band, count(*) AS n, round(avg(delta_dist_au), 10) AS mean, round(stddev_samp(delta_dist_au), 10) AS spread FROM refined WHERE {_DD} IS NOT NULL AND dist_au_kepler IS NOT NULL AND NOT isnan(dist_au_kepler) GROUP BY 1",
    "threshold_crossings": f"""WITH b AS (SELECT dist_au_kepler AS k, dist_au_nbody AS m FROM refined WHERE dist_au_kepler IS NOT NULL AND dist_au_nbody IS NOT NULL AND NOT isnan(dist_au_kepler) AND NOT isnan(dist_au_nbody))
SELECT count(*) AS n, count(*) FILTER (k < {THRESHOLD} AND m >= {THRESHOLD}) AS "left", count(*) FILTER (k >= {THRESHOLD} AND m < {THRESHOLD}) AS entered, round(avg(m - k), 10) AS mean_bias, round(median(m - k), 10) AS median_bias, round(stddev_samp(m - k), 10) AS spread FROM b""",
    "error_quantiles": f"WITH v AS (SELECT abs({_DD}) AS v FROM refined WHERE {_DD} IS NOT NULL) SELECT count(*) AS n, round(max(v), 10) AS largest, round(quantile_cont(v, 0.5), 10) AS q5, round(quantile_cont(v, 0.9), 10) AS q9, round(quantile_cont(v, 0.99), 10) AS q99, round(quantile_cont(v, 0.999), 10) AS q999 FROM v",
    "velocity_quintiles": f"WITH {_ONCE}, f AS (SELECT ntile(5) OVER (ORDER BY rel_vel_km_s, encounter_id) AS fifth, rel_vel_km_s AS v, {_D} AS d FROM once WHERE {_V} IS NOT NULL) SELECT fifth::INTEGER AS fifth, count(*) AS n, min(v) AS slowest, max(v) AS fastest, round(avg(d), 8) AS mean_dist FROM f GROUP BY 1",
    "stage_subset": f"""WITH {_ONCE}, r AS (SELECT CASE WHEN rel_vel_km_s < 1 THEN 'slow' WHEN diameter_1_km > 100 AND NOT isnan(diameter_1_km) AND dist_au < 0.01 THEN 'big_close' WHEN class_2 = 'NEA' THEN 'nea' END AS reason, {_D} AS d FROM once)
SELECT reason, count(*) AS n, min(d) AS nearest, round(avg(CASE WHEN d IS NOT NULL THEN (d < 0.01)::INTEGER END), 8) AS close_share FROM r WHERE reason IS NOT NULL GROUP BY 1""",
    "heat_map": f"SELECT floor(a_1 / 0.25)::BIGINT AS a_band, floor(e_1 / 0.05::DOUBLE)::BIGINT AS e_band, count(*) AS n, round(quantile_cont(abs(delta_dist_au), 0.95), 10) AS p95 FROM refined WHERE {_DD} IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3",
    "strata": f"SELECT concat_ws('_', {_band_sql('a_1', [2.5, 2.82, 3.3])}, {_band_sql('e_1', [0.1, 0.2])}, {_band_sql('i_1', [5.0, 15.0])}, {_band_sql('dist_au_kepler', [0.01, 0.03])}, {_band_sql('rel_vel_kepler', [0.001, 0.003])}) AS stratum, count(*) AS n FROM refined GROUP BY 1 HAVING count(*) >= 5",
    "systematic_sample": f"WITH {_ONCE}, r AS (SELECT encounter_id, substr(date_utc, 1, 7) AS month FROM once) SELECT encounter_id, month FROM r QUALIFY (row_number() OVER (PARTITION BY month ORDER BY encounter_id) - 1) % 10 = 0",
    "null_candidates": f"""WITH {ELEMENTS_SQL}, c AS (SELECT number_1 AS number FROM encounters_catalog WHERE number_2 = 1 UNION SELECT number_2 FROM encounters_catalog WHERE number_1 = 1)
SELECT number FROM els WHERE abs(a_au - (SELECT a_au FROM els WHERE number = 4)) <= 0.15 AND h_mag BETWEEN 10 AND 16 AND number NOT IN (4, 1) AND number NOT IN (SELECT number FROM c WHERE number IS NOT NULL)""",
}
