"""Planted encounters, masses and pieces of work that have to come back whole, and streams against their batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpass.config import PipelineConfig
from nearpass.operators import fits, validation
from nearpass.operators.catalog import MAJOR_BODIES
from nearpass.operators.detect import DetectRules, detect_encounters, propagate
from nearpass.plans import detection
from nearpass.plans.catalogue import raw
from nearpass.plans.detection import END, SHORT, START, coarse_rules, current_elements
from nearpass.plans.pipeline import scan_blocks
from nearpass.session import checkpoint_root, stage, stage_folder, table, write_text
from nearpass.sources import elements as src
from nearpass.sources.sinks import markdown
from nearpass.streaming import live


def _planted(spark: SparkSession, sf: str) -> DataFrame:
    return stage(validation.planted_pairs(current_elements(spark, sf), "number", START, END, max_dist=0.04, max_vel_km_s=20.0), "planted")


def blind_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Partners planted beside all bodies, a widened scan with refinement over all of them, and whether 99 percent come back.

    Back: the distance within 1e-6 AU or a thousandth, or a still closer one.
    """
    pairs = _planted(spark, sf)
    orbit = lambda s, ident: pairs.select(ident.alias("number"), *[F.col(f"{c}_{s}").alias(c) for c in validation.ORBIT])
    bodies = stage(orbit("i", F.col("pair_id") * 2).unionByName(orbit("j", F.col("pair_id") * 2 + 1)), "bodies")
    found = detect_encounters(bodies, "number", START, END, DetectRules(threshold_au=0.05, coarse_days=0.5))
    own = found.where((F.col("idx_j") == F.col("idx_i") + 1) & (F.col("idx_i") % 2 == 0)).select((F.col("idx_i") / 2).cast("bigint").alias("pair_id"), "dist_au")
    both = pairs.join(own, "pair_id", "left")
    right = F.coalesce(F.col("dist_au") <= F.col("planted_au") + F.greatest(F.lit(1e-6), F.col("planted_au") / 1000.0), F.lit(False))
    return both.agg((F.avg(right.cast("double")) >= 0.99).alias("gate"))


def nbody_unperturbed(spark: SparkSession, sf: str) -> DataFrame:
    """Planted encounters refined by integration without planets: the two-body distance comes back."""
    pairs = _planted(spark, sf)
    when = pairs["planted_jd"]
    turned = F.pmod(F.col("mean_anomaly_deg_i") + F.degrees(F.lit(0.01720209895) / F.pow("a_au_i", 1.5)) * (when - F.col("epoch_jd_i")), F.lit(360.0))
    same = pairs.withColumns({"mean_anomaly_deg_i": turned, "epoch_jd_i": when}).withColumnsRenamed({"pair_id": "idx_i", "planted_jd": "jd_tdb"}).withColumn("idx_j", -F.col("idx_i"))
    found = fits.nbody_refine(same, ["idx_i", "idx_j"], planets=())
    both = found.join(same.select("idx_i", "planted_au"), "idx_i")
    return both.agg((F.avg((F.col("nbody_converged") & (F.col("dist_au_nbody") <= F.col("planted_au") + 2e-6)).cast("double")) >= 0.99).alias("gate"))


def nbody_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of the commonest epoch integrated over a month: without planets they stay on their two-body orbits, with all they leave them."""
    elements = stage(current_elements(spark, sf), "bodies")
    epoch = elements.groupBy("epoch_jd").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "epoch_jd").first().epoch_jd
    bodies, times = elements.where(F.col("epoch_jd") == epoch), [START + 5.0 * k for k in range(7)]
    places = [propagate(bodies, "number", START, START + 30.0, 5.0), fits.nbody_propagate(bodies, "number", times, ()), fits.nbody_propagate(bodies, "number", times)]
    kepler, free, full = (p.select("number", "step_idx", F.array("x", "y", "z").alias(n)) for p, n in zip(places, ("k", "f", "p"), strict=True))
    both = kepler.join(free, ["number", "step_idx"]).join(full, ["number", "step_idx"])
    gap = lambda a, b: F.max(F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda x, y: F.greatest(x, y)))
    return both.groupBy("number").agg((gap("k", "f") < 1e-6).alias("free"), (gap("k", "p") > 0).alias("moved"))


def mass_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Masses planted into the motion of two close targets each come back from the targets' directions."""
    masses = fits.planted_mass_fits(current_elements(spark, sf).where(F.col("number").isin(*MAJOR_BODIES)), "number", 1e-10)
    return masses.select("number", (F.abs(F.col("gm") / F.col("planted") - 1.0) < 0.02).alias("recovered"))


def encounter_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Detection in resumable blocks of three days, begun twice; the second run scans no block again."""
    bodies = stage(current_elements(spark, sf), "bodies")
    config, folder = PipelineConfig(SHORT, detect=coarse_rules(), block_days=3.0), stage_folder(spark, "blocks")
    scan_blocks(bodies, config, folder)
    found = scan_blocks(bodies, config, folder)
    return found.select("idx_i", "idx_j", F.col("t_coarse_jd").alias("t_jd"), F.col("d_coarse_au").alias("dist_au"))


def encounter_listed(spark: SparkSession, sf: str) -> DataFrame:
    """Detected pairs that are on a list of pairs, here those on like orbits."""
    listed = detection.encounter_prefiltered(spark, sf).select("idx_i", "idx_j")
    return detection.detect(spark, sf).join(listed, ["idx_i", "idx_j"], "left_semi")


def characterized_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue characterised as a stream of files: rows, the nearest and the sized ones."""
    rows = raw(spark, sf)
    stream = live.encounter_stream(spark, f"{sf}/encounters_catalog.parquet", rows.schema).select("number_1", "number_2", "designation_1", "designation_2", "jd_tdb", "dist_au", "rel_vel_au_day")
    out = stage_folder(spark, "streamed")
    live.characterize_stream(stream, current_elements(spark, sf), None, out, f"{checkpoint_root(spark)}/nearpass/stream-{uuid.uuid4().hex}").awaitTermination()
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("rows"), F.min(F.when(~F.isnan("dist_au"), F.col("dist_au"))).alias("nearest"), F.count("h_1").alias("sized"))


def sessions_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Gap sessions of each source's readings, by a stream that has ended."""
    name = f"sessions_{uuid.uuid4().hex}"
    rows = table(spark, sf, "sso_observation")
    stream = live.encounter_stream(spark, f"{sf}/sso_observation.parquet", rows.schema)
    timed = stream.where("epoch IS NOT NULL AND NOT isnan(epoch)").select("source_id", F.timestamp_micros((F.col("epoch") * 86_400_000_000.0).cast("bigint")).alias("ts"))
    sessions = live.session_stream(timed, "source_id", "ts", late="100000 hours")
    query = sessions.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{checkpoint_root(spark)}/nearpass/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).groupBy("source_id").agg(F.count(F.lit(1)).alias("sessions"))


def json_folder(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON file a nation, a broken one and one without the required keys; the whole ones come back."""
    folder = stage_folder(spark, "json")
    for r in table(spark, sf, "nation").toLocalIterator():  # a file per nation
        write_text(spark, f"{folder}/n{r.n_nationkey}.json", f'{{"key": {r.n_nationkey},\n "name": "{r.n_name}"}}')
    write_text(spark, f"{folder}/broken.json", '{"key": 1, "na')
    write_text(spark, f"{folder}/other.json", '{"name": "nowhere"}')
    return src.json_documents(spark, folder, ["key", "name"]).select("key", "name")


def report(spark: SparkSession, sf: str) -> DataFrame:
    """The regions as the lines of a report's table."""
    lines = markdown(table(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


QUERIES = {
    f.__name__: f
    for f in (blind_detection, nbody_unperturbed, nbody_grid, mass_fit, encounter_blocks, encounter_listed, characterized_streamed, sessions_streamed, json_folder, report)
}

SQL = {
    "blind_detection": "SELECT true AS gate",
    "nbody_unperturbed": "SELECT true AS gate",
    "nbody_grid": f"WITH {detection.ELEMENTS_SQL} SELECT number::BIGINT AS number, true AS free, true AS moved FROM els WHERE epoch_jd = (SELECT epoch_jd FROM els GROUP BY 1 ORDER BY count(*) DESC, epoch_jd LIMIT 1)",
    "mass_fit": f"WITH {detection.ELEMENTS_SQL} SELECT number, true AS recovered FROM els WHERE number IN (1, 2, 4, 10)",
    "encounter_blocks": detection.SQL["encounter_detect"],
    "encounter_listed": f"{detection.SQL['encounter_detect']} JOIN els a ON a.number = idx_i JOIN els b ON b.number = idx_j WHERE abs(a.a_au - b.a_au) <= 0.5 AND abs(a.i_deg - b.i_deg) <= 30".replace("SELECT * FROM best", "SELECT best.* FROM best"),
    "characterized_streamed": f"""WITH {detection.ELEMENTS_SQL}, c AS (SELECT number_1, number_2, CASE WHEN NOT isnan(dist_au) THEN dist_au END AS d FROM encounters_catalog),
h AS (SELECT number, CASE WHEN NOT isnan(h_mag) THEN h_mag END AS h FROM els)
SELECT count(*) AS rows, min(d) AS nearest, count(coalesce(a.h, b.h)) AS sized FROM c LEFT JOIN h a ON a.number = number_1 LEFT JOIN h b ON b.number = number_2""",
    "sessions_streamed": """WITH r AS (SELECT DISTINCT source_id, epoch FROM sso_observation WHERE epoch IS NOT NULL AND NOT isnan(epoch)),
s AS (SELECT source_id, CASE WHEN lag(epoch) OVER w IS NULL OR epoch - lag(epoch) OVER w > 0.01 THEN 1 ELSE 0 END AS opens FROM r WINDOW w AS (PARTITION BY source_id ORDER BY epoch)) SELECT source_id, sum(opens)::BIGINT AS sessions FROM s GROUP BY 1""",
    "json_folder": "SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation",
    "report": "SELECT 0 AS line, '| r_regionkey | r_name |' AS text UNION ALL SELECT 1, '|---|---|' UNION ALL SELECT 1 + row_number() OVER (ORDER BY r_regionkey), '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region",
}
