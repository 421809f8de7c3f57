"""Queries that write tables, files and sidecars into a stage folder and read them back, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpass.functions.physics import clean
from nearpass.operators import fits, validation
from nearpass.plans.catalogue import raw, refined
from nearpass.plans.detection import ELEMENTS_SQL, current_elements
from nearpass.schema import CATALOG
from nearpass.session import list_files, shuffle_partitions, stage, stage_folder, table, write_text
from nearpass.sources import elements as src
from nearpass.sources import observations as obs
from nearpass.sources import sinks

START, END = 2000.0, 2400.0


def _lines(spark: SparkSession, sf: str) -> str:
    """A fixed-width element file of the current bodies, with a heading and blank lines; its path."""
    folder = stage_folder(spark, "lines")
    bodies = current_elements(spark, sf).withColumn("packed_epoch", F.lit("K156Q"))
    lines = bodies.select(src.element_lines(bodies).alias("value"))
    spark.createDataFrame([("Des\u0027n     H     G   Epoch",), ("-" * 60,), ("",)], "value string").unionByName(lines).coalesce(1).write.text(folder)
    return list_files(spark, f"{folder}/part-*")[0]


def element_file(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of a written element file, headings and blank lines left out, with the file's first epoch."""
    path = _lines(spark, sf)
    rows = src.read_elements(spark, path)
    return rows.select("number", F.round("a_au", 7).alias("a_au"), F.lit(src.first_epoch(spark, path)).alias("first_epoch"))


def snapshot_files(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries found as files with a sidecar; a file with a broken one or none is no delivery."""
    folder = stage_folder(spark, "deliveries")
    found = table(spark, sf, "mpcorb_snapshot").groupBy("path").agg(F.min("snapshot_date").alias("d"), F.min(clean(F.col("epoch_jd"))).alias("e"))
    for k, r in enumerate(found.orderBy("path").toLocalIterator()):  # a row per delivery
        file = f"{folder}/mpcorb_archive/MPCORB_{k:04d}.DAT"
        write_text(spark, file, "")
        write_text(spark, f"{file}.json", json.dumps({"snapshot_date": r.d, "epoch_jd": r.e}))
    write_text(spark, f"{folder}/MPCORB.DAT", "")
    write_text(spark, f"{folder}/mpcorb_archive/MPCORB_x.DAT", "")
    write_text(spark, f"{folder}/mpcorb_archive/MPCORB_x.DAT.json", "{broken")
    return src.snapshot_registry(spark, folder).select("snapshot_date", "epoch_jd")


def orbit_table(spark: SparkSession, sf: str) -> DataFrame:
    """Orbit solutions in another schema (angles in radians, upper case names) as common elements."""
    bodies = current_elements(spark, sf)
    angles = {"Mean_Anomaly": "mean_anomaly_deg", "Arg_Perihelion": "argperi_deg", "Long_Asc_Node": "node_deg", "Inclination": "i_deg"}
    other = bodies.select(F.col("number").alias("Number_MP"), F.col("designation").alias("Denomination"), *[F.radians(c).alias(n) for n, c in angles.items()], F.col("ecc").alias("Eccentricity"), F.col("a_au").alias("Semi_Major_Axis"))
    return src.orbit_solutions(other, 2000.0).select("number", "designation", *[F.round(c, 9).alias(c) for c in angles.values()], "ecc", "a_au", "epoch_jd")


def observation_window(spark: SparkSession, sf: str) -> DataFrame:
    """Observations of the bodies of the catalogue in a window, without rejected ones."""
    rows = obs.load_observations(spark, f"{sf}/sso_observation.parquet", ("number_mp", "epoch", "ra", "dec"))
    bodies = raw(spark, sf).select(F.col("number_1").alias("number")).where("number IS NOT NULL")
    flagged = rows.withColumn("rejected", F.when(F.col("observation_id") % 10 == 0, "True").when(F.col("observation_id") % 10 == 1, None).otherwise("False"))
    return obs.window_of(flagged, bodies, START, END, "rejected").select("observation_id", "number_mp").distinct()


def largest_key(spark: SparkSession, sf: str) -> DataFrame:
    """The largest source id, or 0 for none, and how many gap-free ranges of a million cover up to it."""
    top = obs.max_key(table(spark, sf, "sso_observation"), "number_mp", 0)
    return top.select("max_key", F.lit(len(obs.key_ranges(0, top.first().max_key, 7))).alias("ranges"))


def interval_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps between the ranges of event numbers that chunks cover."""
    chunks = table(spark, sf, "goffin_2014_encounters").groupBy(F.floor(F.col("recno") / 25).alias("k")).agg(F.min("recno").alias("low"), (F.min("recno") + F.col("k") % 30).alias("high"))
    return src.interval_gaps(chunks.select("low", "high"), "low", "high")


def published_union(spark: SparkSession, sf: str) -> DataFrame:
    """Published tables of unlike columns under each other, with the table's name."""
    rows = table(spark, sf, "goffin_2014_encounters")
    parts = {"numbers": rows.select("recno", "pert", "targ"), "distances": rows.select("recno", "dist")}
    return obs.union_tables(parts).select("source_table", "recno", "pert", "targ", "dist")


def html_list(spark: SparkSession, sf: str) -> DataFrame:
    """Published events printed as HTML tables of a hundred rows, with two heading rows, and read back."""
    events = table(spark, sf, "goffin_2014_encounters").select("recno", "pert", "targ", F.floor(F.col("recno") / 100).alias("page"))
    cell = lambda c: F.concat(F.lit("<td>&nbsp;"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(" </td>"))
    rows = events.groupBy("page").agg(F.concat_ws("\n", F.collect_list(F.concat(F.lit("<tr>"), cell("recno"), cell("pert"), cell("targ"), F.lit("</tr>")))).alias("body"))
    pages = rows.select("page", F.concat(F.lit("<html><p>Table</p><table><tr><th>No</th><th colspan=2>Bodies</th></tr><tr><th></th><th>P</th><th>T</th></tr>"), "body", F.lit("</table></html>")).alias("text"))
    cells = F.col("cells")
    return obs.html_tables(pages, "page", "text").select(cells[0].try_cast("bigint").alias("recno"), cells[1].try_cast("int").alias("pert"), cells[2].try_cast("int").alias("targ"))


def mass_table(spark: SparkSession, sf: str) -> DataFrame:
    """Masses printed in 1e-10 Suns, the first entry of each body in order of its record."""
    rows = table(spark, sf, "goffin_2014_encounters").select("pert", "recno", F.format_string("%.3f", F.col("recno") % 1000 / 7.0).alias("printed"))
    return obs.masses(rows, "pert", "printed", "recno").select("pert", F.round(F.log10("mass_kg"), 9).alias("log_mass"))


def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Parquet pieces of unlike columns in one folder, read as one table."""
    folder = stage_folder(spark, "pieces")
    rows = raw(spark, sf).select("encounter_id", "number_1", "number_2", "dist_au")
    rows.where("number_1 % 2 = 0").drop("dist_au").write.parquet(f"{folder}/a")
    rows.where("number_1 % 2 = 1").drop("number_2").write.parquet(f"{folder}/b")
    both = spark.read.option("mergeSchema", True).parquet(f"{folder}/a", f"{folder}/b")
    return both.groupBy("number_1").agg(F.count(F.lit(1)).alias("n"), F.count("number_2").alias("partners"), F.min(clean(F.col("dist_au"))).alias("nearest"))


def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    """Close encounters written as CSV and read back with the catalogue's types."""
    path = stage_folder(spark, "csv")
    close = raw(spark, sf).where(clean(F.col("dist_au")) < 0.01).select("number_1", "number_2", "jd_tdb", "dist_au", "date_utc", "gaia_observable").distinct()
    sinks.write_catalog(close, path, "export", fmt="csv")
    columns = [f for f in CATALOG.fields if f.name in ("run_id", *close.columns)]
    back = spark.read.option("header", True).schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns)).csv(path)
    return back.select("run_id", "number_1", "number_2", "jd_tdb", "dist_au", "date_utc")


def catalog_sidecar(spark: SparkSession, sf: str) -> DataFrame:
    """A catalogue written with its sidecar; both sidecars, written with it and afterwards, say the same."""
    path = stage_folder(spark, "catalog")
    first = sinks.write_catalog(raw(spark, sf).drop("run_id"), path, "run-1", {"threshold": 0.05})
    again = sinks.backfill_sidecar(spark, path)
    kept = json.loads(spark.read.text(f"{path}.json", wholetext=True).first().value)
    same = all(first[k] == again[k] == kept[k] for k in ("rows", "observable", "nearest_au"))
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.count_if("gaia_observable").alias("observable"), F.lit(same).alias("same"))


def resumable_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Shards written in two goes, the second repeating some; every shard once, an empty one counted as done."""
    path = stage_folder(spark, "chunks")
    rows = refined(spark, sf).select(F.col("shard_id").cast("bigint").alias("chunk_id"), "number_1", "number_2").where("chunk_id IS NOT NULL")
    ids = rows.select("chunk_id").distinct()
    extra = spark.createDataFrame([(1_000_000,)], "chunk_id bigint")
    sinks.write_chunks(ids.where("chunk_id % 2 = 0").unionByName(extra), rows, path)
    sinks.write_chunks(ids.unionByName(extra), rows, path)
    counted = sinks.read_chunks(spark, path).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    return sinks.done_chunks(spark, path).join(counted, "chunk_id", "left").select("chunk_id", F.coalesce("n", F.lit(0)).alias("n"))


def orbit_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Orbits fitted to twelve noise-free directions of every body, from elements a little off: they come back."""
    true = stage(current_elements(spark, sf), "bodies")  # read by the directions, the seeds and the comparison
    bodies = true.where("a_au < 6")
    watched = stage(fits.observed(bodies.repartition(shuffle_partitions(spark), "number"), "number", [2457200.5 + 31.0 * k for k in range(12)]), "watched")
    nudged = bodies.select("number", (F.col("a_au") + 1e-5).alias("a_au"), (F.col("ecc") + 1e-6).alias("ecc"), (F.col("i_deg") + 1e-4).alias("i_deg"), "node_deg", "argperi_deg", (F.col("mean_anomaly_deg") + 1e-4).alias("mean_anomaly_deg"), "epoch_jd")
    found = fits.orbit_fits(watched, nudged, "number")
    true = true.select(F.col("number").alias("_n"), *[F.col(c).alias(f"_{c}") for c in ("a_au", "ecc", "i_deg")])
    near = (F.abs(F.col("a_au") - F.col("_a_au")) < 1e-6) & (F.abs(F.col("ecc") - F.col("_ecc")) < 1e-6) & (F.abs(F.col("i_deg") - F.col("_i_deg")) < 1e-5)
    return found.join(true, found["number"] == true["_n"]).select(F.col("number").cast("bigint").alias("number"), F.coalesce(near, F.lit(False)).alias("recovered"), "kept")


def mc_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Spread of the distance of planted encounters under equal element errors."""
    pairs = validation.planted_pairs(current_elements(spark, sf), "number", 2457200.5, 2457300.5)
    wide = pairs.withColumnsRenamed({"pair_id": "idx_i", "planted_jd": "jd_tdb"}).withColumn("idx_j", -F.col("idx_i"))
    sigmas = {f"sigma_{c}_{s}": F.lit(v) for s in "ij" for c, v in zip(fits.ORBIT, (1e-8, 1e-8, 1e-6, 1e-6, 1e-6, 1e-6), strict=True)}
    return fits.monte_carlo_distance(wide.withColumns(sigmas), draws=200)


def state_transition(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the derivatives of each body's motion over forty days keep volume, as those of any such motion must."""
    return fits.transition_volume(current_elements(spark, sf), "number", 40.0).select(F.col("number").cast("bigint").alias("number"), (F.abs(F.col("volume") - 1.0) < 1e-6).alias("kept"))


QUERIES = {
    f.__name__: f
    for f in (
        element_file, snapshot_files, orbit_table, observation_window, largest_key, interval_cover, published_union, html_list, mass_table, union_by_name, csv_export,
        catalog_sidecar, resumable_chunks, orbit_fit, mc_distance, state_transition,
    )
}

_ELS = f"WITH {ELEMENTS_SQL}"
SQL = {
    "element_file": f"{_ELS} SELECT number, round(a_au, 7) AS a_au, 2457199.5::DOUBLE AS first_epoch FROM els",
    "snapshot_files": "SELECT min(snapshot_date) AS snapshot_date, min(epoch_jd) AS epoch_jd FROM mpcorb_snapshot WHERE epoch_jd IS NOT NULL AND NOT isnan(epoch_jd) GROUP BY path",
    "orbit_table": f"{_ELS} SELECT number, designation, round(mean_anomaly_deg, 9) AS mean_anomaly_deg, round(argperi_deg, 9) AS argperi_deg, round(node_deg, 9) AS node_deg, round(i_deg, 9) AS i_deg, ecc, a_au, 2457197.5::DOUBLE AS epoch_jd FROM els",
    "observation_window": f"SELECT DISTINCT observation_id, number_mp FROM sso_observation WHERE epoch BETWEEN {START} AND {END} AND observation_id % 10 <> 0 AND number_mp IN (SELECT number_1 FROM encounters_catalog WHERE number_1 IS NOT NULL)",
    "largest_key": "WITH m AS (SELECT coalesce(max(number_mp), 0)::BIGINT AS k FROM sso_observation) SELECT k::INTEGER AS max_key, ceil((k + 1) / ceil((k + 1) / 7.0))::INTEGER AS ranges FROM m",
    "interval_cover": """WITH c AS (SELECT min(recno) AS low, min(recno) + floor(recno / 25)::BIGINT % 30 AS high FROM goffin_2014_encounters GROUP BY floor(recno / 25)::BIGINT),
r AS (SELECT low, max(high) OVER (ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c) SELECT reach + 1 AS from_key, low - 1 AS to_key FROM r WHERE low > reach + 1""",
    "published_union": "SELECT 'numbers' AS source_table, recno, pert, targ, NULL::DOUBLE AS dist FROM goffin_2014_encounters UNION ALL SELECT 'distances', recno, NULL, NULL, dist FROM goffin_2014_encounters",
    "html_list": "SELECT recno, pert, targ FROM goffin_2014_encounters",
    "mass_table": "SELECT pert, round(log10(printf('%.3f', recno % 1000 / 7.0)::DOUBLE * 1e-10 * 1.98847e30), 9) AS log_mass FROM goffin_2014_encounters WHERE pert IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pert ORDER BY recno) = 1",
    "union_by_name": """SELECT number_1, count(*) AS n, count(CASE WHEN number_1 % 2 = 0 THEN number_2 END) AS partners, min(CASE WHEN number_1 % 2 = 1 AND NOT isnan(dist_au) THEN dist_au END) AS nearest
FROM encounters_catalog WHERE number_1 IS NOT NULL GROUP BY 1""",
    "csv_export": "SELECT 'export' AS run_id, number_1, number_2, jd_tdb, dist_au, date_utc FROM (SELECT DISTINCT number_1, number_2, jd_tdb, dist_au, date_utc, gaia_observable FROM encounters_catalog) WHERE dist_au < 0.01 AND NOT isnan(dist_au)",
    "catalog_sidecar": "SELECT count(*) AS rows, count(*) FILTER (gaia_observable) AS observable, true AS same FROM encounters_catalog",
    "resumable_chunks": "SELECT shard_id::BIGINT AS chunk_id, count(*) AS n FROM refined WHERE shard_id IS NOT NULL GROUP BY 1 UNION ALL SELECT 1000000, 0",
    "state_transition": f"{_ELS} SELECT number::BIGINT AS number, true AS kept FROM els",
    "orbit_fit": f"{_ELS} SELECT number::BIGINT AS number, true AS recovered, 12 AS kept FROM els WHERE a_au < 6",
}
