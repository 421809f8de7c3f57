"""End-to-end detection in resumable time blocks, and the catalog it writes."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpass.config import PipelineConfig
from nearpass.operators.catalog import major_body_gate
from nearpass.operators.characterize import characterize
from nearpass.operators.detect import named_encounters, refine, scan, usable_elements
from nearpass.operators.spatial import min_per_pair
from nearpass.session import scratch
from nearpass.sources.sinks import done_chunks, read_chunks, stage_key, write_catalog, write_chunks


def time_blocks(start: float, end: float, step: float, block_days: float) -> list[tuple[int, float, float]]:
    """``(chunk_id, from, to)``: whole steps, every step of the grid in exactly one block."""
    per = max(1, round(block_days / step))
    total = int((end - start) / step + 0.5) + 1
    return [(k, start + k * step, start + (min(k + per, total) - 1) * step) for k in range(0, total, per)]


def scan_blocks(elements: DataFrame, config: PipelineConfig, path: str) -> DataFrame:
    """Candidates of all blocks; blocks entered in the manifest under ``path`` aren't scanned again.

    The manifest belongs to one window, population and set of rules: any other has its own folder.
    A block is one distributed job and a unit of restart. Its minima are partial, so the final minimum per pair
    reads a row per pair and block, however many steps there are.
    """
    spark, rules = elements.sparkSession, config.detect
    path = f"{path}/{stage_key(window=asdict(config.window), population=asdict(config.population), detect=asdict(rules), block=config.block_days)}"
    done = {r.chunk_id for r in done_chunks(spark, path).collect()}
    for chunk, begin, end in time_blocks(config.window.start_jd, config.window.end_jd, rules.coarse_days, config.block_days):
        if chunk not in done:
            with scratch(spark):  # a block's trajectories go before the next are made
                write_chunks(spark.createDataFrame([(chunk,)], "chunk_id bigint"), scan(elements, "number", begin, end, rules).withColumn("chunk_id", F.lit(chunk).cast("bigint")), path)
    return min_per_pair(read_chunks(spark, path), ["idx_i", "idx_j"], "d_coarse_au", "t_coarse_jd")


def run(elements: DataFrame, config: PipelineConfig, work: str, out: str, physical: DataFrame | None = None) -> dict:
    """Scan, refine, characterise and write; returns the sidecar with the gate of required bodies."""
    config.detect.check()
    bodies = usable_elements(elements, config.population.a_min, config.population.a_max, config.population.only_numbered)
    candidates = scan_blocks(bodies, config, f"{work}/candidates")
    if config.detect.refine:
        found = refine(candidates, bodies, "number", config.detect)
    else:
        found = candidates.select("idx_i", "idx_j", F.col("t_coarse_jd").alias("jd_tdb"), F.col("d_coarse_au").alias("dist_au"), F.lit(None).cast("double").alias("rel_vel_au_day"))
        found = found if config.detect.keep_wide else found.where(F.col("dist_au") <= config.detect.threshold_au)
    catalog = characterize(named_encounters(found, bodies), bodies, physical)
    side = write_catalog(catalog, out, config.run_id, asdict(config), fmt=config.output_format)
    rows = elements.sparkSession.read.format(config.output_format).option("header", True).schema(catalog.schema).load(out)
    return side | {"gate": [r.asDict() for r in major_body_gate(rows).collect()]}
