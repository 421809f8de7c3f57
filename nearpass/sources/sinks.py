"""Typed catalog writes with provenance, resumable work units, stage tables and reports."""

from __future__ import annotations

import hashlib
import json
import math
import os
import platform
from datetime import UTC, datetime

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpass.operators.catalog import catalog_stats
from nearpass.schema import CATALOG, conform
from nearpass.session import hadoop_path, write_text


def file_sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            digest.update(block)
    return digest.hexdigest()


def stage_key(**parts: object) -> str:
    """16 hex digits that change with any input of a stage (snapshot, grid, method, options)."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def provenance(df: DataFrame, config: dict | None = None, inputs: list[str] | None = None) -> dict:
    """Counts and versions that go beside a written catalog."""
    row = catalog_stats(df).first()
    return {
        "rows": row.encounters, "observable": row.observable, "nearest_au": row.nearest_au, "written_at": datetime.now(UTC).isoformat(timespec="seconds"),
        "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__},
        "inputs": {p: file_sha256(p) for p in inputs or [] if os.path.isfile(p)}, "config": config or {},
    }


def write_catalog(df: DataFrame, path: str, run_id: str, config: dict | None = None, inputs: list[str] | None = None, fmt: str = "parquet") -> dict:
    """Columns in schema order and type, one distributed write, and a JSON sidecar ``<path>.json``."""
    rows = conform(df.withColumn("run_id", F.lit(run_id)), CATALOG)
    if fmt == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    else:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    written = df.sparkSession.read.schema(rows.schema).option("header", True).format(fmt).load(path)
    side = provenance(written, config, inputs)
    write_text(df.sparkSession, f"{path}.json", json.dumps(side, indent=1, default=str))
    return side


def backfill_sidecar(spark: SparkSession, path: str) -> dict:
    """Sidecar of a catalog written without one."""
    side = provenance(spark.read.parquet(path))
    write_text(spark, f"{path}.json", json.dumps(side, indent=1, default=str))
    return side


def done_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``chunk_id`` of finished work units, empty ones included."""
    manifest = f"{path}/manifest"
    system, target = hadoop_path(spark, manifest)
    if not system.exists(target):
        return spark.createDataFrame([], "chunk_id bigint")
    return spark.read.schema("chunk_id bigint").parquet(manifest).distinct()


def write_chunks(chunks: DataFrame, results: DataFrame, path: str) -> None:
    """Append the results of work units not done yet, then enter them in the manifest.

    ``results`` carries ``chunk_id``. Rows go first and the manifest after, and readers take rows
    of entered chunks only, so a run that breaks off leaves nothing half-visible. A chunk without
    rows is entered as well and isn't tried again.
    """
    spark = chunks.sparkSession
    results.limit(0).coalesce(1).write.mode("ignore").parquet(f"{path}/schema")  # units without any row leave no other file
    todo = chunks.select("chunk_id").distinct().join(done_chunks(spark, path), "chunk_id", "left_anti")
    results.join(todo, "chunk_id", "left_semi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk_id").parquet(f"{path}/rows")
    todo.write.mode("append").parquet(f"{path}/manifest")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(schema).parquet(f"{path}/rows").join(done_chunks(spark, path), "chunk_id", "left_semi")


def markdown(df: DataFrame, limit: int = 50) -> str:
    """A report table of the first rows; missing values as a dash, large numbers in scientific form."""

    def show(x: object) -> str:
        if x is None or isinstance(x, float) and math.isnan(x):
            return "—"
        if isinstance(x, float):
            return f"{x:.3e}" if abs(x) >= 1e5 else f"{x:.6g}"
        return str(x)

    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])
