"""Readers of element files, published pair lists and service payloads."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpass.functions.timescale import JD_UNIX_EPOCH
from nearpass.schema import ELEMENTS, conform, empty
from nearpass.session import list_files

#: Character spans (from 0, end excluded) of the element line format.
SPANS = {
    "number": (0, 7), "h_mag": (8, 13), "g_slope": (14, 19), "epoch": (20, 25), "mean_anomaly_deg": (26, 35), "argperi_deg": (36, 46),
    "node_deg": (47, 57), "i_deg": (58, 68), "ecc": (69, 79), "a_au": (92, 103), "designation": (166, 194),
}
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def span(line: Column, name: str) -> Column:
    low, high = SPANS[name]
    return F.trim(F.substring(line, low + 1, high - low))


def unpack_number(text: Column) -> Column:
    """Plain digits, or a letter for ten thousands and four digits; else null."""
    letter = F.substring(text, 1, 1)
    value = F.element_at(F.create_map(*[x for k, ch in enumerate(ALPHABET[10:], 10) for x in (F.lit(ch), F.lit(k))]), letter)
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int")).when(text.rlike(r"^[A-Za-z]\d{4}$"), value * 10000 + F.substring(text, 2, 4).try_cast("int"))


def unpack_epoch(text: Column) -> Column:
    """Julian date of a packed date such as ``K205A`` (2020-05-10); null if it isn't one."""
    code = lambda k: F.element_at(F.create_map(*[x for n, ch in enumerate(ALPHABET[:36]) for x in (F.lit(ch), F.lit(n))]), F.substring(text, k, 1))
    year = (code(1)) * 100 + F.substring(text, 2, 2).try_cast("int")
    iso = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(code(4).cast("string"), 2, "0"), F.lpad(code(5).cast("string"), 2, "0"))
    day = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))
    return F.when(text.rlike(r"^[IJK]\d{2}[1-9ABC][1-9A-V]$"), F.unix_date(day.cast("date")) + JD_UNIX_EPOCH)


def element_columns(lines: DataFrame, line: str = "value") -> DataFrame:
    """Element rows of lines that have a semi-major axis; other columns of ``lines`` are kept."""
    text = F.col(line)
    number = lambda n: span(text, n).try_cast("double")
    rows = lines.where((F.length(text) >= 103) & number("a_au").isNotNull())
    name = F.when(F.length(text) >= 194, span(text, "designation")).otherwise(span(text, "number"))
    return rows.select(
        *[c for c in lines.columns if c != line], unpack_number(span(text, "number")).alias("number"), name.alias("designation"), number("h_mag").alias("h_mag"), number("g_slope").alias("g_slope"),
        unpack_epoch(span(text, "epoch")).alias("epoch_jd"), *[number(c).alias(c) for c in ("mean_anomaly_deg", "argperi_deg", "node_deg", "i_deg", "ecc", "a_au")],
    )


def read_elements(spark: SparkSession, path: str, only_numbered: bool = True, a_min: float = 0.0, a_max: float = float("inf")) -> DataFrame:
    """A fixed-width element file; a missing path is an error, an empty file an empty frame."""
    rows = element_columns(spark.read.text(path)).where(F.col("a_au").between(a_min, a_max))
    return conform(rows.where("number IS NOT NULL") if only_numbered else rows, ELEMENTS)


def first_epoch(spark: SparkSession, path: str) -> float:
    row = element_columns(spark.read.text(path)).where("epoch_jd IS NOT NULL").select("epoch_jd").limit(1).first()
    if row is None:
        raise ValueError(f"no element line in {path}")
    return row.epoch_jd


def element_lines(elements: DataFrame) -> Column:
    """The fixed-width line of an element row (inverse of ``element_columns`` up to printed digits)."""
    number = lambda c, w, d: F.lpad(F.when(F.col(c).isNull(), F.lit("")).otherwise(F.format_string(f"%.{d}f", c)), w, " ")
    gap = lambda n: F.lit(" " * n)
    return F.concat(
        F.rpad(F.col("number").cast("string"), 7, " "), gap(1), number("h_mag", 5, 2), gap(1), number("g_slope", 5, 2), gap(1), F.rpad(F.col("packed_epoch"), 5, " "), gap(1),
        number("mean_anomaly_deg", 9, 5), gap(1), number("argperi_deg", 10, 5), gap(1), number("node_deg", 10, 5), gap(1), number("i_deg", 10, 5), gap(1), number("ecc", 10, 7), gap(13), number("a_au", 11, 7), gap(63), F.rpad(F.col("designation"), 28, " "),
    )


def orbit_solutions(raw: DataFrame, osc_epoch_days: float) -> DataFrame:
    """Orbit-solution rows with angles in radians to the common element schema, in degrees."""
    lower = raw.toDF(*[c.lower() for c in raw.columns])
    angles = {"mean_anomaly": "mean_anomaly_deg", "arg_perihelion": "argperi_deg", "long_asc_node": "node_deg", "inclination": "i_deg"}
    out = lower.select(F.col("number_mp").cast("int").alias("number"), F.col("denomination").alias("designation"), *[F.degrees(a).alias(b) for a, b in angles.items() if a in lower.columns], F.col("eccentricity").alias("ecc"), F.col("semi_major_axis").alias("a_au"))
    return conform(out.withColumn("epoch_jd", F.lit(osc_epoch_days + 2455197.5)), ELEMENTS)


def snapshot_registry(spark: SparkSession, folder: str) -> DataFrame:
    """``path, snapshot_date, epoch_jd`` of element files with a readable sidecar, by epoch."""
    found = []
    for path in [*list_files(spark, f"{folder}/MPCORB.DAT"), *list_files(spark, f"{folder}/mpcorb_archive/MPCORB_*.DAT")]:
        side = list_files(spark, f"{path}.json")
        try:
            meta = json.loads(spark.read.text(side[0], wholetext=True).first().value)
            found.append((path, str(meta.get("snapshot_date")), float(meta["epoch_jd"])))
        except (IndexError, AttributeError, ValueError, KeyError, TypeError):
            continue  # without a usable sidecar a file is no snapshot
    return spark.createDataFrame(found, "path string, snapshot_date string, epoch_jd double").orderBy("epoch_jd")


def json_documents(spark: SparkSession, folder: str, required: list[str]) -> DataFrame:
    """One row per well-formed JSON file holding all required keys; an empty frame if none does."""
    if not list_files(spark, folder):
        raise FileNotFoundError(folder)
    rows = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{folder}/*.json")
    if any(c not in rows.columns for c in required):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in required))
    return rows.dropna(subset=required)


def column_payload(payloads: DataFrame, column: str, key: str) -> DataFrame:
    """Rows of a ``{"fields": [...], "data": [[...]]}`` payload as ``row map<string,string>`` and its key."""
    parsed = payloads.select(F.from_json(column, "fields array<string>, data array<array<string>>").alias("p"))
    rows = parsed.select(F.explode(F.transform("p.data", lambda r: F.map_from_arrays(F.col("p.fields"), r))).alias("row"))
    return rows.withColumn(key, F.element_at("row", F.lit(key))).where(F.col(key).isNotNull())


def pipe_pairs(lines: DataFrame, name: str, targets: str) -> DataFrame:
    """``name, target`` of a pipe-delimited target list; provisional perturbers are dropped.

    A list that ends in ``...`` was cut off when printed: ``truncated`` says so.
    """
    bare = F.trim(F.col(targets))
    cut = bare.endswith("...")
    items = F.filter(F.transform(F.split(F.regexp_replace(bare, r"\.\.\.$", ""), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return lines.where(F.trim(name).rlike(r"^\d+\b") & ~F.trim(name).rlike(r"^\d{4} [A-Z]{2}\d*$")).select(F.regexp_extract(F.trim(name), r"^(\d+)", 1).cast("int").alias("perturber"), F.explode(items).alias("target"), cut.alias("truncated"))


def interval_gaps(chunks: DataFrame, low: str, high: str) -> DataFrame:
    """Uncovered key ranges between chunks ``[low, high]`` (one row per chunk, a small table)."""
    from pyspark.sql import Window as W

    reach = F.max(high).over(W.orderBy(low, high).rowsBetween(W.unboundedPreceding, -1))
    return chunks.withColumn("_reach", reach).where(F.col(low) > F.col("_reach") + 1).select((F.col("_reach") + 1).alias("from_key"), (F.col(low) - 1).alias("to_key"))


def empty_elements(spark: SparkSession) -> DataFrame:
    return empty(spark, ELEMENTS)
