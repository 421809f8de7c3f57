"""Questions to the encounter catalog: filters, top-k, counts, histograms, gates, rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearpass.functions.physics import clean

#: Bodies whose encounters every complete catalog holds, and bodies of known mass.
MAJOR_BODIES = (1, 2, 4, 10)
KNOWN_MASS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 15, 16, 52, 65, 87, 88, 107, 121, 128)


def either_side(*numbers: int) -> Column:
    """Membership in either position, as a disjunction the Parquet reader can use."""
    return F.col("number_1").isin(*numbers) | F.col("number_2").isin(*numbers)


def filter_encounters(
    df: DataFrame, min_dist: float | None = None, max_dist: float | None = None, date_from: str | None = None, date_to: str | None = None,
    body_ids: list[int] | None = None, observable: bool | None = None, classes: list[str] | None = None,
) -> DataFrame:
    """All given conditions, bounds inclusive; without any, all rows."""
    tests: list[Column] = []
    if min_dist is not None:
        tests.append(F.col("dist_au") >= min_dist)
    if max_dist is not None:
        tests.append(F.col("dist_au") <= max_dist)
    if date_from is not None:
        tests.append(F.col("date_utc") >= date_from)
    if date_to is not None:
        tests.append(F.col("date_utc") <= date_to)
    if body_ids:
        tests.append(either_side(*body_ids))
    if observable is not None:
        tests.append(as_bool(df, "gaia_observable") == F.lit(observable))
    if classes:
        tests.append(F.col("class_1").isin(*classes) | F.col("class_2").isin(*classes))
    return df.where(reduce(Column.__and__, tests)) if tests else df


def as_bool(df: DataFrame, column: str) -> Column:
    """A flag that may have been read as text."""
    return F.lower(F.trim(column)) == "true" if dict(df.dtypes)[column] == "string" else F.col(column)


def top_encounters(df: DataFrame, n: int = 10, by: str = "dist_au", ascending: bool = True, tie: str = "encounter_id") -> DataFrame:
    """The first n rows; null and NaN last either way, ties by ``tie``."""
    key = clean(F.col(by))
    return df.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_last(), tie).limit(n)


def sides(df: DataFrame, *columns: str) -> DataFrame:
    """Each encounter from either body's side: ``number, partner`` and the given columns."""
    one = F.struct(F.col("number_1").alias("number"), F.col("number_2").alias("partner"), F.lit(1).alias("side"))
    two = F.struct(F.col("number_2").alias("number"), F.col("number_1").alias("partner"), F.lit(2).alias("side"))
    return df.select(F.explode(F.array(one, two)).alias("_s"), *columns).select("_s.*", *columns)


def catalog_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("encounters"), F.count_if(as_bool(df, "gaia_observable")).alias("observable"), F.min(clean(F.col("dist_au"))).alias("nearest_au"))


def class_breakdown(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.array("class_1", "class_2")).alias("orbit_class")).groupBy("orbit_class").agg(F.count(F.lit(1)).alias("n"))


def monthly_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.substring("date_utc", 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("n"))


def distance_cdf(df: DataFrame, bounds: tuple[float, ...]) -> DataFrame:
    """``bound_au, n``: rows nearer than each bound, in one pass."""
    counted = df.agg(*[F.count_if(clean(F.col("dist_au")) < b).alias(f"_{k}") for k, b in enumerate(bounds)])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(b).alias("bound_au"), F.col(f"_{k}").alias("n")) for k, b in enumerate(bounds)])).alias("r")).select("r.*")


def equal_width_histogram(df: DataFrame, column: str, low: float, high: float, bins: int, clip: bool = False) -> DataFrame:
    """``bin, n`` of equal widths, empty bins included.

    Values outside are dropped, or put into the end bins with ``clip``; ``high`` itself
    belongs to the last bin.
    """
    x = clean(F.col(column))
    at = F.floor((x - low) / ((high - low) / bins))
    inside = df.where(x.isNotNull()) if clip else df.where((x >= low) & (x <= high))
    counted = inside.groupBy(F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(F.broadcast(counted), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))  # at most one row per bin


def major_body_gate(df: DataFrame, required: tuple[int, ...] = MAJOR_BODIES) -> DataFrame:
    """``number, n, nearest_au, missing`` of the required bodies; those without rows too."""
    spark = df.sparkSession
    want = spark.createDataFrame([(n,) for n in required], "number int")
    found = sides(df.where(either_side(*required)), "dist_au").where(F.col("number").isin(*required)).groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.min(clean(F.col("dist_au"))).alias("nearest_au"))
    return want.join(F.broadcast(found), "number", "left").select("number", F.coalesce("n", F.lit(0)).alias("n"), "nearest_au", F.col("n").isNull().alias("missing"))


def perturber_ranking(df: DataFrame) -> DataFrame:
    """``number, encounters, targets, nearest_au`` from both perspectives."""
    both = sides(df, "dist_au").where(F.col("number").isNotNull())
    return both.groupBy("number").agg(F.count(F.lit(1)).alias("encounters"), F.count_distinct("partner").alias("targets"), F.min(clean(F.col("dist_au"))).alias("nearest_au"))


def nearest_targets(df: DataFrame, n: int, max_dist: float, tie: str = "encounter_id") -> DataFrame:
    """Each perturber's n nearest distinct targets; a pair met several times counts at its nearest."""
    d = clean(F.col("dist_au"))
    near = sides(df.where(d <= max_dist), "dist_au", tie).where(F.col("number").isNotNull() & F.col("partner").isNotNull())
    pairs = near.groupBy("number", "partner").agg(F.min(F.struct("dist_au", tie)).alias("m")).select("number", "partner", "m.*")
    rank = F.row_number().over(W.partitionBy("number").orderBy("dist_au", tie, "partner"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= n)


def mass_candidates(df: DataFrame, max_dist: float, min_diameter: float, max_vel_km_s: float) -> DataFrame:
    """Observable slow close encounters of a large body, with deflection score and mass flag; strict bounds."""
    rows = df.where((clean(F.col("dist_au")) < max_dist) & (clean(F.col("diameter_1_km")) > min_diameter) & (clean(F.col("rel_vel_km_s")) < max_vel_km_s) & as_bool(df, "gaia_observable"))
    score = F.pow("diameter_1_km", 3) / (F.col("dist_au") * F.col("rel_vel_km_s") * F.col("rel_vel_km_s"))
    return rows.withColumn("score", score).withColumn("mass_unknown", ~F.col("number_1").isin(*KNOWN_MASS))


def secondary_perturbers(df: DataFrame, primary: int, targets: DataFrame, max_dist: float, start_jd: float, end_jd: float) -> DataFrame:
    """Other bodies that met any of the ``number`` targets in a window, with a known-mass tag."""
    rows = df.where((clean(F.col("dist_au")) <= max_dist) & F.col("jd_tdb").between(start_jd, end_jd))
    met = sides(rows, "encounter_id", "jd_tdb", "dist_au").where(F.col("partner").isNotNull() & (F.col("partner") != primary))
    return met.join(targets.select("number").distinct(), "number", "left_semi").withColumn("massive", F.col("partner").isin(*KNOWN_MASS))


def family_pairs(df: DataFrame, elements: DataFrame, max_da: float, max_de: float, max_di: float) -> DataFrame:
    """Encounters of two bodies on like orbits (relative a, e, i)."""
    orbit = elements.select("number", "a_au", "ecc", "i_deg")
    one = orbit.toDF("number_1", "a_1", "e_1", "i_1")
    two = orbit.toDF("number_2", "a_2", "e_2", "i_2")
    both = df.join(one, "number_1").join(two, "number_2")
    like = (F.abs(F.col("a_1") - F.col("a_2")) / ((F.col("a_1") + F.col("a_2")) / 2.0) <= max_da) & (F.abs(F.col("e_1") - F.col("e_2")) <= max_de) & (F.abs(F.col("i_1") - F.col("i_2")) <= max_di)
    return both.where(like)
