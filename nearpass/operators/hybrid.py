"""Merging a base catalog with refined solutions of some of its pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearpass.functions.physics import clean
from nearpass.operators.ranks import ranked

KEY = ["number_1", "number_2", "t_min_kepler_jd"]


def best_solution(refined: DataFrame) -> DataFrame:
    """One row per key: without error first, then converged, then the latest day and shard.

    NaN comes out as null in every column but the key. Chosen by an aggregate, so a key written any number of times never has to be sorted.
    """
    rank = F.struct(
        F.when(F.col("error_message").isNull(), 0).otherwise(1).alias("error"),
        F.when(F.col("nbody_converged"), 0).otherwise(1).alias("unconverged"),
        (-F.unix_date("refine_day")).alias("age"),
        (-F.col("shard_id")).alias("shard"),
    )
    rest = [(clean(F.col(c)) if kind == "double" else F.col(c)).alias(c) for c, kind in refined.dtypes if c not in KEY]
    return refined.groupBy(*KEY).agg(F.min_by(F.struct(*rest), rank).alias("_best")).select(*KEY, "_best.*")


def hybrid_merge(base: DataFrame, solutions: DataFrame) -> DataFrame:
    """Base rows with the refined distance and speed where a usable solution exists.

    Bodies are matched in either order together with the exact epoch; adds
    ``refinement_method`` and the correction.
    """
    usable = solutions.where(F.col("nbody_converged") & F.col("error_message").isNull() & clean(F.col("dist_au_nbody")).isNotNull())
    keyed = usable.select(*[F.col(c).alias(f"_{c}") for c in KEY], "dist_au_nbody", "rel_vel_nbody", "delta_dist_au")
    met = base.join(keyed, (base["number_1"] == keyed["_number_1"]) & (base["number_2"] == keyed["_number_2"]) & (base["t_min_kepler_jd"] == keyed["_t_min_kepler_jd"]), "left")
    return met.select(
        *[base[c] for c in base.columns if c not in ("dist_au", "rel_vel_au_day")],
        F.coalesce("dist_au_nbody", base["dist_au"]).alias("dist_au"),
        F.coalesce("rel_vel_nbody", base["rel_vel_au_day"]).alias("rel_vel_au_day"),
        F.when(F.col("dist_au_nbody").isNotNull(), "nbody").otherwise("kepler").alias("refinement_method"),
        "delta_dist_au",
    )


def shard_health(refined: DataFrame) -> DataFrame:
    return refined.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("nbody_converged").alias("converged"),
        F.count_if(F.col("error_message").isNotNull()).alias("errors"),
        F.count_if("near_boundary").alias("near_boundary"),
        F.max(F.abs(clean(F.col("nbody_energy_drift")))).alias("worst_drift"),
    )


def coverage(subset: DataFrame, solutions: DataFrame) -> DataFrame:
    """How many pairs of a subset have a solution: ``wanted, covered``."""
    met = subset.select(*KEY).distinct().join(solutions.select(*KEY, F.lit(1).alias("_there")), KEY, "left")
    return met.agg(F.count(F.lit(1)).alias("wanted"), F.count("_there").alias("covered"))


def require_complete(counts: DataFrame, allow_incomplete: bool = False) -> None:
    row = counts.first()
    if row.covered < row.wanted and not allow_incomplete:
        raise ValueError(f"only {row.covered} of {row.wanted} pairs have a solution")


def distance_bands(df: DataFrame, dist: str, value: str, width: float) -> DataFrame:
    """Mean, spread and count of ``value`` per distance band."""
    d, v = clean(F.col(dist)), clean(F.col(value))
    return df.where(d.isNotNull() & v.isNotNull()).groupBy((F.floor(d / width) * width).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("spread"))


def quintiles(df: DataFrame, by: str, tie: str) -> DataFrame:
    """``fifth`` as ``ntile(5)`` by value and ``tie``."""
    rows = ranked(df, by, [tie])
    r, q, m = F.col("rank"), F.floor(F.col("total") / 5), F.col("total") % 5
    fifth = F.when(r < (q + 1) * m, F.floor(r / (q + 1)) + 1).otherwise(m + F.floor((r - (q + 1) * m) / F.greatest(q, F.lit(1))) + 1)
    return rows.withColumn("fifth", fifth.cast("int")).drop("rank", "total")


def quantiles(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """One row ``n, largest`` and an interpolated quantile per name; null and NaN left out.

    Only the rows at the two ranks around each quantile leave their partition.
    """
    rows = ranked(df.select(clean(F.col(value)).alias("_v")).where("_v IS NOT NULL"), "_v")
    at = {name: p * (F.col("total") - 1) for name, p in probs.items()}
    wanted = [f(h) == F.col("rank") for h in at.values() for f in (F.floor, F.ceil)]
    last = F.col("rank") == F.col("total") - 1
    kept = rows.where(reduce(Column.__or__, wanted) | last)
    picked = kept.agg(
        F.max("total").alias("n"), F.max("_v").alias("largest"),
        *[F.max(F.when(F.col("rank") == f(h), F.col("_v"))).alias(f"_{name}_{s}") for name, h in at.items() for s, f in (("lo", F.floor), ("hi", F.ceil))],
    )
    share = {name: p * (F.col("n") - 1) - F.floor(p * (F.col("n") - 1)) for name, p in probs.items()}
    return picked.select(F.coalesce("n", F.lit(0)).alias("n"), "largest", *[(F.col(f"_{k}_lo") + (F.col(f"_{k}_hi") - F.col(f"_{k}_lo")) * share[k]).alias(k) for k in probs])


def error_quantiles(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles of |value|."""
    return quantiles(df.select(F.abs(F.col(value)).alias("v")), "v", probs)


def crossings(df: DataFrame, threshold: float) -> DataFrame:
    """Rows that a correction moves across the threshold, and the headline bias."""
    both = df.select(clean(F.col("dist_au_kepler")).alias("k"), clean(F.col("dist_au_nbody")).alias("m")).dropna()
    moved = both.withColumn("shift", F.col("m") - F.col("k"))
    counts = moved.agg(
        F.avg("shift").alias("mean_bias"), F.stddev_samp("shift").alias("spread"),
        F.count_if((F.col("k") < threshold) & (F.col("m") >= threshold)).alias("left"), F.count_if((F.col("k") >= threshold) & (F.col("m") < threshold)).alias("entered"),
    )
    middle = quantiles(moved, "shift", {"median_bias": 0.5})
    return counts.withColumns({c: middle.select(c).scalar() for c in ("n", "median_bias")})
