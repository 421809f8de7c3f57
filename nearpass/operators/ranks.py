"""Ranks and quantiles of whole tables and of groups of any size, without a window over either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearpass.session import stage


def ranked(df: DataFrame, by: str, tie: list[str] | None = None, within: list[str] | None = None) -> DataFrame:
    """Adds ``rank`` (from 0) and, for the whole table, ``total`` by value, in each group of ``within``.

    Rows are range-partitioned by group and value; a row's rank is its place in its partition plus the
    rows of its group in the partitions before. Only a group that a partition's edge cuts has such, so
    there are fewer of these sums than partitions. The split is staged, so places and sums belong to
    the same partitions whatever is computed again. A group that holds most rows spreads over many tasks.
    """
    tie, within = tie or [], within or []
    cut = stage(df.repartitionByRange(*within, by, *tie).withColumn("_pid", F.spark_partition_id()), "ranked")
    sizes = cut.groupBy("_pid", *within).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.col("_pid").alias("_bid"), *[F.col(c).alias(f"_in_{c}") for c in within], (F.sum("_n").over(W.partitionBy(*within).orderBy("_pid")) - F.col("_n")).alias("_before")).where("_before > 0")
    place = F.row_number().over(W.partitionBy("_pid", *within).orderBy(by, *tie))
    same = [F.col("_pid") == F.col("_bid"), *[F.col(c).eqNullSafe(F.col(f"_in_{c}")) for c in within]]
    met = cut.withColumn("_place", place).join(F.broadcast(before), same, "left")  # fewer rows than partitions
    out = met.withColumn("rank", F.coalesce("_before", F.lit(0)) + F.col("_place") - 1).drop("_pid", "_bid", "_place", "_before", *[f"_in_{c}" for c in within])
    return out if within else out.withColumn("total", sizes.agg(F.sum("_n")).scalar())


def group_quantile(df: DataFrame, groups: list[str], value: str, p: float) -> DataFrame:
    """``groups, n, quantile``: the interpolated quantile of each group's values; null and NaN must be gone."""
    rows = ranked(df.select(*groups, value), value, [], groups)
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).withColumn("_at", p * (F.col("n") - 1))
    named = sizes.select(*[F.col(c).alias(f"_g_{c}") for c in groups], "n", "_at")
    on: Column = (F.col("rank") == F.floor("_at")) | (F.col("rank") == F.ceil("_at"))
    for c in groups:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    low, high = F.min(value), F.max(value)
    share = F.max("_at") - F.floor(F.max("_at"))
    return rows.join(named, on).groupBy(*groups).agg(F.max("n").alias("n"), (low + (high - low) * share).alias("quantile"))
