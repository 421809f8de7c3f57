"""Deterministic samples and strata: rows are chosen by a hash of their key, never by arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearpass.operators.ranks import ranked


def draw(keys: list[str], seed: int) -> Column:
    """A pseudo-random order that depends on key and seed only."""
    return F.xxhash64(*keys, F.lit(seed))


def hash_sample(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same on every cluster (all if there are fewer)."""
    return df.orderBy(draw(keys, seed), *keys).limit(n)


def stratified_sample(df: DataFrame, stratum: list[str], keys: list[str], per_stratum: int, seed: int = 0, least: int = 1) -> DataFrame:
    """Up to ``per_stratum`` rows of each stratum that has at least ``least`` rows.

    A row limit per stratum is pushed below the shuffle, so a stratum with most rows is cheap.
    """
    held = df.groupBy(*stratum).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    rank = F.row_number().over(W.partitionBy(*stratum).orderBy(draw(keys, seed), *keys))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= per_stratum).drop("_rank").join(held, stratum, "left_semi")


def systematic_sample(df: DataFrame, key: str, every: int, by: list[str]) -> DataFrame:
    """Every k-th row of each group in key order, beginning with the first; a group of any size spreads over tasks."""
    return ranked(df, key, [], by).where(F.col("rank") % every == 0).drop("rank")


def band(x: Column, edges: list[float]) -> Column:
    """Index of the right-open band between ascending edges; 0 below the first."""
    out = F.lit(0)
    for k, e in enumerate(edges, 1):
        out = F.when(x >= e, k).otherwise(out)
    return F.when(x.isNotNull(), out)


def stratum_id(parts: list[Column]) -> Column:
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def eligible_nulls(elements: DataFrame, close: DataFrame, like: int, exclude: list[int], width_au: float, h_low: float, h_high: float) -> DataFrame:
    """Bodies that could stand in for ``like``: near its a, in an H window, not close to the target.

    ``close``: ``number`` of bodies that do meet the target.
    """
    centre = elements.where(F.col("number") == like).agg(F.min("a_au")).scalar()
    near = elements.where((F.abs(F.col("a_au") - centre) <= width_au) & F.col("h_mag").between(h_low, h_high) & ~F.col("number").isin(like, *exclude))
    return near.join(close.select("number").distinct(), "number", "left_anti")


def null_draw(eligible: DataFrame, n: int, seed: int) -> DataFrame:
    return hash_sample(eligible.select("number"), ["number"], n, seed).orderBy("number")
