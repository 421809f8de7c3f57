"""Per-key results when a handful of keys hold most rows.

Everything here is an algebraic aggregate, so Spark's hash aggregation combines rows in a
bounded table per map task (spilling to sorted runs beyond it) and only one compact
state per key and task is shuffled: a hot key costs its reducer a row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_records(df: DataFrame, record: str, columns: list[str]) -> DataFrame:
    """One row per ``record`` and its key columns; rows without record id don't count.

    Hash-partitioned by record, never by the hot key.
    """
    return df.select(record, *columns).where(F.col(record).isNotNull()).dropDuplicates([record, *columns])


def key_states(df: DataFrame, positions: list[str], record: str, measure: str | None = None) -> DataFrame:
    """``position, key, n, nearest``: distinct records and smallest ``measure`` per key and position.

    Null keys keep a row of their own (``key`` null), so that shares have a whole to refer to.
    A null or NaN measure never is the nearest. A record repeated by a later run counts once.
    """
    columns = [*positions, *([measure] if measure else [])]
    once = distinct_records(df, record, columns)
    value = F.col(measure).cast("double") if measure else F.lit(None).cast("double")
    return (
        once.select(
            F.explode(F.array(*[F.struct(F.lit(p).alias("position"), F.col(p).alias("key")) for p in positions])).alias("_at"),
            F.when(~F.isnan(value), value).alias("_value"),
        )
        .groupBy(F.col("_at.position").alias("position"), F.col("_at.key").alias("key"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("_value").alias("nearest"))
    )


def merge_states(states: DataFrame) -> DataFrame:
    """Combine ``key_states`` of disjoint pieces (days, files) into those of the whole."""
    return states.groupBy("position", "key").agg(F.sum("n").alias("n"), F.min("nearest").alias("nearest"))


def heavy_keys(df: DataFrame, positions: list[str], record: str, share: float = 0.02) -> DataFrame:
    """``position, key, n, total`` of keys holding at least ``share`` of all distinct records.

    At most ``1/share`` keys per position come out. The total is one number, the distinct
    records themselves, so the states are made once and the one shuffle by record serves both.
    """
    total = distinct_records(df, record, positions).agg(F.count(F.lit(1)).alias("total")).scalar()
    counts = key_states(df, positions, record).select("position", "key", "n")
    return counts.where(F.col("key").isNotNull()).withColumn("total", total).where(F.col("n") >= F.lit(share) * F.col("total"))
