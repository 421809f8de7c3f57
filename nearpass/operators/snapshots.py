"""Change events between consecutive full snapshots (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearpass.session import broadcast_if_small


def delivery_order(snapshots: DataFrame, rows: DataFrame, path: str = "path", epoch: str = "epoch_jd", rows_path: str = "snapshot_path") -> DataFrame:
    """``(rows_path, seq)``: the deliveries that have rows and an epoch, numbered by epoch.

    A delivery listed twice counts once with its smallest epoch; null and NaN epochs
    and paths without rows are left out; equal epochs are ordered by path.
    """
    present = rows.select(F.col(rows_path)).where(F.col(rows_path).isNotNull()).distinct()
    dated = (
        snapshots.select(F.col(path).alias(rows_path), F.col(epoch).cast("double").alias("_epoch"))
        .where(F.col("_epoch").isNotNull() & ~F.isnan("_epoch"))
        .groupBy(rows_path)
        .agg(F.min("_epoch").alias("_epoch"))
        .join(present, rows_path, "left_semi")
    )
    # one row per delivery: the un-partitioned window sorts a list of deliveries, not of records
    return dated.select(rows_path, F.row_number().over(W.orderBy("_epoch", rows_path)).alias("seq"))


def validity_intervals(rows: DataFrame, order: DataFrame, key: str, value: str, tol: float, rows_path: str = "snapshot_path") -> DataFrame:
    """Maximal runs of consecutive deliveries in which a key is present and unchanged.

    Two neighbouring versions are one island when their row hashes agree or, failing
    that, when ``value`` differs by at most ``tol`` (null equals null, NaN counts as null).
    Repeated rows are combined before the shuffle, keeping the smallest value, so a key
    written any number of times costs one row per delivery. Null keys don't count.
    Result: ``key, first_seq, last_seq, value``.
    """
    versions = (
        rows.select(F.col(key).alias("_key"), F.col(rows_path), F.col(value).cast("double").alias("_value"))
        .where(F.col("_key").isNotNull())
        .withColumn("_value", F.when(~F.isnan("_value"), F.col("_value")))
        .join(broadcast_if_small(order), rows_path)
        .groupBy("_key", "seq")
        .agg(F.min("_value").alias("_value"))
        .withColumn("_hash", F.xxhash64("_value"))
    )
    by_key = W.partitionBy("_key").orderBy("seq")
    before = F.lag("_value").over(by_key)
    differs = (F.col("_hash") != F.lag("_hash").over(by_key)) & (
        F.col("_value").isNull() | before.isNull() | (F.abs(F.col("_value") - before) > tol)
    )
    starts = F.lag("seq").over(by_key).isNull() | (F.lag("seq").over(by_key) != F.col("seq") - 1) | differs
    return (
        versions.withColumn("_start", starts.cast("int"))
        .withColumn("_island", F.sum("_start").over(by_key.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("_key", "_island")
        .agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min_by("_value", "seq").alias("value"))
        .select(F.col("_key").alias(key), "first_seq", "last_seq", "value")
    )


def snapshot_changes(rows: DataFrame, snapshots: DataFrame, key: str = "number", value: str = "a_au", tol: float = 5e-8, rows_path: str = "snapshot_path") -> DataFrame:
    """``(rows_path, key, change_kind)`` between each two successive deliveries.

    The later delivery is named. An island that starts after the first delivery is an
    ``added`` key, or a ``changed`` one if another island ends right before it; an island that
    ends before the last delivery without a neighbour is ``removed`` in the next one.
    Empty input gives no rows; extra columns are ignored.
    """
    order = delivery_order(snapshots, rows, rows_path=rows_path)
    intervals = validity_intervals(rows, order, key, value, tol, rows_path)
    by_key = W.partitionBy(key).orderBy("first_seq")
    last = order.agg(F.max("seq")).scalar()
    marked = intervals.withColumn("_before", F.lag("last_seq").over(by_key)).withColumn("_after", F.lead("first_seq").over(by_key))
    adjacent = F.col("_before") == F.col("first_seq") - 1
    start = F.when(F.col("first_seq") > 1, F.struct(F.col("first_seq").alias("seq"), F.when(adjacent, "changed").otherwise("added").alias("change_kind")))
    end = F.when(
        (F.col("last_seq") < F.col("_last")) & (F.col("_after").isNull() | (F.col("_after") > F.col("last_seq") + 1)),
        F.struct((F.col("last_seq") + 1).alias("seq"), F.lit("removed").alias("change_kind")),
    )
    return (
        marked.withColumn("_last", last)
        .select(key, F.explode(F.array_compact(F.array(start, end))).alias("_event"))
        .select(key, "_event.*")
        .join(broadcast_if_small(order), "seq")
        .select(rows_path, key, "change_kind")
    )
