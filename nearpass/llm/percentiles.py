"""Percentiles per group over very many numbers, from pieces that can be put together.

The state of a piece is its table of ``(group, value, n)``; states add up. Percentiles come
from cumulative frequencies: range-sort the counts, add the totals of the earlier partitions
to running sums, and take the first value that reaches each target rank.
"""

from __future__ import annotations

from functools import reduce
from math import log1p

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearpass.session import stage


def _rounded(value: Column, rel_error: float) -> Column:
    """The value itself, or the geometric middle of its cell on a grid of ratio (1+e)^2."""
    if not rel_error:
        return value
    step = 2.0 * log1p(rel_error)
    size = F.abs(value)
    middle = F.exp((F.floor(F.log(size) / step) + 0.5) * step)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.signum(value) * middle)


def value_counts(df: DataFrame, group: str, value: str, record: list[str], rel_error: float = 0.0, pieces: list[str] | None = None) -> DataFrame:
    """Mergeable state ``[pieces...], group, value, n``.

    A row repeated under the same ``record`` columns counts once. Null and NaN values are
    left out, but their group keeps a row with a null value and ``n`` 0, so that it comes out.
    With ``rel_error`` e every value is replaced by one within a factor 1+e of it, which
    bounds the size of a state by the range of the data instead of its row count. The
    answer's rank is always exact; its value is exact for e = 0.
    """
    pieces = pieces or []
    number = F.col(value).cast("double")
    once = (
        df.select(*record, *[c for c in [*pieces, group] if c not in record], F.when(~F.isnan(number), number).alias("_value"))
        .dropDuplicates()
        .withColumn("_value", _rounded(F.col("_value") + F.lit(0.0), rel_error))
    )
    return once.groupBy(*pieces, group, F.col("_value").alias("value")).agg(F.count("_value").alias("n"))


def merge_counts(*states: DataFrame, group: str) -> DataFrame:
    """Put states of separate partitions or days together."""
    union = reduce(DataFrame.unionByName, [s.select(group, "value", "n") for s in states])
    return union.groupBy(group, "value").agg(F.sum("n").alias("n"))


def percentiles_of(counts: DataFrame, group: str, probs: dict[str, float]) -> DataFrame:
    """``group, n, <name of each probability>``: the value of rank ``max(1, ceil(p * n))``.

    The range-sorted counts are staged with their partition number: running sums and
    partition totals then rest on one and the same split, whatever is recomputed after a
    lost executor. A hot group is spread over many partitions. No step gathers a group.
    """
    sorted_counts = (
        counts.select(group, "value", "n")  # a group without values keeps its null row
        .repartitionByRange(group, "value")
        .withColumn("pid", F.spark_partition_id())
    )
    rows = stage(sorted_counts, "percentiles")
    blocks = rows.groupBy(group, "pid").agg(F.sum("n").alias("block_n"))
    by_group = W.partitionBy(group).orderBy("pid")
    blocks = blocks.withColumn("before", F.sum("block_n").over(by_group.rowsBetween(W.unboundedPreceding, 0)) - F.col("block_n")).withColumn(
        "total", F.sum("block_n").over(W.partitionBy(group))
    )
    ranks = F.array(*[F.struct(F.lit(name).alias("prob"), F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("total"))).alias("rank")) for name, p in probs.items()])
    targets = blocks.withColumn("ranks", F.filter(ranks, lambda r: (r["rank"] > F.col("before")) & (r["rank"] <= F.col("before") + F.col("block_n")))).where(F.size("ranks") > 0)
    targets = targets.select(F.col(group).alias("_group"), F.col("pid").alias("_pid"), "before", "total", "ranks")
    in_block = W.partitionBy(group, "pid").orderBy("value")
    running = (
        rows.join(targets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("pid") == F.col("_pid")))  # null is a group too
        .withColumn("upto", F.col("before") + F.sum("n").over(in_block.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("hit", F.filter("ranks", lambda r: (r["rank"] <= F.col("upto")) & (r["rank"] > F.col("upto") - F.col("n"))))
    )
    found = running.select(group, "total", "value", F.explode("hit.prob").alias("prob"))
    answers = found.groupBy(group).agg(F.max("total").alias("n"), *[F.max(F.when(F.col("prob") == name, F.col("value"))).alias(name) for name in probs])
    absent = blocks.where(F.col("total") == 0).select(group).distinct()
    empty = absent.select(group, F.lit(0).cast("bigint").alias("n"), *[F.lit(None).cast("double").alias(name) for name in probs])
    return answers.select(group, F.col("n").cast("bigint").alias("n"), *probs).unionByName(empty)
