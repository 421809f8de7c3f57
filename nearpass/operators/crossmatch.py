"""Order-insensitive matching of pair lists, catalog differences and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearpass.functions.physics import clean


def with_pair_key(df: DataFrame, one: str, two: str) -> DataFrame:
    """``lo, hi`` as bigint; null where either body is unknown."""
    known = F.col(one).isNotNull() & F.col(two).isNotNull()
    return df.withColumn("lo", F.when(known, F.least(one, two).cast("bigint"))).withColumn("hi", F.when(known, F.greatest(one, two).cast("bigint")))


def pair_minima(df: DataFrame, one: str = "number_1", two: str = "number_2", dist: str = "dist_au") -> DataFrame:
    keyed = with_pair_key(df, one, two).where(F.col("lo").isNotNull())
    return keyed.groupBy("lo", "hi").agg(F.min(clean(F.col(dist))).alias("dist_au"), F.count(F.lit(1)).alias("n"))


def catalog_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``lo, hi, dist_a, dist_b, side`` over pair minima of two catalogs: ``a``, ``b`` or ``both``."""
    left = a.select("lo", "hi", F.col("dist_au").alias("dist_a"), F.lit(True).alias("_a"))
    right = b.select("lo", "hi", F.col("dist_au").alias("dist_b"), F.lit(True).alias("_b"))
    met = left.join(right, ["lo", "hi"], "full")
    side = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "a").otherwise("b")
    return met.select("lo", "hi", "dist_a", "dist_b", side.alias("side"))


def match_events(events: DataFrame, encounters: DataFrame, tolerance: float, width: float = 64.0) -> DataFrame:
    """Each published event's best encounter of the same pair within ``tolerance`` days, by distance.

    ``events``: ``recno, lo, hi, jd``; ``encounters``: ``encounter_id, lo, hi, jd, dist_au``. Time buckets
    join the key, so one pair that holds a large share of all rows spreads out. One winner
    per event is chosen by an aggregate, never by sorting an event's matches.
    """
    bucket = lambda x: F.floor(x / width).cast("bigint")
    asked = events.where("lo IS NOT NULL AND jd IS NOT NULL").withColumn("_b", F.explode(F.array_distinct(F.array(bucket(F.col("jd") - tolerance), bucket(F.col("jd") + tolerance)))))
    there = encounters.select("encounter_id", "lo", "hi", F.col("jd").alias("enc_jd"), F.col("dist_au").alias("enc_dist"), bucket(F.col("jd")).alias("_b"))
    met = asked.join(there, ["lo", "hi", "_b"]).where(F.abs(F.col("enc_jd") - F.col("jd")) <= tolerance)
    best = F.min(F.struct(F.coalesce(clean(F.col("enc_dist")), F.lit(float("inf"))).alias("d"), F.abs(F.col("enc_jd") - F.col("jd")).alias("gap"), F.col("encounter_id").alias("encounter_id")))
    return met.groupBy("recno").agg(best.alias("m")).select("recno", "m.encounter_id", F.col("m.gap").alias("gap_days"))


def outcome(in_catalog: Column, dist: Column, threshold: Column | float, known_1: Column, known_2: Column) -> Column:
    """Why a published pair is or isn't in the catalog."""
    return (
        F.when(in_catalog & (dist < threshold), "recovered")
        .when(in_catalog, "beyond_threshold")
        .when(known_1 & known_2, "missed")
        .when(known_1 | known_2, "one_body_unknown")
        .otherwise("both_unknown")
    )


def literature_outcomes(published: DataFrame, minima: DataFrame, universe: DataFrame, threshold: float) -> DataFrame:
    """``recno, outcome`` of each published pair; ``universe``: distinct ``number`` of bodies looked at."""
    known = lambda c: universe.select(F.col("number").cast("bigint").alias(c), F.lit(True).alias(f"_{c}"))
    met = published.join(minima.select("lo", "hi", "dist_au", F.lit(True).alias("_in")), ["lo", "hi"], "left").join(known("lo"), "lo", "left").join(known("hi"), "hi", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return met.select("recno", outcome(yes("_in"), F.col("dist_au"), threshold, yes("_lo"), yes("_hi")).alias("outcome"))


def universe_of(df: DataFrame) -> DataFrame:
    """Distinct bodies of either position."""
    return df.select(F.explode(F.array("number_1", "number_2")).alias("number")).where("number IS NOT NULL").distinct()


def transit_coverage(events: DataFrame, transits: DataFrame, reach: float, near: float) -> DataFrame:
    """Observations of an event's target before, after and around it; events without any stay.

    ``events``: ``recno, targ, jd``; ``transits``: ``number, jd`` (one row per observation). The events are joined
    to per-day counts of each body, not to single observations.
    """
    days = transits.where("number IS NOT NULL AND jd IS NOT NULL").groupBy("number", F.floor("jd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("jd").alias("first"), F.max("jd").alias("last"))
    gap = F.col("day") + 0.5 - F.col("jd")
    met = events.join(days, (events["targ"] == days["number"]) & (F.abs(gap) <= reach), "left")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    return met.groupBy("recno").agg(
        total(gap < 0)("before"), total(gap >= 0)("after"), total(F.abs(gap) <= near)("around"),
        F.max(F.when(gap < 0, F.col("day"))).alias("last_day_before"), F.min(F.when(gap >= 0, F.col("day"))).alias("first_day_after"),
    ).withColumn("viable", (F.col("before") >= 5) & (F.col("after") >= 5))


def supplement(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``rows`` and those of ``more`` whose key is absent there."""
    return rows.unionByName(more.join(rows.select(key), key, "left_anti"), allowMissingColumns=True)
