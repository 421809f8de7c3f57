"""Sessions, before/after statistics, step models and variance components of observation series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearpass.operators.ranks import ranked


def gap_sessions(df: DataFrame, key: str, time: str, gap: float, tie: str, block_days: float | None = None) -> DataFrame:
    """Adds ``session``: a new one starts where the time since the reading before exceeds ``gap``.

    The session is named by its first time, so it is the same however the data are cut. With
    ``block_days`` the window runs per key and time block, for a key that holds a large share
    of all rows; sessions across a block edge are then joined by comparing block ends only.
    """
    if block_days is None:
        w = W.partitionBy(key).orderBy(time, tie)
        start = F.when(F.lag(time).over(w).isNull() | (F.col(time) - F.lag(time).over(w) > gap), F.col(time))
        return df.withColumn("session", F.last(start, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    cut = df.withColumn("_block", F.floor(F.col(time) / block_days))
    w = W.partitionBy(key, "_block").orderBy(time, tie)
    start = F.when(F.lag(time).over(w).isNull() | (F.col(time) - F.lag(time).over(w) > gap), F.col(time))
    inner = cut.withColumn("_s", F.last(start, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    # one row per inner session: those that open a block may go on from the one before
    parts = inner.groupBy(key, "_block", "_s").agg(F.max(time).alias("_end"))
    pw = W.partitionBy(key).orderBy("_s")
    fresh = F.when(F.lag("_end").over(pw).isNull() | (F.col("_s") - F.lag("_end").over(pw) > gap), F.col("_s"))
    named = parts.withColumn("session", F.last(fresh, ignorenulls=True).over(pw.rowsBetween(W.unboundedPreceding, 0))).drop("_end")
    return inner.join(named, [key, "_block", "_s"]).drop("_block", "_s")


def before_after(df: DataFrame, key: str, value: Column, is_before: Column, is_after: Column) -> DataFrame:
    """Means, population spreads, counts, Welch t and a three sigma flag per key."""
    side = lambda cond, f: f(F.when(cond, value))
    out = df.groupBy(key).agg(
        side(is_before, F.avg).alias("mean_before"), side(is_after, F.avg).alias("mean_after"),
        side(is_before, F.stddev_pop).alias("sd_before"), side(is_after, F.stddev_pop).alias("sd_after"),
        F.count_if(is_before & value.isNotNull()).alias("n_before"), F.count_if(is_after & value.isNotNull()).alias("n_after"),
    )
    spread = F.sqrt(F.pow("sd_before", 2) / F.nullif(F.col("n_before"), F.lit(0)) + F.pow("sd_after", 2) / F.nullif(F.col("n_after"), F.lit(0)))
    out = out.withColumn("welch_t", F.when(spread > 0, (F.col("mean_after") - F.col("mean_before")) / spread))
    return out.withColumn("significant", F.coalesce(F.abs("welch_t") >= 3.0, F.lit(False)))


def _line_rss(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column, syy: Column) -> Column:
    """Residual sum of squares of a least-squares line from sums."""
    vx, vy, cxy = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
    return F.greatest(F.lit(0.0), vy - F.when(vx > 0, cxy * cxy / vx).otherwise(0.0))


def step_bic(df: DataFrame, key: str, x: str, y: str, at: Column, least: int = 10, least_side: int = 3) -> DataFrame:
    """BIC of a line against a line with a step at ``at`` (a column), from sums alone.

    The step model's normal equations are solved in closed form after the step column has
    been centred against line and constant. ``delta_bic`` is line minus step (positive
    favours the step); null with fewer than ``least`` points or ``least_side`` on a side.
    """
    sums = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(key).agg(*_line_sums(x, y), *_step_sums(x, y, at, "step_"))
    return sums.select(key, "n", _step_gain(*[F.col(c) for c in ("step_", "step_x", "step_y")], least, least_side).alias("delta_bic"))


def _line_sums(x: str, y: str) -> list[Column]:
    x, y = F.col(x), F.col(y)
    return [F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy")]


def _step_sums(x: str, y: str, at: Column, name: str) -> list[Column]:
    s = F.when(F.col(x) >= at, 1.0).otherwise(0.0)
    return [F.sum(s).alias(name), F.sum(s * F.col(x)).alias(f"{name}x"), F.sum(s * F.col(y)).alias(f"{name}y")]


def _step_gain(ss: Column, ssx: Column, ssy: Column, least: int, least_side: int) -> Column:
    """``delta_bic`` from the sums of a line and of a step."""
    n, sx, sy, sxx, sxy, syy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy", "syy"))
    vx, cxy = sxx - sx * sx / n, sxy - sx * sy / n
    csx, csy, vs = ssx - ss * sx / n, ssy - ss * sy / n, ss - ss * ss / n
    line = _line_rss(n, sx, sy, sxx, sxy, syy)
    step_var = vs - F.when(vx > 0, csx * csx / vx).otherwise(0.0)
    step_cov = csy - F.when(vx > 0, csx * cxy / vx).otherwise(0.0)
    step = F.greatest(F.lit(0.0), line - F.when(step_var > 0, step_cov * step_cov / step_var).otherwise(0.0))
    bic = lambda rss, k: n * F.log(F.greatest(rss / n, F.lit(1e-300))) + k * F.log(n)
    return F.when((n >= least) & (ss >= least_side) & (n - ss >= least_side), bic(line, 2.0) - bic(step, 3.0))


def icc_anova(df: DataFrame, key: str, cluster: str, value: Column) -> DataFrame:
    """One-way intraclass correlation of ``value`` over clusters of each key.

    Two aggregations: cluster sums, then the key's mean squares; ``icc`` null with fewer than two clusters or no
    repeated cluster.
    """
    per = df.where(value.isNotNull()).groupBy(key, cluster).agg(F.count(F.lit(1)).alias("m"), F.sum(value).alias("s"), F.sum(value * value).alias("q"))
    t = per.groupBy(key).agg(
        F.count(F.lit(1)).alias("k"), F.sum("m").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.sum(F.col("s") * F.col("s") / F.col("m")).alias("between"), F.sum(F.col("m") * F.col("m")).alias("mm"),
    )
    k, n = F.col("k"), F.col("n")
    msb = (F.col("between") - F.col("s") * F.col("s") / n) / F.nullif(k - 1, F.lit(0))
    msw = (F.col("q") - F.col("between")) / F.nullif(n - k, F.lit(0))
    m0 = (n - F.col("mm") / n) / F.nullif(k - 1, F.lit(0))
    return t.select(key, "k", "n", ((msb - msw) / F.nullif(msb + (m0 - 1.0) * msw, F.lit(0.0))).alias("icc"))


def leave_one_out_floor(df: DataFrame, ident: str, error: Column) -> DataFrame:
    """Root mean square of all calibrators' errors without each one's own."""
    rows = df.where(error.isNotNull()).select(ident, (error * error).alias("_q"))
    total, n = rows.agg(F.sum("_q")).scalar(), rows.agg(F.count(F.lit(1))).scalar()
    return rows.select(ident, F.sqrt((total - F.col("_q")) / F.nullif(n - 1, F.lit(0))).alias("floor"))


def jackknife(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Jackknife spread of the mean per key and the share of the strongest single value, from sums.

    Leaving one out moves the mean by (mean - x)/(n - 1), so no replicate needs to be made.
    """
    base = df.where(value.isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("s"), F.sum(value * value).alias("q"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    ss = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    strongest = F.greatest(F.pow(F.col("hi") - F.col("mean"), 2), F.pow(F.col("mean") - F.col("lo"), 2))
    n = F.col("n")
    return base.where(n >= 3).select(key, "n", "mean", F.sqrt(F.greatest(ss, F.lit(0.0)) / (n * (n - 1))).alias("jackknife_sigma"), F.when(ss > 0, strongest / ss).alias("top_share"))


def step_specificity(df: DataFrame, key: str, x: str, y: str, at: Column, offsets: list[float]) -> DataFrame:
    """How much better a step fits at ``at`` than at the best shifted instant.

    ``specificity``: BIC gain at ``at`` minus the largest gain at the offsets; ``flag`` above 2. All
    instants are sums of one aggregation, so no row is repeated.
    """
    instants = [at, *[at + F.lit(float(o)) for o in offsets]]
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = rows.groupBy(key).agg(*_line_sums(x, y), *[c for k, instant in enumerate(instants) for c in _step_sums(x, y, instant, f"s{k}_")])
    # one expression over an array of sums: written out for every instant it would outgrow a compiled method
    tried = F.array(*[F.struct(F.col(f"s{k}_").alias("s"), F.col(f"s{k}_x").alias("x"), F.col(f"s{k}_y").alias("y")) for k in range(len(instants))])
    gains = sums.withColumn("_gains", F.transform(tried, lambda q: _step_gain(q["s"], q["x"], q["y"], 10, 3)))
    best = gains.select(key, F.col("_gains")[0].alias("real"), F.array_max(F.slice("_gains", 2, len(offsets))).alias("other"))
    return best.withColumn("specificity", F.col("real") - F.col("other")).withColumn("flag", F.coalesce(F.col("specificity") > 2.0, F.lit(False)))


def percentile_rank(population: DataFrame, group: str, value: str, probes: DataFrame) -> DataFrame:
    """Share of a group's values strictly below a probe ``group, probe``; null for an empty group.

    Probes are ranked among the values of their group, a probe before its equals, and among themselves; the
    difference is the number of values below. No value meets every probe.
    """
    values = population.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("_v"), F.lit(1).alias("_kind"))
    asked = probes.select(group, F.col("probe").cast("double").alias("_v"), F.lit(0).alias("_kind")).distinct()
    mixed = ranked(values.unionByName(asked), "_v", ["_kind"], [group]).where("_kind = 0").select(group, "_v", F.col("rank").alias("_all"))
    alone = ranked(asked, "_v", [], [group]).select(F.col(group).alias("_g"), F.col("_v").alias("_w"), "rank")
    sizes = values.groupBy(F.col(group).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    met = mixed.join(alone, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_v") == F.col("_w"))).join(sizes, F.col(group).eqNullSafe(F.col("_h")), "left")
    return met.select(group, F.col("_v").alias("probe"), ((F.col("_all") - F.col("rank")) / F.col("_n")).alias("rank"))
