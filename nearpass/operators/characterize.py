"""Encounters with sizes, classes, geometry and observability of both bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearpass.functions.kepler import eccentric_anomaly, mean_anomaly, orbit_class, orbit_xyz
from nearpass.functions.physics import (
    apparent_mag, au_day_to_km_s, au_to_km, clean, deflection_dv, diameter, dot, earth_xyz, elongation_deg, minus, norm, observable,
)
from nearpass.functions.timescale import jd_to_iso_date
from nearpass.schema import CATALOG, conform
from nearpass.session import broadcast_if_small

_ORBIT = ["a_au", "ecc", "i_deg", "node_deg", "argperi_deg", "mean_anomaly_deg", "epoch_jd"]


def attach(encounters: DataFrame, side_table: DataFrame, columns: list[str], key: str = "number") -> DataFrame:
    """Left-join ``columns`` for body 1 and body 2; broadcast only if counted small."""
    one = side_table.select(key, *columns)
    small = broadcast_if_small(one)
    for s in ("1", "2"):
        renamed = small.select(F.col(key).alias(f"number_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns])
        encounters = encounters.join(renamed, f"number_{s}", "left")
    return encounters


def larger_first(df: DataFrame, columns: list[str], h: str = "h_mag") -> DataFrame:
    """Swap all ``_1``/``_2`` columns where body 2 is the larger (smaller H) or only its H is known."""
    swap = F.coalesce((F.col(f"{h}_1").isNull() & F.col(f"{h}_2").isNotNull()) | (F.col(f"{h}_2") < F.col(f"{h}_1")), F.lit(False))
    paired = [f"{c}_{s}" for c in columns for s in ("1", "2")]
    other = [c for c in df.columns if c not in paired]
    swapped = [F.when(swap, F.col(f"{c}_{3 - int(s)}")).otherwise(F.col(f"{c}_{s}")).alias(f"{c}_{s}") for c in columns for s in ("1", "2")]
    return df.select(*other, *swapped)


def characterize(encounters: DataFrame, elements: DataFrame, physical: DataFrame | None = None, run_id: Column | None = None, newton_steps: int = 15) -> DataFrame:
    """The full catalog row of every encounter.

    ``elements``: one row per ``number`` with orbit, ``h_mag``; ``physical``: ``number,
    diameter_km, albedo``. Bodies unknown to either keep nulls. All work after the joins is
    row-local, so batches, streams and the whole table give the same rows.
    """
    pairs = attach(encounters, elements, [*_ORBIT, "h_mag"])
    for c in ("h_mag_1", "h_mag_2"):
        pairs = pairs.withColumn(c, clean(F.col(c)))
    pairs = larger_first(pairs, ["number", "designation", *_ORBIT, "h_mag"])
    if physical is not None:
        pairs = attach(pairs, physical, ["diameter_km", "albedo"])
    else:
        nothing = F.lit(None).cast("double")
        pairs = pairs.select("*", *[nothing.alias(f"{c}_{s}") for c in ("diameter_km", "albedo") for s in ("1", "2")])
    for s in ("1", "2"):
        size, source = diameter(F.col(f"h_mag_{s}"), clean(F.col(f"a_au_{s}")), F.col(f"diameter_km_{s}"), F.col(f"albedo_{s}"))
        pairs = pairs.withColumn(f"diameter_source_{s}", source).withColumn(f"diameter_{s}_km", size).withColumn(f"class_{s}", orbit_class(F.col(f"a_au_{s}"), F.col(f"ecc_{s}")))
        mean = mean_anomaly(F.col(f"mean_anomaly_deg_{s}"), F.col(f"a_au_{s}"), F.col(f"epoch_jd_{s}"), F.col("jd_tdb"))
        pairs = pairs.withColumn(f"_e_{s}", eccentric_anomaly(mean, F.col(f"ecc_{s}"), newton_steps))
        xyz = orbit_xyz(*[F.col(f"{c}_{s}") for c in ("a_au", "ecc", "i_deg", "node_deg", "argperi_deg")], F.col(f"_e_{s}"))
        pairs = pairs.withColumn(f"_p_{s}", F.struct(*[v.alias(k) for k, v in xyz.items()]))
    pairs = pairs.withColumn("_earth", F.struct(*[v.alias(k) for k, v in earth_xyz(F.col("jd_tdb")).items()]))
    at = lambda name: {k: F.col(f"{name}.{k}") for k in "xyz"}
    earth = at("_earth")
    for s in ("1", "2"):
        body = at(f"_p_{s}")
        to_body = minus(body, earth)
        pairs = pairs.withColumn(f"solar_elongation_{s}_deg", elongation_deg(body, earth)).withColumn(f"app_mag_{s}", apparent_mag(F.col(f"h_mag_{s}"), F.sqrt(dot(body, body)), norm(to_body)))
        pairs = pairs.withColumn(f"gaia_observable_{s}", observable(F.col(f"solar_elongation_{s}_deg"), F.col(f"app_mag_{s}")))
    middle = {k: (F.col(f"_p_1.{k}") + F.col(f"_p_2.{k}")) / 2.0 for k in "xyz"}
    out = (
        pairs.withColumn("solar_elongation_deg", elongation_deg(middle, earth))
        .withColumn("gaia_observable", F.col("gaia_observable_1") | F.col("gaia_observable_2"))
        .withColumn("deflection_dv_m_s", deflection_dv(F.col("diameter_1_km"), F.col("dist_au"), F.col("rel_vel_au_day"), clean(F.col("a_au_1"))))
        .withColumn("date_utc", jd_to_iso_date(F.col("jd_tdb")))
        .withColumn("dist_km", au_to_km(F.col("dist_au")))
        .withColumn("rel_vel_km_s", au_day_to_km_s(F.col("rel_vel_au_day")))
        .withColumn("rel_vel_m_s", F.col("rel_vel_km_s") * 1000.0)
        .withColumn("h_1", F.col("h_mag_1"))
        .withColumn("h_2", F.col("h_mag_2"))
        .withColumn("run_id", run_id if run_id is not None else F.lit(None).cast("string"))
    )
    return conform(out, CATALOG)
