"""Table schemas, renames and casts of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _I, _S, _B, _L = T.DoubleType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ELEMENTS = _struct(number=_I, designation=_S, h_mag=_D, g_slope=_D, epoch_jd=_D, mean_anomaly_deg=_D, argperi_deg=_D, node_deg=_D, i_deg=_D, ecc=_D, a_au=_D)
CANDIDATES = _struct(idx_i=_L, idx_j=_L, t_coarse_jd=_D, d_coarse_au=_D)
ENCOUNTERS = _struct(number_1=_I, number_2=_I, designation_1=_S, designation_2=_S, jd_tdb=_D, dist_au=_D, rel_vel_au_day=_D)
CATALOG = _struct(
    run_id=_S, number_1=_I, number_2=_I, designation_1=_S, designation_2=_S, jd_tdb=_D, date_utc=_S, dist_au=_D, dist_km=_D, rel_vel_au_day=_D, rel_vel_km_s=_D, rel_vel_m_s=_D,
    h_1=_D, h_2=_D, diameter_1_km=_D, diameter_2_km=_D, diameter_source_1=_S, diameter_source_2=_S, deflection_dv_m_s=_D, class_1=_S, class_2=_S,
    solar_elongation_deg=_D, solar_elongation_1_deg=_D, solar_elongation_2_deg=_D, app_mag_1=_D, app_mag_2=_D, gaia_observable_1=_B, gaia_observable_2=_B, gaia_observable=_B,
)
PHYSICAL = _struct(number=_I, diameter_km=_D, diameter_sigma_km=_D, albedo=_D)

#: Element names that differ only by case in other tools.
RENAMES = {"Omega_deg": "node_deg", "omega_deg": "argperi_deg", "M_deg": "mean_anomaly_deg", "H": "h_mag", "G": "g_slope", "e": "ecc"}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns that are present, in its order and types."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name in df.columns])


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
