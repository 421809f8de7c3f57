"""Queries for the general data problems (spikes, snapshots, heavy keys) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpass.operators.heavy_keys import heavy_keys, key_states
from nearpass.operators.spikes import implausible_readings
from nearpass.operators.snapshots import delivery_order, snapshot_changes, validity_intervals
from nearpass.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found = implausible_readings(table(spark, sf, "sso_observation"))
    return found.select(F.col("reading").alias("observation_id")).distinct()


def p1_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Each implausible reading with every reason."""
    return implausible_readings(table(spark, sf, "sso_observation")).withColumnRenamed("reading", "observation_id")


def p1_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The readings out of range, stuck or under another number; what lies off the path has no SQL."""
    return p1_kinds(spark, sf).where("kind <> 'path'")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_changes(table(spark, sf, "elements"), table(spark, sf, "mpcorb_snapshot"))


def p3_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Validity interval of every version of every numbered body."""
    rows = table(spark, sf, "elements")
    order = delivery_order(table(spark, sf, "mpcorb_snapshot"), rows)
    return validity_intervals(rows, order, "number", "a_au", 5e-8).select("number", F.col("first_seq").cast("long").alias("first_seq"), F.col("last_seq").cast("long").alias("last_seq"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    found = heavy_keys(table(spark, sf, "encounters_catalog"), ["number_1", "number_2"], "encounter_id", 0.02)
    return found.select("position", F.col("key").alias("number"))


def p4_per_body(spark: SparkSession, sf: str) -> DataFrame:
    """Encounters and nearest distance of every body in either position."""
    states = key_states(table(spark, sf, "encounters_catalog"), ["number_1", "number_2"], "encounter_id", "dist_au")
    return states.where(F.col("key").isNotNull()).select("position", F.col("key").alias("number"), F.col("n").alias("encounters"), F.col("nearest").alias("nearest_au"))


QUERIES = {"p1_found": p1_found, "p1_kinds": p1_kinds, "p1_rules": p1_rules, "p3_found": p3_found, "p3_intervals": p3_intervals, "p4_found": p4_found, "p4_per_body": p4_per_body}

_DELIVERIES = """
order_of AS (
  SELECT path AS snapshot_path, row_number() OVER (ORDER BY epoch_jd, path) AS seq
  FROM (SELECT path, min(epoch_jd) AS epoch_jd FROM mpcorb_snapshot
        WHERE epoch_jd IS NOT NULL AND NOT isnan(epoch_jd) AND path IN (SELECT snapshot_path FROM elements)
        GROUP BY path)
),
versions AS (
  SELECT number, seq, min(CASE WHEN NOT isnan(a_au) THEN a_au END) AS a_au
  FROM elements JOIN order_of USING (snapshot_path) WHERE number IS NOT NULL GROUP BY number, seq
)"""

_STUCK = """
e_{0} AS (SELECT source_id, observation_id, x, epoch, coalesce(x = lag(x) OVER (PARTITION BY source_id ORDER BY epoch, observation_id), false) AS same FROM (SELECT *, {0} AS x FROM r WHERE epoch IS NOT NULL)),
f_{0} AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY epoch, observation_id) AS run FROM e_{0}),
s_{0} AS (SELECT observation_id FROM (SELECT *, count(*) OVER (PARTITION BY source_id, run) AS n FROM f_{0}) WHERE same AND n >= 4)"""

SQL = {
    "p1_rules": f"""
WITH r AS (SELECT DISTINCT source_id, observation_id, epoch, number_mp, CASE WHEN NOT isnan(ra) THEN ra END AS ra, CASE WHEN NOT isnan(dec) THEN dec END AS dec FROM sso_observation WHERE source_id IS NOT NULL AND observation_id IS NOT NULL),
{_STUCK.format("ra")}, {_STUCK.format("dec")},
usual AS (SELECT source_id, number_mp AS u FROM (SELECT source_id, number_mp, count(DISTINCT observation_id) AS n FROM r WHERE number_mp IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n DESC, number_mp) = 1)
SELECT observation_id, 'range' AS kind FROM r WHERE ra < 0 OR ra >= 360 OR abs(dec) > 90
UNION SELECT observation_id, 'run' FROM s_ra UNION SELECT observation_id, 'run' FROM s_dec
UNION SELECT observation_id, 'label' FROM r JOIN usual USING (source_id) WHERE number_mp <> u""",
    "p3_found": f"""
WITH {_DELIVERIES},
steps AS (SELECT a.seq AS before, b.seq, b.snapshot_path FROM order_of a JOIN order_of b ON b.seq = a.seq + 1)
SELECT s.snapshot_path, v.number, 'added' AS change_kind FROM steps s JOIN versions v ON v.seq = s.seq
  WHERE NOT EXISTS (SELECT 1 FROM versions w WHERE w.number = v.number AND w.seq = s.before)
UNION ALL
SELECT s.snapshot_path, v.number, 'removed' FROM steps s JOIN versions v ON v.seq = s.before
  WHERE NOT EXISTS (SELECT 1 FROM versions w WHERE w.number = v.number AND w.seq = s.seq)
UNION ALL
SELECT s.snapshot_path, v.number, 'changed' FROM steps s JOIN versions v ON v.seq = s.seq
  JOIN versions w ON w.number = v.number AND w.seq = s.before
  WHERE abs(v.a_au - w.a_au) > 5e-8 OR (v.a_au IS NULL) <> (w.a_au IS NULL)""",
    "p3_intervals": f"""
WITH {_DELIVERIES},
marked AS (
  SELECT *, CASE WHEN lag(seq) OVER k IS NULL OR lag(seq) OVER k <> seq - 1
    OR abs(a_au - lag(a_au) OVER k) > 5e-8 OR (a_au IS NULL) <> (lag(a_au) OVER k IS NULL) THEN 1 ELSE 0 END AS starts
  FROM versions WINDOW k AS (PARTITION BY number ORDER BY seq)
),
islands AS (SELECT *, sum(starts) OVER (PARTITION BY number ORDER BY seq) AS island FROM marked)
SELECT number, min(seq) AS first_seq, max(seq) AS last_seq FROM islands GROUP BY number, island""",
    "p4_found": """
WITH once AS (SELECT DISTINCT encounter_id, number_1, number_2 FROM encounters_catalog WHERE encounter_id IS NOT NULL),
long AS (SELECT 'number_1' AS position, number_1 AS number FROM once UNION ALL SELECT 'number_2', number_2 FROM once)
SELECT position, number FROM long WHERE number IS NOT NULL GROUP BY position, number
HAVING count(*) >= 0.02 * (SELECT count(*) FROM once)""",
    "p4_per_body": """
WITH once AS (SELECT DISTINCT encounter_id, number_1, number_2, dist_au FROM encounters_catalog WHERE encounter_id IS NOT NULL),
long AS (SELECT 'number_1' AS position, number_1 AS number, dist_au FROM once UNION ALL SELECT 'number_2', number_2, dist_au FROM once)
SELECT position, number, count(*) AS encounters, min(CASE WHEN NOT isnan(dist_au) THEN dist_au END) AS nearest_au
FROM long WHERE number IS NOT NULL GROUP BY position, number""",
}
