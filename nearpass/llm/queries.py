"""Queries of the training-data operators, their production parameters and SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpass.functions.timescale import parse_event_jd, utc_to_tdb
from nearpass.llm.leakage import LeakRules, leaked_items
from nearpass.llm.nearest_time import nearest_in_time
from nearpass.llm.packing import pack_documents, packed_corpus, token_counts, utilisation
from nearpass.llm.percentiles import merge_counts, percentiles_of, value_counts
from nearpass.llm.subjects import document_subjects
from nearpass.llm.topn import top_n
from nearpass.session import spread, stage, table

PROBS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
RECORD = ["number_1", "number_2", "t_min_kepler_jd"]


def p2_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    counts = value_counts(table(spark, sf, "refined"), "bin_id", "delta_dist_au", RECORD)
    return percentiles_of(counts, "bin_id", PROBS)


def p2_merged_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The same from states kept per day and shard, put together afterwards."""
    pieces = value_counts(table(spark, sf, "refined"), "bin_id", "delta_dist_au", RECORD, pieces=["refine_day", "shard_id"])
    return percentiles_of(merge_counts(pieces, group="bin_id"), "bin_id", PROBS)


def p2_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """Within 0.1 percent of the exact values, from states of bounded size."""
    counts = value_counts(table(spark, sf, "refined"), "bin_id", "delta_dist_au", RECORD, rel_error=1e-3)
    return percentiles_of(counts, "bin_id", PROBS)


def p2_within(spark: SparkSession, sf: str) -> DataFrame:
    """Whether every percentile of the bounded states is within their stated error of the exact one."""
    exact, bounded = p2_percentiles(spark, sf), p2_bounded(spark, sf)
    near = [F.abs(bounded[c] - exact[c]) <= 1e-3 * F.abs(exact[c]) + 1e-300 for c in PROBS]
    met = exact.join(bounded, exact["bin_id"].eqNullSafe(bounded["bin_id"]))
    return met.select(exact["bin_id"], exact["n"], F.coalesce(reduce(Column.__and__, near), exact["n"] == 0).alias("within"))


def _tdb(text: Column) -> Column:
    """The lambda binds the parsed date once; written out, the leap second chain would repeat it."""
    return F.transform(F.array(parse_event_jd(text)), utc_to_tdb)[0]


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "goffin_2014_encounters").select("recno", F.least("pert", "targ").alias("lo"), F.greatest("pert", "targ").alias("hi"), _tdb(F.col("event_date")).alias("jd"), "pert", "targ")
    events = events.where(F.col("pert").isNotNull() & F.col("targ").isNotNull())
    records = table(spark, sf, "encounters_catalog").where(F.col("number_1").isNotNull() & F.col("number_2").isNotNull())
    records = records.select("encounter_id", F.least("number_1", "number_2").alias("lo"), F.greatest("number_1", "number_2").alias("hi"), F.col("jd_tdb").alias("jd"))
    found = nearest_in_time(events, records, ["lo", "hi"], "jd", "jd", "recno", "encounter_id", 31.0)
    return found.select("recno", "encounter_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    speed = F.col("rel_vel_au_day")
    rows = table(spark, sf, "encounters_catalog").select("number_1", "encounter_id", "dist_au", F.when(~F.isnan(speed), speed).alias("speed"))
    rows = rows.where(F.col("dist_au").isNotNull() & ~F.isnan("dist_au"))
    order = [F.col("dist_au").asc(), F.col("speed").desc_nulls_last(), F.col("encounter_id").asc()]
    return top_n(rows, "number_1", "encounter_id", order, 3).select("number_1", "encounter_id")


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packed_corpus(table(spark, sf, "documents"), table(spark, sf, "pack_capacity"))


def p7_used(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return utilisation(p7_packed(spark, sf))


def p7_whole(spark: SparkSession, sf: str) -> DataFrame:
    """What must be none per capacity: overfull containers, documents not wholly in, whole ones that were split, wrong positions."""
    documents = table(spark, sf, "documents")
    counts = stage(token_counts(spread(documents.select("doc_id", "text"), "doc_id")), "counts")
    packed = stage(pack_documents(counts, table(spark, sf, "pack_capacity")), "packed")
    size = F.col("capacity_tokens")
    per_container = packed.groupBy("capacity_tokens", "container").agg(F.sum("n_tokens").alias("held"), F.max(F.col("position") + F.col("n_tokens")).alias("end"))
    boxes = per_container.groupBy("capacity_tokens").agg(F.count_if(F.col("held") > size).alias("overfull"), F.count_if(F.col("end") != F.col("held")).alias("misplaced"))
    held = packed.groupBy("capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("held"), F.count(F.lit(1)).alias("parts"))
    met = held.join(counts, "doc_id").groupBy("capacity_tokens").agg(F.count_if(F.col("held") == F.col("n_tokens")).alias("whole"), F.count_if((F.col("n_tokens") <= size) & (F.col("parts") > 1)).alias("split"))
    texts = met.withColumn("lost", counts.agg(F.count(F.lit(1))).scalar() - F.col("whole"))
    return boxes.join(texts, "capacity_tokens").select("capacity_tokens", "overfull", "misplaced", "lost", "split")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"), LeakRules(window=12, max_edits=0, places=8)).select("doc_id", "item_id")


def p8_near(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a window up to two word edits from one of a passage."""
    return leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"), LeakRules(window=12, max_edits=2))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return document_subjects(table(spark, sf, "documents"), table(spark, sf, "subject_labels"), table(spark, sf, "subjects"))


def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and code points per subject; a document of several subjects counts in each."""
    found = p9_found(spark, sf)
    sizes = table(spark, sf, "documents").select("doc_id", "n_chars")
    return found.join(sizes, "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


QUERIES = {"p2_percentiles": p2_percentiles, "p2_merged_pieces": p2_merged_pieces, "p2_bounded": p2_bounded, "p2_within": p2_within, "p5_found": p5_found, "p6_found": p6_found, "p7_packed": p7_packed, "p7_used": p7_used, "p7_whole": p7_whole, "p8_found": p8_found, "p8_near": p8_near, "p9_found": p9_found, "p9_composition": p9_composition}

_ONCE = """WITH once AS (SELECT DISTINCT number_1, number_2, t_min_kepler_jd, bin_id,
  CASE WHEN NOT isnan(delta_dist_au) THEN delta_dist_au + 0.0 END AS v FROM refined)"""
_PERCENTILES = f"{_ONCE} SELECT bin_id, count(v) AS n, " + ", ".join(f"quantile_disc(v, {p}) AS {name}" for name, p in PROBS.items()) + " FROM once GROUP BY bin_id"

#: Compatibility forms as they occur in texts of this kind; DuckDB has no NFKC.
_WORDS = r"""regexp_extract_all(lower(nfc_normalize(replace(replace(replace(regexp_replace(regexp_replace({0},
  '[\x{{ad}}\x{{200b}}\x{{200c}}\x{{200d}}\x{{2060}}\x{{feff}}]', '', 'g'), '[-\x{{2010}}\x{{2011}}](\r\n|[\n\r\x{{b}}\x{{c}}\x{{85}}\x{{2028}}\x{{2029}}])', '', 'g'),
  'ﬁ', 'fi'), 'ﬂ', 'fl'), '³', '3'))), '[\p{{L}}\p{{N}}]+')"""
_GRAMS = "SELECT {0}, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT {0}, {1} AS w FROM {2} WHERE {3} IS NOT NULL), unnest(range(1, len(w) - 10)) AS u(i)"

SQL = {
    "p2_within": "SELECT bin_id, count(v) AS n, true AS within FROM (SELECT DISTINCT number_1, number_2, t_min_kepler_jd, bin_id, CASE WHEN NOT isnan(delta_dist_au) THEN delta_dist_au END AS v FROM refined) GROUP BY 1",
    "p7_whole": "SELECT DISTINCT capacity_tokens::BIGINT AS capacity_tokens, 0 AS overfull, 0 AS misplaced, 0 AS lost, 0 AS split FROM pack_capacity WHERE capacity_tokens > 0",
    "p8_found": f"WITH d AS ({_GRAMS.format('doc_id', _WORDS.format('text'), 'documents', 'text')}), p AS ({_GRAMS.format('item_id', _WORDS.format('passage'), 'eval_items', 'passage')}) SELECT DISTINCT doc_id, item_id FROM d JOIN p USING (g)",
    "p2_percentiles": _PERCENTILES,
    "p2_merged_pieces": _PERCENTILES,
    "p5_found": r"""
WITH parsed AS (
  SELECT recno, least(pert, targ) AS lo, greatest(pert, targ) AS hi, regexp_replace(event_date, '^\s+|\s+$', '', 'g') AS d
  FROM goffin_2014_encounters WHERE pert IS NOT NULL AND targ IS NOT NULL),
dated AS (
  SELECT recno, lo, hi, CASE
    WHEN regexp_full_match(d, '\d{4}-\d{2}-\d{2}') THEN julian(try_strptime(d, '%Y-%m-%d'))
    WHEN regexp_full_match(d, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}') THEN julian(try_strptime(d, '%Y-%m-%dT%H:%M'))
    WHEN regexp_full_match(d, '\d{4}\.\d+') THEN
      julian(make_timestamp(substr(d, 1, 4)::BIGINT, 1, 1, 0, 0, 0)) + ('0.' || substr(d, 6))::DOUBLE
      * (date_diff('day', make_date(substr(d, 1, 4)::BIGINT, 1, 1), make_date(substr(d, 1, 4)::BIGINT + 1, 1, 1)))
    END AS noon FROM parsed),
events AS (
  SELECT recno, lo, hi, noon - 0.5 + (32.184 + CASE WHEN noon - 0.5 >= 2457754.5 THEN 37 WHEN noon - 0.5 >= 2457204.5 THEN 36
    WHEN noon - 0.5 >= 2456109.5 THEN 35 WHEN noon - 0.5 >= 2454832.5 THEN 34 ELSE 33 END) / 86400 AS jd FROM dated),
records AS (
  SELECT DISTINCT encounter_id, least(number_1, number_2) AS lo, greatest(number_1, number_2) AS hi, jd_tdb
  FROM encounters_catalog WHERE number_1 IS NOT NULL AND number_2 IS NOT NULL),
ranked AS (
  SELECT recno, encounter_id, row_number() OVER (PARTITION BY recno ORDER BY abs(jd_tdb - jd), encounter_id) AS k
  FROM events JOIN records USING (lo, hi) WHERE abs(jd_tdb - jd) <= 31)
SELECT recno, encounter_id FROM ranked WHERE k = 1""",
    "p6_found": """
WITH once AS (
  SELECT DISTINCT number_1, encounter_id, dist_au, CASE WHEN NOT isnan(rel_vel_au_day) THEN rel_vel_au_day END AS speed
  FROM encounters_catalog WHERE dist_au IS NOT NULL AND NOT isnan(dist_au) AND number_1 IS NOT NULL)
SELECT number_1, encounter_id FROM once
QUALIFY row_number() OVER (PARTITION BY number_1 ORDER BY dist_au, speed DESC NULLS LAST, encounter_id) <= 3""",
}
