"""Row-local enrichment and running gates over files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearpass.functions.physics import clean
from nearpass.operators.catalog import MAJOR_BODIES
from nearpass.operators.characterize import characterize


def encounter_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:  # noqa: ANN001
    """A folder of Parquet files as they arrive; a single file is a stream of one."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        return reader.option("pathGlobFilter", target.getName()).parquet(str(target.getParent().toString()))
    return reader.parquet(path)


def characterize_stream(stream: DataFrame, elements: DataFrame, physical: DataFrame | None, out: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch, characterised, to a Parquet catalog; restarts resume from the checkpoint.

    Each batch id has its own folder that is overwritten, so a batch repeated after a failure
    doesn't double its rows.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        characterize(batch, elements, physical).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gate_stream(stream: DataFrame, name: str, checkpoint: str, bodies: tuple[int, ...] = MAJOR_BODIES) -> StreamingQuery:
    """Running count and nearest distance of the required bodies (state: a row per body)."""
    both = stream.select(F.explode(F.array("number_1", "number_2")).alias("number"), clean(F.col("dist_au")).alias("d")).where(F.col("number").isin(*bodies))
    gate = both.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("nearest_au"))
    return gate.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_stream(stream: DataFrame, key: str, ts: str, gap: str = "14 minutes 24 seconds", late: str = "1 hour") -> DataFrame:
    """Gap sessions of a stream; readings later than ``late`` behind the newest are dropped."""
    return stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, "w.start", "w.end", "n")
