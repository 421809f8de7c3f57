"""Session settings, table access and the two ways this package cuts or bounds work.

``stage`` cuts lineage by writing a table into the folder all executors share;
``broadcast_if_small`` is the only place that asks for a broadcast, and only after counting.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a dimension may be broadcast after it has been counted.
BROADCAST_ROWS = 200_000
#: Bytes up to which it may be, a text counted as 64.
BROADCAST_BYTES = 32 << 20
_WIDE = ("string", "binary")
#: Paths of the stages that are there.
_STAGED: list[str] = []


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow; cluster settings win over these where given."""
    builder = (
        SparkSession.builder.master(master)
        .appName("nearpass")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, wherever the driver was started.

    Spark distributes the archive itself; it is made once per context.
    """
    context = spark.sparkContext
    if not getattr(context, "_nearpass_shipped", False):
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="nearpass-")) / "nearpass.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, file.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._nearpass_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only if unset in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    current = getattr(spark, "_nearpass_stage_root", None)
    if current is None:
        current = f"file://{tempfile.mkdtemp(prefix='nearpass-')}"
        spark._nearpass_stage_root = current
    return current


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for steps whose cost is not in their bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Unlike ``checkpoint()`` the plan runs once, and unlike ``localCheckpoint`` the
    files outlive any executor. The folder is removed when the driver exits.
    """
    spark = df.sparkSession
    path = stage_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver exits."""
    path = f"{checkpoint_root(spark)}/nearpass/{label}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    atexit.register(_remove, spark, path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Stages made inside are removed at its end, and shuffle files of plans that are gone.

    Nothing lazy may still read them then.
    """
    before = len(_STAGED)
    try:
        yield
    finally:
        for path in _STAGED[before:]:
            _remove(spark, path)
        del _STAGED[before:]
        gc.collect()  # shuffle files stay until the driver's garbage is collected
        spark._jvm.System.gc()


def hadoop_path(spark: SparkSession, path: str) -> tuple[object, object]:
    """The file system of a path, whichever it is, and the path in it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file beside the data, on the data's file system; an old one is replaced."""
    system, target = hadoop_path(spark, path)
    stream = system.create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, sorted; none if nothing does."""
    system, target = hadoop_path(spark, pattern)
    return sorted(s.getPath().toString() for s in system.globStatus(target) or [])


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and, by the width of its columns, ``BROADCAST_BYTES``."""
    width = sum(f.dataType.jsonValue() in _WIDE and 64 or 16 for f in df.schema.fields) + 16
    most = max(1, min(max_rows, BROADCAST_BYTES // width))
    return df.limit(most + 1).count() <= most


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a frame that ``is_small``; else leave the join to AQE."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows whose cost is not in their bytes, if a scan has few partitions.

    A table that already comes in at least as many partitions as the session shuffles into
    is left where it is, so a large corpus is not moved; nor is the result of a shuffle, whose
    partitions can't be counted without running it.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        return df
    wanted = shuffle_partitions(df.sparkSession)
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= wanted else df.repartition(wanted, *keys)
