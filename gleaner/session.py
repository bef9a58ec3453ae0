"""Session helpers: a tuned local session for tests, and durable staging.

Intermediate results that several jobs read are written as Parquet below the shared
folder named by ``spark.checkpoint.dir``: an executor that dies takes nothing with it,
and later passes read only the columns they need.
"""

from __future__ import annotations

import math
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, and bound their batches.

    Not needed where every executor has it installed or ``--py-files`` names it.
    """
    application = spark.sparkContext.applicationId
    bounded_batches(spark)
    if application in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='gleaner-')}/gleaner", "zip", package.parent, package.name
    )
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Send 8 MB at a time to the Python workers, unless the session sets another bound.

    Spark's own bound is 64 MB; an executor holds a batch several times over, in each of its
    workers and in the JVM.
    """
    if spark.conf.get(_BATCH_BYTES, "67108864b") == "67108864b":
        spark.conf.set(_BATCH_BYTES, "8m")


def local_session(cores: str = "8", app: str = "gleaner") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder.

    ``spark.checkpoint.dir`` (or a directory already set on the context) wins. Only a
    local master may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-"))
    return context.getCheckpointDir().rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make sure the context has a checkpoint folder, for iterative fits."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/gleaner/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in the part of this application."""
    return f"{_scratch(spark)}/{uuid.uuid4().hex}/{name}"


def remove_staged(spark: SparkSession) -> bool:
    """Remove all that this application staged; true if there was something.

    For the end of a job: DataFrames that read staged rows, results that have not been
    written among them, cannot be used afterwards.
    """
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    return path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table that was read in fewer pieces than there are cores.

    Large tables come in many pieces and stay as they are, without a shuffle. Meant for
    plain scans: asking for the number of partitions would run the stages of a join.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def packed(df: DataFrame, work: float, work_per_task: float) -> DataFrame:
    """A cached table in as many partitions as its work asks for, never more than it has.

    Iterative fits run a job per step: on a few thousand labels, tasks cost more than the
    arithmetic in them. ``work`` and ``work_per_task`` share any unit.
    """
    return df.coalesce(max(1, math.ceil(work / work_per_task)))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
