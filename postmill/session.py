"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Stands in for the shared folder in local sessions (tests, benchmarks).
LOCAL_ROOT = os.path.join(tempfile.gettempdir(), "postmill-local")


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "postmill") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, use the cluster's own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.minPartitionNum", str(shuffle_partitions))
        .config("spark.sql.files.openCostInBytes", "65536")
        .config("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session, where all tasks share one disk, may go without."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return LOCAL_ROOT


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``shared_root``. It is deleted when the session's JVM ends."""
    path = f"{shared_root(spark)}/postmill-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    _deleted_at_end(spark, path)
    return path


def _deleted_at_end(spark: SparkSession, path: str) -> None:
    """Have the session's JVM delete a folder of its own when it ends. Asking again does no harm."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: no lineage, so a lost executor costs no recomputation.

    Spark gives each application a checkpoint folder of its own, which goes when its JVM ends.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    _deleted_at_end(df.sparkSession, context.getCheckpointDir())
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to a folder of its own under ``shared_root`` and read from there.

    Like ``durable``, but compressed, and later steps read only the columns they use. Partitions are not kept.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A fixed table of our own. Spark plans it as a local relation, so its size is known to every join."""
    return spark.createDataFrame(pa.table({c: [r[i] for r in rows] for i, c in enumerate(columns)}))
