"""Session settings and the lineage cut used by iterative operators."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job wants whatever the cluster size. Partition counts are left
# to AQE: it coalesces small shuffles and splits skewed join partitions.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Many operators here cost computing rather than bytes (polygon tests, folds, matrix
    # products), so small shuffles keep one partition per core instead of one megabyte each.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
}


def builder(app: str = "waymark", master: str | None = None, **extra: str) -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        b = b.config(key, value)
    return b


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = builder(
        master=f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": str(partitions),
            "spark.driver.memory": memory,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; fall back to a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="waymark-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path object for ``path``, whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder, deleted when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, at = filesystem(spark, path)
    fs.deleteOnExit(at)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    A lost executor then never replays a loop, and unlike a bare checkpoint the table has
    a known size, so Spark can still broadcast it when it is small.
    """
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Partitions for a stage that must not be merged by size."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per context, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_waymark_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="waymark-package-"), "waymark")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "waymark"))
    sc._waymark_shipped = True


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
