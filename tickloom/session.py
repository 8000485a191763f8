"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# For sessions made here (tests, benchmark). A session that the caller brings is never changed:
# plans work with any settings, and best with Spark's defaults.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tickloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.codegen.cache.maxEntries", "2000")  # wide plans generate hundreds of classes
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture per column
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where the cluster names none (a local test session) a temporary folder is
    made and set, so checkpoints and stream tables work there as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = os.path.join(tempfile.mkdtemp(prefix="tickloom-"), "shared")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one job's tables."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step", reader: SparkSession | None = None) -> DataFrame:
    """The rows written once as a columnar table in the shared folder, and read back (by another session, if one is given).

    For results that several branches of a plan use: the costly scan below runs once,
    later branches prune columns, and the rows survive the loss of executors. The file
    sizes also tell the planner how large the table really is.
    """
    spark = df.sparkSession
    folder = work_folder(spark, name)
    df.write.parquet(folder)
    return (reader or spark).read.schema(df.schema).parquet(folder)
