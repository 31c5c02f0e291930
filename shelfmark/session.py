"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Joins on content hashes meet keys that a large part of all rows shares.  The adaptive planner cuts such a partition
# into several tasks; the force flag lets it do so where that costs one more shuffle afterwards.
_RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows beyond the first n of a group are dropped before the shuffle as long as n is below this.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # Half of a table of file cards are hex digits, which the default codec leaves as they are.
    "spark.sql.parquet.compression.codec": "zstd",
    # Packed shuffle bytes of a task; hashed or sorted they take up about twenty times as much.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32MB",
    "spark.sql.session.timeZone": "UTC",
    # Rows that met by folder stay where they are when ids within the folder meet next.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}
# Shuffles start with that many partitions, which the adaptive planner merges up to its advised size.  With the
# session's number alone, often one per core, what a task sorts or groups in memory grows with the input.
_SHUFFLE_PARTITIONS = 480
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators count on; a number of first partitions that the session brings stays."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    if spark.conf.get(_INITIAL, None) is None:
        spark.conf.set(_INITIAL, str(max(_SHUFFLE_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return spark


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own and calls ``tune``."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shelfmark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def task_count(spark: SparkSession) -> int:
    """Number of tasks for rows that are few and small but cost much each.

    A repartition without a number would be merged back into one task, since its rows take up few bytes.
    """
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared folder that the session's ``spark.checkpoint.dir`` names.

    Where none is named, a temporary folder serves a ``local[..]`` master, whose tasks share the driver's disk; on a
    cluster that would scatter the files over the executors, so it is an error.  The caller owns what lies there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="shelfmark-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_once(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write Parquet files.  The shuffles on the way have no other reader, so they go with the write, not some time later."""
    spark = df.sparkSession
    cleans = spark.conf.get(_CLEANS, "false")
    spark.conf.set(_CLEANS, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        spark.conf.set(_CLEANS, cleans)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Remove a folder on whatever file system it lies; one that is not there is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
