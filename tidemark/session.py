"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job of the library relies on. They are all session
# level, so `prepare` may apply them to a session somebody else built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app: str = "tidemark", cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session; a cluster without a shared folder fails here, not in a job."""
    shared_dir(spark)
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, taken from `spark.checkpoint.dir`.

    Where the setting is missing, only a local master may fall back to a folder
    on this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is not None:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    return _local_dirs[context.applicationId]


_written: dict[str, list[str]] = {}


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; `release_work` frees it."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex[:12]}")
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release_work(spark: SparkSession) -> int:
    """Delete what this application put under work paths; call it when the results are no longer needed."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts lineage between rounds of an iterative job; a lost executor never
    forces more than the current round to be computed again.
    """
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
