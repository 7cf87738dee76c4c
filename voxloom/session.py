"""Session set-up and the shared folder for iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_steps: list[str] = []


def get_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; on a cluster leave master and partitions unset."""
    builder = SparkSession.builder.appName("voxloom").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; below a local folder only where the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # tests and single machines
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="voxloom-"))
        base = f"file://{_own[0]}"
    _steps.append(f"{base.rstrip('/')}/step-{uuid.uuid4().hex}")
    return _steps[-1]


def settled(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder: cuts lineage, survives lost executors; a write that fails leaves nothing."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    try:
        df.write.parquet(path)
    except BaseException:
        remove(spark, path)
        raise
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete every step and file that this process has put below the shared folder; for the end of a job, when its results are written."""
    while _steps:
        remove(spark, _steps.pop())
