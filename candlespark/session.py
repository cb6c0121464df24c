"""Session defaults shared by the tests, the bench and the query catalogue."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


# Recording the call site of every column expression costs a few round trips
# to the JVM each, which adds up to seconds in wide reports.  Fixed at start.
CALL_SITES = "spark.python.sql.dataFrameDebugging.enabled"


#: Folders of local sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Set what results depend on: bar times are UTC wall-clock times."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cpus: int | str = 8, app: str = "candlespark") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config(CALL_SITES, "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Only a local session (tests, a laptop) that names no such folder gets one
    of its own.  Elsewhere executors on other machines could not read it, so
    the setting must be there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        # The setting belongs to Spark's core and can't be changed once a session runs.
        app = spark.sparkContext.applicationId
        root = _LOCAL.get(app) or _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """The file system of ``path`` and its handle there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a staged folder once nothing reads it any more."""
    fs, target = hadoop_path(spark, path)
    fs.delete(target, True)


def cut_lineage(df, name: str, partition_by: list[str] | None = None):
    """Write ``df`` to the shared folder and read it back.

    The written table survives the loss of executors and is scanned with
    column pruning by every later branch.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path, partitionBy=partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)
