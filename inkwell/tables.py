"""Tables that a plan writes and reads again, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that a folder of this machine serves all of them."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


@cache
def _temporary() -> str:
    """A folder of this machine, for as long as this process lives."""
    path = tempfile.mkdtemp(prefix="inkwell-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Without that setting a temporary folder serves in local mode; on a cluster it is an error. A running session's setting can't be
    changed, so the temporary folder is remembered here.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not local(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (root or _temporary()).rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows in place of Spark's 10,000, unless the session has another number, and of at most 8 MB: rows hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: what it holds is fixed from then on."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt over the session's tasks by the columns: rows of few bytes that cost much would else be read by as few tasks as their bytes fill."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def dropped(df: DataFrame) -> None:
    """Removes a table of kept() that no later plan reads."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.kept_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
