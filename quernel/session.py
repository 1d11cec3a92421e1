"""Session helpers shared by every operator: input tables, the folder all
executors share, and cutting lineage there."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset and
    driver and executors are one machine (master local[...], as in tests) an
    own folder is made and set for the session, and goes with it; on any other
    master the setting is asked for.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quernel-")
        spark.sparkContext.setCheckpointDir(found)
        forget_at_end(spark, found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path for a written table in the shared folder, never used before."""
    return f"{shared_dir(spark)}/quernel-{label}-{uuid.uuid4().hex}"


def forget_at_end(spark: SparkSession, path: str) -> None:
    """Delete a path when the session's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def still_there(spark: SparkSession, path: str) -> bool:
    """Whether a written path has not been deleted since."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a written table in the shared folder, so that the
    loss of an executor costs no recomputation of what came before. The table
    goes when the session's JVM ends."""
    spark = df.sparkSession
    path = new_path(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    forget_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def reader_partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle as the session is set to size them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Give the executors this package, for operators with Python workers."""
    context = spark.sparkContext
    if getattr(context, "_quernel_shipped", False):
        return
    here = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="quernel-code-")) / "quernel.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as packed:
        for source in sorted(here.rglob("*.py")):
            packed.write(source, source.relative_to(here.parent))
    context.addPyFile(str(at))
    context._quernel_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for work that is heavy by row, where its files are too few and too small to be read by all of them."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    read = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    few = 0 < len(df._jdf.inputFiles()) < cores and size < cores * read
    return df.repartition(cores) if few else df
