"""Session helpers of the engine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one where none is set and
    all executors are on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/blockwright-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new place in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(where.getParent())
    system.deleteOnExit(where)
    return path


def checkpoint(frame: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder that the cluster names."""
    spark = frame.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return frame.checkpoint(eager=True)
