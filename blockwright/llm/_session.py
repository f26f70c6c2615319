"""What the operators need from a session: code on the executors, a shared folder."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever they run."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = Path(__file__).resolve().parents[2]
        target = Path(tempfile.mkdtemp()) / "blockwright.zip"
        with zipfile.ZipFile(target, "w") as z:
            for path in sorted((top / "blockwright").rglob("*.py")):
                z.write(path, path.relative_to(top))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark


def quoted(name: str) -> str:
    """A column's name as part of an expression, whatever its letters."""
    return "`" + name.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one where none is set and
    all executors are on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/blockwright-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Frames made inside lose their shuffle files as soon as an action on them has ended."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def checkpoint(frame: DataFrame) -> DataFrame:
    """Compute a frame once and cut its lineage, in the shared folder."""
    spark = frame.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    with shuffles_go(spark):
        return frame.select("*").checkpoint(eager=True)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new place in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(where.getParent())
    system.deleteOnExit(where)
    return path


def written(frame: DataFrame) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it again."""
    path = new_folder(frame.sparkSession, "blockwright")
    with shuffles_go(frame.sparkSession):
        frame.select("*").write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the checkpoints of frames that nobody holds any more, where
    it is told to; it does so when the driver's heap is collected, which may take long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
