"""Session helpers shared by every part of the library."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "weftline", cpus: str = "*", partitions: int | None = None) -> SparkSession:
    """A local session with the settings that the library expects; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once for each session, so that Python workers can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_weftline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="weftline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, f"weftline-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, f"weftline/{file.relative_to(root)}")
    context.addPyFile(archive)
    context._weftline_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without that setting."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftline-checkpoint-"))
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and losing executors loses nothing.

    The files go when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/weftline-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
