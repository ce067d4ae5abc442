"""Tables in a folder that driver and executors share."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Where the session names none, a local session gets one under /tmp; on a cluster that
    raises, as a folder of one machine would be seen by its executors alone.
    """
    found = spark.conf.get(_FOLDER, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_FOLDER} must name a folder that driver and executors share")
        found = "file:///tmp/stroma-checkpoints"
        spark.conf.set(_FOLDER, found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, a folder for each value of ``by``, and read it back.

    This cuts the lineage, and a lost executor loses none of it. The table is deleted by
    ``discard``, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    read = spark.read.schema(df.schema).parquet(path)
    read._stroma_path = path
    return read


def new_folder(spark: SparkSession, name: str) -> str:
    """The address of a folder in the shared folder that nothing uses yet, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target)
    system.deleteOnExit(target)
    return path


def discard(df: DataFrame | None) -> None:
    """Delete a table that ``materialise`` wrote, once nothing that is still to run reads it."""
    path = getattr(df, "_stroma_path", None)
    if path:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package, once a Spark context, where it isn't installed there.

    The package goes as a zip into the shared folder, from where Spark hands it out. A
    package that itself lies in a zip was shipped already.
    """
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_stroma_shipped", False) or not root.is_dir():
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    path = f"{shared_folder(spark)}/stroma-{uuid.uuid4().hex}.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(target)
    out.write(bytearray(packed.getvalue()))
    out.close()
    system.deleteOnExit(target)
    context.addPyFile(path)
    context._stroma_shipped = True
