"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only on a local master without it, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="pixelspark-"))
    return folder.rstrip("/")


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder and read again; it goes when the driver ends.

    A written table is computed once, and a lost executor costs its running tasks.
    """
    spark = df.sparkSession
    name = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex[:16]}"
    df.write.parquet(name)
    path, files = _path(spark, name)
    files.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(name)
    out._cut = name
    return out


def drop(df: DataFrame) -> None:
    """Deletes the table of a :func:`cut` that no later step reads; other relations are left alone."""
    name = df.__dict__.get("_cut")
    if name:
        path, files = _path(df.sparkSession, name)
        files.delete(path, True)
