"""Tables that cut a lineage: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
ROWS_A_FILE = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on a local master without it, a temporary one.

    A cluster without the setting is an error: an executor's own folder is not seen by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="pixelspark-"))
    return folder.rstrip("/")


class Scratch:
    """Writes intermediate tables and forgets them again.

    A table is a directory of committed Parquet files, so a lost executor costs at most its
    running tasks.  ``drop`` removes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def keep(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """The table as written and read again; with an estimate of its rows, dealt into few files if it is small."""
        path = f"{self.root}/{self.n}"
        self.n += 1
        if rows is not None:
            df = df.repartition(max(1, -(-rows // ROWS_A_FILE)))
        df.write.parquet(path)
        if self.n == 1:  # goes when the driver ends
            root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            root.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)

    def forget(self) -> None:
        """Lets Spark's cleaner delete the shuffles of what has been written: it acts when the driver collects garbage."""
        self.spark._jvm.System.gc()
