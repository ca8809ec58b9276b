"""Written tables in the folder that a cluster's driver and executors share: they cut lineage, so a lost executor costs a read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only in local mode, where that is unset, a folder of the machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.startswith("local"):
        base = "file://" + tempfile.mkdtemp(prefix="tapeloom-")
        spark.sparkContext.setCheckpointDir(base)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of any file system, as far as the session still runs."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
        pass


class Written:
    """A table in the shared folder, and its removal once it isn't needed any more (or the application ends)."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, f"{shared_folder(df.sparkSession)}/tapeloom/{name}-{uuid.uuid4().hex}"
        atexit.register(remove, self.spark, self.path)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def written(df: DataFrame, name: str) -> DataFrame:
    return Written(df, name).df
