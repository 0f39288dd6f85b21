"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset: a temporary folder if all of Spark runs on this machine, else one in the warehouse, with a warning.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = made.get() if made.isDefined() else None
    if not found:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            found = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quire"
            warnings.warn(f"spark.checkpoint.dir is unset; intermediate tables go to {found}, which all executors must share", stacklevel=2)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables of one operator run, written once to the shared folder, so that a lost executor costs no recomputation.

    ``drop`` removes those that a later table replaces; the rest goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(self.path(name)), True)

    def clear(self) -> None:
        self._fs.delete(self._path(self.root), True)
