"""Lineage cuts in the folder that all executors share, and a size check for broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with more rows than this is never hinted for broadcast; the join then shuffles.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, a folder of our own if the session runs on one machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gritsieve-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Stored:
    """A table written to the shared folder and read back: its lineage ends at the files, which outlive any executor.

    The files go with :meth:`drop`, and at the latest when the application ends.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/t-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        files, path = self._files()
        files.deleteOnExit(path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def drop(self) -> None:
        """Remove the files; call it once nothing reads them any more."""
        files, path = self._files()
        files.delete(path, True)
        files.cancelDeleteOnExit(path)


def stored(df: DataFrame) -> DataFrame:
    return Stored(df).df


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are few, else as it is (the planner then shuffles both sides)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
