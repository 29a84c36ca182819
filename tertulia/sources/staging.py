"""Tables written once to the shared folder, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="tertulia-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder; cuts lineage.  Spark deletes them when nothing refers to them any more
    and ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder of this library."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Staged:
    """A DataFrame written once to the shared folder and read back.

    Cuts lineage and outlives lost executors; later stages read only the columns they need.
    Use as a context manager to delete the table afterwards.
    """

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.parquet(self.path)

    def __enter__(self) -> DataFrame:
        return self.df

    def __exit__(self, *exc) -> None:
        remove(self.spark, self.path)
