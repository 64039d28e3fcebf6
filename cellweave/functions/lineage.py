"""Cutting lineage: results written to a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which all executors share.

    Only on a local master, as in tests, a temporary folder is used where that is unset; elsewhere
    that is an error, since executors could not read each other's files.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        folder = sc.getCheckpointDir()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint `df` and go on from there."""
    scratch_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as a table to the same folder and read it again.

    Unlike after a checkpoint, nothing that the optimizer has inferred about the rows goes along;
    over many rounds of a loop that would grow beyond all bounds.
    """
    path = f"{scratch_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Turns:
    """The table of a loop's latest round; the one before it is deleted once the next is complete."""

    def __init__(self) -> None:
        self.path: str | None = None

    def store(self, df: DataFrame) -> DataFrame:
        spark, last = df.sparkSession, self.path
        self.path = f"{scratch_folder(spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        if last:
            drop_folder(spark, last)
        return spark.read.schema(df.schema).parquet(self.path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that is no longer read, in whatever file system it is."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
