"""Folders that driver and executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results that all executors share: spark.checkpoint.dir, or the checkpoint folder that the application has set.

    Only where neither is set and driver and executors are one process a private folder is made; on a cluster that is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    have = sc._jsc.sc().getCheckpointDir()
    if folder:
        if have.isEmpty():
            sc.setCheckpointDir(folder)
        return folder
    if have.isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="stratapack-"))
    return sc._jsc.sc().getCheckpointDir().get()


def mounted(folder: str) -> str:
    """A shared folder as a path for open(); it must be mounted where tasks run."""
    return folder.removeprefix("file:").replace("//", "/") if folder.startswith("file:") else folder


def cut(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared checkpoint folder, so that a lost executor costs a reread and plans stay short."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results, wherever Spark keeps it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def files_below(root: str) -> list[str]:
    """The files at and below a mounted path, sorted, without links and what jobs leave unfinished."""
    if os.path.isfile(root):
        return [root]
    return sorted(os.path.join(d, n) for d, _, names in os.walk(root) for n in names if not n.endswith(".part") and not os.path.islink(os.path.join(d, n)))


def spread(scan: DataFrame) -> DataFrame:
    """A table as it is scanned, for kernels that take much longer than an exchange: dealt evenly if it lies in fewer pieces than there are cores.

    A file's row group is read by one task, so a small table in one row group would keep one core busy.  Counting the tasks that have rows reads no column; larger tables are never shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    used = scan.select(F.spark_partition_id().alias("p")).distinct().limit(cores).count()
    return scan if used >= cores else scan.repartition(2 * cores)
