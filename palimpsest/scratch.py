"""What jobs keep for a while: checkpoints and folders that driver and executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; where none is named, one in the warehouse, which driver and executors share too."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", "") or f"{spark.conf.get('spark.sql.warehouse.dir')}/_palimpsest")
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, which cuts the plan; it outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def scratch_folder(spark: SparkSession, prefix: str) -> str:
    """The name of a new folder in the shared one."""
    return f"{shared_folder(spark)}/{scratch_name(prefix)}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever store it is."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files and checkpoints that nothing refers to any more. It learns of them by garbage collection only, and a driver of little work collects seldom."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
