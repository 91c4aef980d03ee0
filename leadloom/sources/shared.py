"""Intermediate data in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only on a local master (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="leadloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _deleted_at_exit(spark: SparkSession, path: str) -> None:
    """The driver's file system deletes the folder when it ends, if nothing did before."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage. The copy goes with the driver, or earlier, when nothing refers to it,
    where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
        _deleted_at_exit(spark, spark.sparkContext.getCheckpointDir())
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, which goes with the driver."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    _deleted_at_exit(spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back; it goes by `forget`, or with the driver."""
    spark = df.sparkSession
    path = f"{scratch(spark, name)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """For a side of a join that grows with the input: never broadcast by the size of its compressed
    files, which goes through the driver's memory; sorted and merged."""
    return df.hint("merge")


def forget(df: DataFrame) -> None:
    """Delete what `written` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
