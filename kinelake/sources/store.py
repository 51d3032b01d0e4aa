"""The recording store and reliable cut points of iterative jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session may leave it unset; it then uses a folder beside its warehouse. A cluster without the
    setting is an error, as executors would write to disks of their own.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def reliable(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint that survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path that does not exist yet, in a new folder under the shared one that is deleted when the application ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{folder}/data"


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """The rows, written once to scratch: for a small result of long steps that later steps read several times."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def discard(spark: SparkSession, path: str) -> None:
    """Remove what an unfinished job has left under ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_recordings(df: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Store recordings partitioned by task and group; a dry run writes nothing."""
    if not dry_run:
        df.write.mode("overwrite").partitionBy("task", "grp").parquet(path)
    return df


def read_recordings(spark: SparkSession, path: str, task: int | None = None, grp: str | None = None) -> DataFrame:
    """Read back with partition pruning on task and group."""
    df = spark.read.parquet(path)
    if task is not None:
        df = df.filter(df["task"] == task)
    if grp is not None:
        df = df.filter(df["grp"] == grp)
    return df
