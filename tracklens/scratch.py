"""Tables and files of a run: they lie in the folder that driver and executors share.

A run has one folder of its own there, so that clear() can drop all it has written.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset a local session, whose executors are the driver, takes a
    temporary folder; on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = getattr(spark, "_tracklens_folder", None)
        if folder is None:
            folder = "file://" + tempfile.mkdtemp(prefix="tracklens-")
            spark._tracklens_folder = folder
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """This session's own folder within the shared one."""
    own = getattr(spark, "_tracklens_run", None)
    if own is None:
        own = spark._tracklens_run = f"{shared_folder(spark)}/tracklens-{uuid.uuid4().hex}"
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether Spark drops what a query has shuffled once it has ended.
_DROPS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What queries shuffle meanwhile goes from the executors' disks with each query's end, not whenever the driver collects its garbage."""
    before = spark.conf.get(_DROPS)
    spark.conf.set(_DROPS, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROPS, before)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors. What the write has shuffled is dropped."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) as Hadoop's own objects, for what the driver does with single files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def drop(spark: SparkSession, folder: str) -> None:
    fs, path = hadoop_path(spark, folder)
    fs.delete(path, True)


@contextlib.contextmanager
def folder_of_its_own(spark: SparkSession) -> Iterator[str]:
    """What is staged meanwhile lies in a folder within the run's, which can be dropped before the run's end."""
    outer = run_folder(spark)
    own = spark._tracklens_run = f"{outer}/part-{uuid.uuid4().hex}"
    try:
        yield own
    finally:
        spark._tracklens_run = outer


def clear(spark: SparkSession) -> None:
    """Drop all that this session has staged, once its results are written elsewhere: tables read from it are gone."""
    own = getattr(spark, "_tracklens_run", None)
    if own is not None:
        drop(spark, own)
        spark._tracklens_run = None
