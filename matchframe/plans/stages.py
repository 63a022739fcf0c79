"""Cutting a plan where several later steps read the same heavy intermediate."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession

DIR_KEY = "spark.checkpoint.dir"
FREE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names.

    A local session without the setting uses a folder inside its warehouse; on a
    cluster the setting is required.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get(DIR_KEY, None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError(f"set {DIR_KEY} to a folder that all executors share")
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and read it from there afterwards.  Runs a job.

    The steps that follow do not recompute it, and a lost executor costs only
    the tasks since the last stage.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged_rdd(spark: SparkSession, rdd: RDD) -> RDD:
    """``staged`` for an RDD of Python values, which are read again as they were pickled, without a step through rows and Arrow."""
    checkpoint_dir(spark)
    rdd.checkpoint()
    # The method behind ``count()`` that writes the files, without the count.
    rdd._jrdd.rdd().doCheckpoint()
    return rdd


def unstage(old: DataFrame | RDD) -> None:
    """Delete the files of what ``staged`` or ``staged_rdd`` gave, once nothing is planned on it any more."""
    if isinstance(old, RDD):
        sc, place = old.context, old.getCheckpointFile()
    else:
        sc, found = old.sparkSession.sparkContext, old._jdf.queryExecution().logical().rdd().getCheckpointFile()
        place = found.get() if found.isDefined() else None
    if place is not None:
        path = sc._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs of tables that are planned in here delete their shuffle files when they end, not when the driver collects garbage."""
    before = spark.conf.get(FREE_KEY, None)
    spark.conf.set(FREE_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_KEY)
        else:
            spark.conf.set(FREE_KEY, before)
