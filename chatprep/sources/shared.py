"""Folders all executors can reach, and the intermediate tables kept there."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`, or the context's checkpoint folder.

    There is no other choice: a folder of one machine would serve tests and lose data on a
    cluster.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path (not created) under the shared folder, removed by `release`."""
    path = f"{shared_dir(spark).rstrip('/')}/chatprep/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def pinned(df: DataFrame) -> DataFrame:
    """The frame written once to the shared folder, so later passes see the same rows.

    Survives lost executors, unlike blocks kept on them. Spark removes it with its last
    reference if `spark.cleaner.referenceTracking.cleanCheckpoints` is set.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: several passes, columns still pruned."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def let_go(df: DataFrame) -> None:
    """Removes a table that `stored` made, before its block ends; frames that read it are of no use afterwards."""
    spark = df.sparkSession
    folders = {file.rpartition("/")[0].rpartition("/")[2] for file in df.inputFiles()}
    made = _made.get(spark.sparkContext.applicationId, [])
    for path in [p for p in made if p.rpartition("/")[2] in folders]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Removes the tables made so far, but for the first `keep`; frames that read them are of no use afterwards."""
    paths = _made.get(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths[keep:]:
        where = hadoop(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    del paths[keep:]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end, the tables made inside; write or collect results before."""
    before = len(_made.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, keep=before)


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends: tables are written once and read as tables from then on."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Queries that run inside send at most `n` rows at a time to Python: for large rows, of which both sides hold whole batches."""
    before = spark.conf.get(_ARROW_ROWS)
    if int(before) <= 0 or int(before) > n:
        spark.conf.set(_ARROW_ROWS, str(n))
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, before)
