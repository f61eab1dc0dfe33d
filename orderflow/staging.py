"""Tables kept between the steps of a run, in the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from orderflow import storage

#: The folders that the scope around a call has to drop.
_OWNED: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("owned", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors and the driver share.

    Where that is unset (tests, one machine), one is made and set; on a cluster a folder made here would be
    one machine's own, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


def new_folder(spark: SparkSession, folder: str | None = None) -> str:
    """The path of a new folder for a staged table, which the scope around the call will drop."""
    path = f"{folder or shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    owned = _OWNED.get()
    if owned is not None:
        owned.append((spark, path))
    return path


def staged(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows written once as parquet and read back: several readers share them, each
    reads only its columns, and a lost executor costs nothing of what went before.

    The folder is the caller's, or a new one inside the shared folder. The tables stay until the scope
    around the call ends (see staging_scope); without one they are the caller's to drop.
    """
    path = new_folder(df.sparkSession, folder)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Whether Spark deletes a query's shuffle files as soon as the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged_last(spark: SparkSession, steps: Callable[[], DataFrame]) -> DataFrame:
    """What the steps return, staged. What they staged on the way is dropped once it is written, and the shuffle files
    of each of their queries as soon as it has ended, so the disk never holds more than two steps that follow each other."""
    path, before = new_folder(spark), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        with staging_scope():
            df = steps()
            df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def staging_scope() -> Iterator[None]:
    """Drops, at its end, all tables that were staged inside, also after an error. What is to last is written before that.

        with staging_scope():
            run = run_full(pages, "tail", template, ["Quantity"], ["Qty"], stage=staged)
            write_merged(run.merged, table, path)
    """
    owned: list[tuple[SparkSession, str]] = []
    token = _OWNED.set(owned)
    try:
        yield
    finally:
        _OWNED.reset(token)
        for spark, path in owned:
            storage.drop(spark, path)
