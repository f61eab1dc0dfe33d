"""Results that readers see whole or not at all.

A run writes its tables into a folder of its own, path/runs/<run>. When all of them are
written, one small file in path/published names the run; the last of these files tells readers
where to look. So a run that fails on the way, or that its gate stops, changes nothing
that anybody reads, can be repeated under the same path, and readers never mix the tables of two runs.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from orderflow import storage

RUNS, PUBLISHED = "runs", "published"


class NothingPublishedError(LookupError):
    """No run has been published under this path."""


class PublishedMeanwhileError(RuntimeError):
    """Another run was published since this one began."""


@dataclass
class Run:
    """Where a run writes its tables, and what was published when it began."""

    spark: SparkSession
    path: str
    name: str
    after: int

    def folder(self, table: str) -> str:
        return f"{self.path}/{RUNS}/{self.name}/{table}"

    def write(self, table: str, df: DataFrame) -> DataFrame:
        """Write a table of the run; returns what was written."""
        df.write.parquet(self.folder(table))
        return self.spark.read.schema(df.schema).parquet(self.folder(table))


def _last(spark: SparkSession, path: str) -> int:
    return max((int(n) for n in storage.names(spark, f"{path}/{PUBLISHED}") if n.isdigit()), default=0)


@contextlib.contextmanager
def publishing(spark: SparkSession, path: str) -> Iterator[Run]:
    """A run under path: published when the block ends, dropped when an error leaves it.

    Of two runs at the same time the first to end is published; the other one fails and is dropped.
    """
    run = Run(spark, path, uuid.uuid4().hex, _last(spark, path))
    try:
        yield run
        if not storage.create(spark, f"{path}/{PUBLISHED}/{run.after + 1:012d}", run.name):
            raise PublishedMeanwhileError(f"another run was published under {path}")
    except BaseException:
        storage.drop(spark, f"{path}/{RUNS}/{run.name}")
        raise


def published_run(spark: SparkSession, path: str) -> str:
    """The name of the run that readers follow."""
    last = _last(spark, path)
    if not last:
        raise NothingPublishedError(f"nothing is published under {path}")
    return storage.text(spark, f"{path}/{PUBLISHED}/{last:012d}")


def read_published(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the run published last."""
    return spark.read.parquet(f"{path}/{RUNS}/{published_run(spark, path)}/{table}")


def drop_unpublished(spark: SparkSession, path: str) -> list[str]:
    """Drop the folders of all runs but the published one: what crashed drivers and earlier runs left. Not while a run is under way."""
    keep = published_run(spark, path)
    gone = [n for n in storage.names(spark, f"{path}/{RUNS}") if n != keep]
    for name in gone:
        storage.drop(spark, f"{path}/{RUNS}/{name}")
    return gone
