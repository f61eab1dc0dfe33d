"""Helpers of the operators: document keys, texts, ranks without a hot task. Steps are staged by staging.staged."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from orderflow.staging import staged, staged_last

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words between ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACED_WORD = r"[^\x20\x09-\x0D]+"

#: A rank bucket holds about this many rows, and a group has at most so many buckets.
ROWS_PER_BUCKET, MOST_BUCKETS = 256, 4096

__all__ = ["document_key", "exact_ids", "frame", "id_parts", "lowered", "ranked", "staged", "staged_last", "text_of"]


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells documents apart: the id and the text. As a struct it also joins where the id is null."""
    return F.struct(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"))


def id_parts(doc_id: Column | str = "doc_id") -> list[Column]:
    """An id on its way into Python: a number and whether there is none. A nullable one would come as a
    double wherever a null is among them, and doubles have no odd numbers beyond 2 ** 53."""
    value = F.col(f"`{doc_id}`") if isinstance(doc_id, str) else doc_id
    return [F.coalesce(value.cast("bigint"), F.lit(0)).alias("id"), value.isNull().alias("no_id")]


def exact_ids(batch: pd.DataFrame, rows: np.ndarray | slice = slice(None)) -> pd.arrays.IntegerArray:
    """The ids of id_parts, on their way back."""
    return pd.arrays.IntegerArray(batch["id"].to_numpy(np.int64)[rows], batch["no_id"].to_numpy(bool)[rows])


def lowered(value: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(value, UPPER, LOWER)


def frame(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def ranked(df: DataFrame, group: str, order: Sequence[str], rows: int, name: str = "rank") -> DataFrame:
    """Add the place of every row in its group, from 0 without gaps, in no more than bucket-sized sorts.

    A group is dealt out to buckets by a hash of the order columns; the sizes of the
    buckets give each one its first place. Rows that agree in all order columns may
    change places among themselves.
    """
    buckets = max(1, min(MOST_BUCKETS, -(-rows // ROWS_PER_BUCKET)))
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(
        F.col(group).alias("__group"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first")
    )
    inside = Window.partitionBy(group, "__bucket").orderBy(*order)
    placed = dealt.withColumn("__place", F.row_number().over(inside) - 1)
    joined = placed.join(firsts, (F.col(group) == F.col("__group")) & (F.col("__bucket") == F.col("__b")))
    return joined.withColumn(name, F.col("__first") + F.col("__place")).drop("__bucket", "__b", "__group", "__first", "__place")
