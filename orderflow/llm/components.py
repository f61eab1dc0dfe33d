"""Connected components of a table of edges, by stars that alternate until nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import staged


def _stars(edges: DataFrame) -> DataFrame:
    """One round: every vertex hands its larger neighbours, then its smaller ones, the smallest it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "w")
    large = both.join(least, F.col("u") == F.col("w")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    lowest = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
    told = large.join(lowest, F.col("u") == F.col("w"))
    passed = told.select(F.explode(F.array(
        F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))
    )).alias("e")).select("e.u", "e.v")
    return passed.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """member and component (its smallest member) of all vertices but the smallest ones. edges: u, v of longs."""
    oriented = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = staged(oriented.where(F.col("u") > F.col("v")).distinct())
    mark = None
    while True:
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == tuple(row) or not row["n"]:
            return now.select(F.col("u").alias("member"), F.col("v").alias("component"))
        mark = tuple(row)
        now = staged(_stars(now))
