"""Writers. Nothing is overwritten unless asked for."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from orderflow.operators import merge as M
from orderflow.operators.quality import Validated
from orderflow.operators.template import apply_to_table
from orderflow.sources.publish import publishing


def write_clean(result: Validated, path: str, mode: str = "errorifexists") -> None:
    """All rows with their reasons once, and from them the clean rows, the rows set aside and the flags, as tables."""
    result.checked.write.mode(mode).parquet(f"{path}/checked")
    kept = result.derive(result.checked.sparkSession.read.schema(result.checked.schema).parquet(f"{path}/checked"))
    kept.clean.write.mode(mode).parquet(f"{path}/clean")
    kept.rejects.write.mode(mode).parquet(f"{path}/rejects")
    kept.flags.write.mode(mode).parquet(f"{path}/flags")


def write_merged(
    merged: M.Merged, table: Callable[[DataFrame], DataFrame], path: str, order: Sequence[str] = ("line_seq",),
    stats: DataFrame | None = None,
) -> dict:
    """Publish the tables updates, merged, changes and stats under path, all or none (see publish.read_published).

    The updates are written once; the totals are observed while that goes on, so that the gate needs no look at
    what was written. If no line matched, the gate's error leaves nothing behind. The other tables are made
    of the written updates: merged by table, which makes the merged template of the final cells (see
    apply_to_table), and the statistics per document. stats of the whole run take their place; then the error of the gate tells
    what was extracted too. Returns the totals.
    """
    spark = merged.updates.sparkSession
    with publishing(spark, path) as run:
        seen = Observation()
        counts = [c.alias(n) for n, c in M.stat_counts().items()]
        updates = run.write("updates", merged.updates.observe(seen, *counts))
        totals = {n: seen.get.get(n) or 0 for n in M.STAT_COUNTS}
        if stats is not None:
            totals = M.total_stats(stats) | totals
        M.check_matched(totals)
        final = M.final_cells(updates, order, per_document=merged.per_document)
        run.write("merged", table(final))
        run.write("changes", M.changes(updates))
        run.write("stats", stats if stats is not None else M.merge_stats(updates, merged.plan))
    return totals


#: The column that a template is partitioned by, and the rows of a partition.
ROWS, ROWS_PER_PART = "row_range", 1_000_000


def _range(row: Column, rows: int) -> Column:
    return F.floor(row.cast("bigint") / rows).alias(ROWS)


def write_template(df: DataFrame, path: str, row: str, rows: int = ROWS_PER_PART, mode: str = "errorifexists") -> None:
    """A wide template in partitions of so many row numbers, which update_template can replace one by one."""
    ranged = df.withColumn(ROWS, _range(F.col(row), rows))
    ranged.repartition(ROWS).write.partitionBy(ROWS).mode(mode).parquet(path)


def update_template(final: DataFrame, path: str, row: str, positions: dict[str, int], rows: int = ROWS_PER_PART) -> None:
    """Put final cells into a written template (see write_template): only partitions with a changed row are read and replaced.

    The template is one that all documents share, with its target columns as text; rows as it was written. A final cell
    whose row the template does not have changes nothing.
    """
    spark = final.sparkSession
    stored = spark.read.parquet(path)
    columns = [c for c in stored.columns if c != ROWS]
    touched = final.select(_range(F.col("row_idx"), rows).alias("__range")).distinct()
    # the join prunes partitions as it runs; the tables joined are the ranges touched and the stored rows
    old = stored.join(touched, F.col(ROWS) == F.col("__range"), "left_semi").select(*columns)
    new = apply_to_table(old, row, positions, final).withColumn(ROWS, _range(F.col(row), rows))
    new.repartition(ROWS).write.partitionBy(ROWS).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
