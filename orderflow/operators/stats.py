"""Statistics of whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.operators.merge import STAT_COUNTS, MergePlan

RUN_COUNTS = ["rows_extracted", "rows_removed", "cells_flagged"]


def run_stats(extracted: DataFrame, rejects: DataFrame, flags: DataFrame, merged: DataFrame, plan: MergePlan) -> DataFrame:
    """Per document: rows found, rows set aside, cells flagged, the merge's counts, and
    what the merge could not do: target columns it did not find, packing it had to leave out.

    Every part is counted on its own and the counts are added up in one aggregate, so no
    row-level join is needed and a document missing in a part counts 0 there.
    """
    one = F.lit(1).cast("bigint")
    parts = [
        extracted.select("doc_id", one.alias("rows_extracted")),
        rejects.select("doc_id", one.alias("rows_removed")),
        flags.select("doc_id", one.alias("cells_flagged")),
        merged.select("doc_id", *STAT_COUNTS),
    ]
    columns = [*RUN_COUNTS, *STAT_COUNTS]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    counts = rows.groupBy("doc_id").agg(*[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in columns])
    return counts.withColumns({
        "missing_columns": F.array(*[F.lit(c) for c in plan.missing_columns]).cast("array<string>"),
        "qty_recalc_disabled": F.lit(plan.packing_disabled),
    })
