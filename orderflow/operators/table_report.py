"""Report over tables of any layouts: what the check of each file would set aside and mark.

Which columns hold quantity, price and amount is told by the headers of a file, so it is a
value of its rows like any other, and one scan checks all files, whatever their layouts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions import text as X
from orderflow.operators.columns import add_numbers
from orderflow.operators.quality import ROLES, SUSPICIOUS_CHARACTERS, TOTAL_MISMATCH, total_differs
from orderflow.operators.template import lookup_value
from orderflow.plans.registry import classify_layouts

OK, NO_ROWS, DUPLICATE_HEADER = "ok", "no_rows", "duplicate_header"


def with_rules(tables: DataFrame) -> DataFrame:
    """Add layout, columns_ok and, per role, the name of its column (as from registry.classify_layouts) and its place, null where the file has none."""
    named = classify_layouts(tables)
    return named.withColumns({f"{role}_at": F.nullif(F.array_position("headers", F.col(f"{role}_column")), F.lit(0)) for role in ROLES})


def _cell(at: str) -> Column:
    return F.get("cells", (F.col(at) - 1).cast("int"))


def _marks() -> Column:
    """column and reason of every mark of a row that is kept."""
    mark = lambda column, reason: F.struct(column.alias("column"), F.lit(reason).alias("reason"))
    none = F.array().cast("array<struct<column:string,reason:string>>")
    wrong = total_differs(*[F.col(f"{role}_num") for role in ROLES])
    totals = F.when(wrong, F.array(*[mark(F.col(f"{role}_column"), TOTAL_MISMATCH) for role in ROLES])).otherwise(none)
    named = F.arrays_zip(F.col("headers").alias("name"), F.col("cells").alias("value"))

    def odd(ch: str, reason: str) -> Column:
        return F.transform(F.filter(named, lambda c: F.contains(c["value"], F.lit(ch))), lambda c: mark(c["name"], reason))

    return F.concat(totals, *[odd(ch, reason) for ch, reason in SUSPICIOUS_CHARACTERS.items()])


def report_tables(tables: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Per file: layout, columns_ok, status, rows_in, rows_removed and cells_flagged.

    tables: doc_id, headers and cells of every row, as from readers.read_order_tables. files: doc_id, headers and duplicate of
    every file, as from readers.table_headers; with them files without a row, and those with a header name
    twice, which are not read, are in the report too.

    A row is set aside if a cell of one of its file's number columns holds text that is no number. The
    kept ones get marks: on the three cells of a wrong total, on any cell with a suspicious character. Marks of
    one key and column count once. Counted in two steps, the first by key, so that a large file is in no task alone.
    """
    ruled = with_rules(tables.select("doc_id", "headers", "cells"))
    parsed = add_numbers(ruled, {f"{role}_num": _cell(f"{role}_at") for role in ROLES})
    unreadable = [
        F.coalesce((_cell(f"{role}_at") != "") & F.col(f"{role}_num").isNull(), F.lit(False)) for role in ROLES
    ]
    rejected = unreadable[0] | unreadable[1] | unreadable[2]
    row = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("reason")))
    entries = parsed.withColumn("rejected", rejected).select(
        "doc_id", "layout", "columns_ok", X.strip(F.get("cells", F.lit(0))).alias("key"), "rejected",
        F.explode(F.when(F.col("rejected"), row).otherwise(F.concat(row, _marks()))).alias("f"),
    )
    is_row = F.col("f.reason").isNull()
    cells = entries.groupBy("doc_id", F.when(~is_row, F.col("key")).alias("key"), F.col("f.column").alias("column")).agg(
        F.first("layout").alias("layout"), F.first("columns_ok").alias("columns_ok"),
        F.count_if(is_row).alias("rows_in"), F.count_if(is_row & F.col("rejected")).alias("rows_removed"),
        F.max((~is_row).cast("bigint")).alias("cell"),
    )
    counts = cells.groupBy("doc_id").agg(
        F.first("layout").alias("layout"), F.first("columns_ok").alias("columns_ok"),
        F.sum("rows_in").alias("rows_in"), F.sum("rows_removed").alias("rows_removed"), F.sum("cell").alias("cells_flagged"),
    )
    if files is None:
        return counts.select("doc_id", "layout", "columns_ok", F.lit(OK).alias("status"), "rows_in", "rows_removed", "cells_flagged")
    known = classify_layouts(files.select("doc_id", "headers", "duplicate"))
    found = counts.select(lookup_value(F.col("doc_id")).alias("__of"), "rows_in", "rows_removed", "cells_flagged")
    joined = known.withColumn("__at", lookup_value(F.col("doc_id"))).join(found, F.col("__at") == F.col("__of"), "left")
    status = F.when(F.col("duplicate"), DUPLICATE_HEADER).when(F.col("rows_in").isNull(), NO_ROWS).otherwise(OK)
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "doc_id", "layout", "columns_ok", status.alias("status"),
        *[F.coalesce(c, zero).alias(c) for c in ("rows_in", "rows_removed", "cells_flagged")],
    )
