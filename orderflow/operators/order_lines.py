"""The canonical order-line table that every layout ends in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions import numbers as N
from orderflow.functions.text import null_markers_to_null
from orderflow.operators.columns import parse_number_columns, settle

TEXT_COLUMNS = [
    "key", "description", "quantity", "price", "amount", "delivery",
    "master_pack", "inner_pack", "other_part_no",
]
NUMBER_COLUMNS = ["quantity", "price", "amount"]
#: What a layout by position may fill.
LINE_FIELDS = ["key", "description", "quantity", "price", "amount", "delivery", "other_part_no"]
RULES = {"qty": "quantity", "price": "price", "amount": "amount"}
COLUMNS = ["doc_id", "page", "line_seq", "layout", *TEXT_COLUMNS, *[f"{c}_num" for c in NUMBER_COLUMNS]]

# Line numbers are ints, so they stay below this, and pages leave room for the sign.
LINES_PER_PAGE = 2**32


def line_sequence(page: Column, line: Column) -> Column:
    """Order of lines within a document as one number."""
    return page.cast("bigint") * LINES_PER_PAGE + line


def _without_marker(cell: Column) -> Column:
    """Null where the cell says 'missing'; an empty cell stays empty."""
    return F.when((cell == "") | cell.isNull(), cell).otherwise(null_markers_to_null(cell))


def to_order_lines(rows: DataFrame, layout: str | Column, numeric: Sequence[str]) -> DataFrame:
    """Fill up to the canonical columns; numbers are parsed here, once, and their text
    is brought to canonical decimal form. layout: its name, or the column that tells it."""
    have = set(rows.columns)
    filled = rows.select(
        "doc_id", "page", "line_seq", (layout if isinstance(layout, Column) else F.lit(layout)).alias("layout"),
        *[_without_marker(F.col(c)).alias(c) if c in have else F.lit("").alias(c) for c in TEXT_COLUMNS],
    )
    parsed = parse_number_columns(filled, [c for c in TEXT_COLUMNS if c in numeric or c in NUMBER_COLUMNS])
    texts = {c: F.coalesce(N.number_text(F.col(f"{c}_num")), F.col(c)) for c in numeric}
    return settle(parsed, texts).select(*COLUMNS)


def union_order_lines(first: DataFrame, *others: DataFrame) -> DataFrame:
    for df in others:
        first = first.unionByName(df)
    return first


def extraction_outcome(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Per document: rows found and status ok or no_rows."""
    counts = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    return (
        documents.select("doc_id").distinct().join(counts, "doc_id", "left")
        .withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))
        .withColumn("status", F.when(F.col("rows") > 0, "ok").otherwise("no_rows"))
    )


def extraction_counts(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Per document: pages read and rows found. Pages are made distinct on (doc_id, page)
    first, so one long document does not land in one task."""
    page_counts = pages.select("doc_id", "page").distinct().groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages")
    )
    row_counts = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    return page_counts.join(row_counts, "doc_id", "left").withColumn(
        "rows", F.coalesce("rows", F.lit(0).cast("bigint"))
    )
