"""Readers. Files are read as text only, nothing is inferred."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.functions.text import null_markers_to_null
from orderflow.operators import order_lines
from orderflow.operators.columns import add_numbers, header_position
from orderflow.operators.table_report import report_tables
from orderflow.operators.template import lookup_value
from orderflow.plans import registry
from orderflow.staging import staged

WORDS = ["doc_id", "page", "word_seq", "x0", "top", "text"]
PAGES = ["doc_id", "page", "text"]


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the CSV files below path, the header too: doc_id (the file), n (their order) and cells.

    The reader finds where a record ends, also with line breaks in quotes; to a schema of one
    column a record of several is a misfit that it hands over as it stands. Its cells are
    taken apart here, as many as there are, so that files may differ in width.
    """
    rows = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").schema("only string, record string")
        .option("columnNameOfCorruptRecord", "record").option("multiLine", True).option("escape", '"').csv(path)
    ).select(F.col("_metadata.file_path").alias("doc_id"), F.monotonically_increasing_id().alias("n"), "only", "record")
    parts = F.regexp_extract_all(F.concat(F.lit(","), F.regexp_replace("record", r"\A\x{FEFF}", "")), F.lit(CELL), F.lit(1))
    plain = F.transform(parts, lambda c: F.when(
        c.startswith('"'), F.replace(F.regexp_replace(c, r'(?s)\A"(.*)"\z', "$1"), F.lit('""'), F.lit('"'))
    ).otherwise(c))
    single = F.array(F.regexp_replace("only", r"\A\x{FEFF}", ""))
    return rows.select("doc_id", "n", F.when(F.col("record").isNull(), single).otherwise(plain).alias("cells"))


#: A cell with the comma before it: quoted, with doubled quotes inside, or without a comma.
CELL = r',("(?:[^"]|"")*"|[^,]*)'


def table_headers(spark: SparkSession, path: str) -> DataFrame:
    """Per CSV file below path its headers, and whether a name stands there twice, which makes names ambiguous."""
    return _headers(_records(spark, path))


def _headers(records: DataFrame) -> DataFrame:
    first = records.groupBy("doc_id").agg(F.min_by("cells", "n").alias("headers"), F.min("n").alias("header_n"))
    lowered = F.transform("headers", lambda h: F.lower(h))
    return first.withColumn("duplicate", F.size(lowered) > F.size(F.array_distinct(lowered)))


def read_order_tables(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files below path: doc_id, line_seq, headers, cells, surplus.

    Files may differ in columns and language: a row's cells come by position, with the
    headers of its file next to them. Cells beyond the headers are kept apart in surplus,
    missing ones are null, and cells that mean 'missing' become null. line_seq orders the
    lines of a file. Files with a header name twice are not read; table_headers tells them.
    """
    records = _records(spark, path)
    headers = _headers(records).filter("not duplicate").select(lookup_value(F.col("doc_id")).alias("__file"), "headers", "header_n")
    body = records.withColumn("__file", lookup_value(F.col("doc_id"))).join(headers, "__file").filter("n > header_n")
    width = F.size("headers")
    filled = F.concat("cells", F.array_repeat(F.lit(None).cast("string"), F.greatest(F.lit(0), width - F.size("cells"))))
    return body.select(
        "doc_id", F.col("n").alias("line_seq"), "headers", F.transform(F.slice(filled, 1, width), null_markers_to_null).alias("cells"),
        F.filter(F.slice(filled, width + 1, F.greatest(F.lit(0), F.size("cells") - width)), lambda c: c != "").alias("surplus"),
    )


def report_folder(spark: SparkSession, path: str) -> DataFrame:
    """The report (see table_report.report_tables) over all CSV files below path, whatever their layouts."""
    return report_tables(read_order_tables(spark, path), table_headers(spark, path))


def surplus_cells(tables: DataFrame) -> DataFrame:
    """Rows of read_order_tables with more cells than their header: doc_id, line_seq, surplus."""
    return tables.filter(F.size("surplus") > 0).select("doc_id", "line_seq", "surplus")


def conform_tables(tables: DataFrame, layout: str | None = None) -> DataFrame:
    """Tables of any layout to canonical order lines. The layout is told by the headers
    unless it is given; a column is found by its name, or else by its position."""
    if layout is not None:
        named = tables.withColumn("layout", F.lit(layout))
        known = {layout: registry.layout(layout)}
    else:
        named = tables.withColumn("layout", registry.classify_layout(F.col("headers")))
        known = {n: registry.layout(n) for n in ("columns_es", "columns", "marker", "tail")}
    columns = {}
    for field in order_lines.TEXT_COLUMNS:
        value = F.lit(None).cast("string")
        for name, chosen in known.items():
            if field == "key":
                cell = F.get("cells", F.lit(0))
            elif field in chosen.fields:
                header = chosen.headers[list(chosen.fields).index(field)]
                cell = F.get("cells", header_position(F.col("headers"), header, chosen.headers))
            else:
                cell = F.lit(None).cast("string")
            value = F.when(F.col("layout") == name, cell).otherwise(value)
        columns[field] = value
    placed = named.select("doc_id", F.lit(None).cast("int").alias("page"), "line_seq", "layout",
                          *[c.alias(n) for n, c in columns.items()])
    numbers = {f"{c}_num": F.col(c) for c in order_lines.NUMBER_COLUMNS}
    return add_numbers(placed, numbers).select(*order_lines.COLUMNS)


OK, UNREADABLE = "ok", "unreadable"


def read_each_file(spark: SparkSession, path: str, schema: str, pattern: str = "*.parquet") -> tuple[DataFrame, DataFrame]:
    """The rows of all parquet files below path that can be read, with the column file; and per file its length, rows and status.

    A broken file takes nothing with it but itself: the files listed are held against those whose rows came through. A file
    is unreadable if nothing came of it, which also goes for one without a row, or if fewer rows came than its
    footer tells, as where it breaks in the middle; then none of its rows are used. The rows are read
    once, into a staged table.
    """
    reader = lambda: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    listed = reader().format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    source = reader().option("ignoreCorruptFiles", True).schema(schema).parquet(path)
    told = source.select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("told"))
    rows = staged(source.select("*", F.col("_metadata.file_path").alias("file")))
    came = rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    named = lambda t, n: t.select(lookup_value(F.col("file")).alias(f"__{n}"), n)
    counted = listed.withColumn("__file", lookup_value(F.col("file"))).join(
        named(told, "told"), F.col("__file") == F.col("__told"), "left"
    ).join(named(came, "rows"), F.col("__file") == F.col("__rows"), "left")
    whole = F.coalesce(F.col("rows") == F.col("told"), F.lit(False))
    files = staged(counted.select(
        "file", "length", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"), F.when(whole, OK).otherwise(UNREADABLE).alias("status")
    ))
    broken = files.where(F.col("status") == UNREADABLE).select(lookup_value(F.col("file")).alias("__broken"))
    read = rows.withColumn("__file", lookup_value(F.col("file"))).join(broken, F.col("__file") == F.col("__broken"), "left_anti")
    return read.drop("__file"), files


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Words with coordinates: doc_id, page, word_seq, x0, top, text."""
    return spark.read.parquet(path).select(*WORDS)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page texts: doc_id, page, text."""
    return spark.read.parquet(path).select(*PAGES)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """A template as a grid of typed cells."""
    return spark.read.parquet(path).select("row_idx", "col_idx", "kind", "num", "txt")


def read_template_cells(spark: SparkSession, path: str) -> DataFrame:
    """Many templates in one table: the cells of a grid and the template's name, as the profiles spell it."""
    return spark.read.parquet(path).select("template", "row_idx", "col_idx", "kind", "num", "txt")


PROFILE = (
    "name string, converter string, excel_template string, pdf_cols string, excel_cols string, "
    "qty_increase string, qty_decrease string"
)
DEFAULT_TOLERANCE = "5%"


def read_tools(spark: SparkSession, path: str) -> DataFrame:
    """Extraction tools (a JSON list): name and script."""
    return spark.read.schema("name string, script string").option("multiLine", True).json(path)


def read_profiles(
    spark: SparkSession, path: str, tools: DataFrame | None = None, scripts: Mapping[str, str] | None = None
) -> DataFrame:
    """Saved merge profiles (a JSON list), tolerances defaulting to 5 %.

    A profile names its layout, or a tool: then tools (see read_tools) tells the script
    of that name, and scripts the layout that the script reads.
    """
    raw = spark.read.schema(PROFILE).option("multiLine", True).json(path)
    layout = F.col("converter")
    if tools is not None and scripts:
        entries = [x for script, name in scripts.items() for x in (F.lit(script), F.lit(name))]
        named = tools.select(
            lookup_value(F.col("name")).alias("__tool"), F.try_element_at(F.create_map(*entries), F.col("script")).alias("__layout")
        )
        raw = raw.withColumn("__tool", lookup_value(F.col("converter"))).join(named, "__tool", "left")
        layout = F.coalesce("__layout", "converter")
    return raw.select(
        "name",
        layout.alias("layout"),
        F.col("excel_template").alias("template"),
        F.col("pdf_cols").alias("source_cols"),
        F.col("excel_cols").alias("target_cols"),
        F.coalesce("qty_increase", F.lit(DEFAULT_TOLERANCE)).alias("qty_increase"),
        F.coalesce("qty_decrease", F.lit(DEFAULT_TOLERANCE)).alias("qty_decrease"),
    )
