"""One query per operator on the driver's tables: (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.functions import cells as C
from orderflow.functions import packing as K
from orderflow.functions import text as X
from orderflow.operators import columns as P
from orderflow.operators import layout_columns, layout_marker, layout_table, layout_tail, lines, order_lines, quality, table_report
from orderflow.operators import merge as M
from orderflow.operators import template as T
from orderflow.operators.packing import plan_packing
from orderflow.plans import registry, runs
from orderflow.plans import rendering as R
from orderflow.sources import readers
from orderflow.staging import staged

RULES = {"qty": "quantity", "price": "price", "amount": "amount"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ---- numbers and text ------------------------------------------------------------------


@query
def parse_localized_numbers(spark, sf):
    df = R.order_lines(spark, sf).select("doc_id", "line_seq", "key", "quantity", "price", "amount")
    return P.parse_number_columns(df, ["quantity", "price", "amount"])


@query
def normalize_numeric_text(spark, sf):
    df = R.order_lines(spark, sf).select("doc_id", "line_seq", "key", "quantity", "price", "amount")
    return P.normalize_numeric_columns(df, ["quantity", "price", "amount", "absent"])


def _codes(spark, sf):
    part = F.col("l_partkey").cast("string")
    return R.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.when(F.col("l_linenumber") == 1, F.lpad(part, 9, "0"))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit(" "), F.lpad(part, 16, "7"), F.lit(" ")))
        .when(F.col("l_linenumber") == 3, F.concat(part, F.lit(".")))
        .when(F.col("l_linenumber") == 4, F.lit("  "))
        .when(F.col("l_linenumber") == 5, F.concat(F.lit("A"), part))
        .otherwise(part).alias("code"),
        F.translate(F.format_number(F.col("l_partkey") * 1000 + F.col("l_suppkey"), 0), ",",
                    "").alias("plain"),
        F.when(F.col("l_linenumber") % 2 == 0, F.format_number(F.col("l_partkey") * 1000, 0))
        .otherwise(F.translate(F.format_number(F.col("l_partkey") * 1000, 0), ",", ".")).alias("grouped"),
    )


@query
def identifier_profile(spark, sf):
    return P.identifier_profile(_codes(spark, sf), ["code", "plain", "grouped"])


@query
def typed_coercion(spark, sf):
    df = P.coerce_typed_columns(_codes(spark, sf), ["code"])
    return df.select("doc_id", "plain", "code.kind", "code.num", "code.txt", "code.force_text")


@query
def strip_thousands(spark, sf):
    return P.strip_thousands_columns(_codes(spark, sf), ["code", "plain", "grouped"])


@query
def canonical_keys(spark, sf):
    df = _codes(spark, sf)
    number = F.col("plain").cast("double") / F.when(F.col("doc_id") % 3 == 0, 8).otherwise(1)
    return df.select(
        "doc_id", "plain", C.canonical_text(C.number_cell(number)).alias("from_number"),
        C.canonical_text(C.text_cell(F.col("code"))).alias("from_text"),
    )


@query
def null_markers(spark, sf):
    markers = F.array(*[F.lit(m) for m in X.NULL_MARKERS])
    df = R.order_lines(spark, sf).select(
        "doc_id", "line_seq", "key",
        F.when(F.col("l_partkey") % 7 == 0, F.get(markers, (F.col("doc_id") % len(X.NULL_MARKERS)).cast("int")))
        .otherwise(F.col("quantity")).alias("quantity"),
    )
    return P.apply_null_markers(df)


@query
def clean_text(spark, sf):
    """Whole texts, with the characters of interest put in for two letters."""
    text = F.translate(F.col("text"), "eat", "­‑–")
    df = R.table(spark, sf, "documents").select("doc_id", text.alias("a"), text.alias("b"), text.alias("c"))
    for column, variant in zip("abc", X.CLEAN_VARIANTS):
        df = P.clean_text_columns(df, [column], variant)
    return df


# ---- schema ------------------------------------------------------------------------------


@query
def select_key_and_columns(spark, sf):
    selected, missing = P.select_key_and_columns(
        R.table(spark, sf, "lineitem"), ["L_QUANTITY", "nope", "l_orderkey", "l_Quantity", "L_LineNumber"]
    )
    return selected.withColumn("missing", F.lit(",".join(missing)))


@query
def conform_columns(spark, sf):
    return P.conform_columns(R.table(spark, sf, "supplier"), ["s_name", "s_suppkey", "s_phone"])


@query
def classify_layouts(spark, sf):
    tables = R.header_tables(spark, sf).select("doc_id", "headers")
    return registry.classify_layouts(tables).select(
        "doc_id", "layout", "columns_ok", "qty_column", "price_column", "amount_column"
    )


@query
def rename_by_position(spark, sf):
    found = readers.conform_tables(R.header_tables(spark, sf), "columns")
    return found.select("doc_id", "key", "quantity", "price", "amount", "delivery", "quantity_num", "amount_num")


@query
def conform_mixed_tables(spark, sf):
    found = readers.conform_tables(R.header_tables(spark, sf))
    return found.select("doc_id", "layout", "key", "quantity", "price", "amount", "other_part_no", "price_num")


# ---- checks ------------------------------------------------------------------------------


def _lines(spark, sf):
    return R.order_lines(spark, sf)


@query
def invalid_numeric_split(spark, sf):
    clean, rejects = quality.split_invalid_numeric(_lines(spark, sf), RULES)
    reasons = F.array_join(F.transform("reject_reasons", lambda r: F.concat(r["column"], F.lit("="), r["value"])), ";")
    both = clean.withColumn("reasons", F.lit("")).unionByName(
        rejects.withColumn("reasons", reasons).drop("reject_reasons")
    )
    return both.select("doc_id", "line_seq", "key", "amount", "reasons")


@query
def line_total_mismatch(spark, sf):
    return quality.line_total_mismatch(_lines(spark, sf), RULES, "key")


@query
def suspicious_chars(spark, sf):
    return quality.suspicious_chars(_lines(spark, sf), "key", columns=["key", "description", "amount"])


@query
def flag_union(spark, sf):
    df = _lines(spark, sf)
    flags = quality.flag_union(
        quality.line_total_mismatch(df, RULES, "key"),
        quality.suspicious_chars(df, "key", columns=["key", "description", "amount"]),
    )
    return flags.withColumn("reasons", F.array_join("reasons", ";"))


@query
def flag_counts(spark, sf):
    df = _lines(spark, sf)
    return quality.flag_counts(
        quality.line_total_mismatch(df, RULES, "key").unionByName(
            quality.suspicious_chars(df, "key", columns=["key", "description", "amount"])
        )
    )


CHECKED = ["key", "description", "quantity", "price", "amount"]


@query
def validate(spark, sf):
    """Flags of the rows that remain after the unreadable ones are set aside."""
    result = quality.validate(_lines(spark, sf), RULES, "key", columns=CHECKED)
    return result.flags.withColumn("reasons", F.array_join("reasons", ";"))


@query
def validation_report(spark, sf):
    return quality.validation_report(_lines(spark, sf), RULES, "key", columns=CHECKED)


@query
def report_tables(spark, sf):
    """The report over a folder of tables in five layouts, one file an order."""
    return table_report.report_tables(*R.mixed_tables(spark, sf))


# ---- template and merge --------------------------------------------------------------------


def _grid(spark, sf):
    return T.grid_from_table(R.table(spark, sf, "part"), "p_partkey")


@query
def grid_cells(spark, sf):
    return _grid(spark, sf)


@query
def first_row_index(spark, sf):
    return T.first_row_index(_grid(spark, sf))


@query
def first_row_index_by_column(spark, sf):
    return T.first_row_index(_grid(spark, sf), 0)


@query
def first_col_index(spark, sf):
    return T.first_col_index(_grid(spark, sf))


def _template(spark, sf):
    return T.template_from_table(R.template_table(spark, sf), "Item", ["Qty", "Price"], "n")


@query
def cell_updates(spark, sf):
    """Two pairs; the third target does not exist and is left out."""
    df = _lines(spark, sf)
    plan = M.plan_merge(df, ["Quantity", "PRICE", "amount"], ["qty", "Price", "Nope"], _template(spark, sf))
    updates = M.to_cell_updates(df, plan, keep=["line_seq", "l_suppkey", "key"])
    return updates.select("line_seq", "l_suppkey", "key", "map_order", "source_column", "target_column", "col_idx",
                          "value.kind", "value.num", "value.txt")


@query
def lookup_merge(spark, sf):
    index = T.template_from_table(R.template_table(spark, sf), "Item", [], "n").rows
    found = T.lookup_join(_lines(spark, sf), "key", index)
    return found.select("doc_id", "line_seq", "l_suppkey", "key", "row_idx")


@query
def unmatched_keys(spark, sf):
    index = T.template_from_table(R.template_table(spark, sf), "Item", [], "n").rows
    return T.unmatched_keys(_lines(spark, sf), "key", index)


@query
def detect_change(spark, sf):
    """A list price written as text against the price in the template, a number."""
    template = T.template_from_table(R.template_table(spark, sf), "Item", ["Price"], "n")
    tenths = 9000 + F.col("l_partkey") % 1000 + F.when(F.col("l_linenumber") == 3, 1).otherwise(0)
    text = F.concat(F.floor(tenths / 10).cast("string"), F.lit(","), (tenths % 10).cast("string"), F.lit("0"))
    df = _lines(spark, sf).withColumn("listed", text)
    found = P.coerce_typed_columns(T.lookup_join(df, "key", template.rows), ["listed"])
    old = template.cell(template.position("Price"))
    same = C.same_class(C.class_of(old, old["read"]), C.written_class(F.col("listed")))
    return found.select("line_seq", "l_suppkey", "key", F.col("listed.num").alias("num"), same.alias("unchanged"))


def _merged(spark, sf, **options):
    found = quality.validate(_lines(spark, sf), RULES, "key", columns=CHECKED)
    checked = found.derive(staged(found.checked))  # read for the marks and for the merge
    return M.merge_into_template(
        checked.clean, _template(spark, sf), ["quantity", "price", "amount"], ["Qty", "Price", "Nope"], key="key",
        order=R.ORDER, flags=checked.flags, **options,
    )


def _shown(cell: str, names=("kind", "num", "txt")):
    return [F.col(f"{cell}.{n}").alias(f"{cell}_{n}") for n in names]


@query
def sequence_updates(spark, sf):
    """Updates of one cell in order: which ones find their value there already."""
    merged = _merged(spark, sf)
    found = merged.updates.filter("row_idx is not null")
    return found.select("line_seq", "l_suppkey", "key", "row_idx", "col_idx", "map_order",
                        (F.col("outcome") == "skipped").alias("skipped"))


@query
def classify_outcome(spark, sf):
    merged = _merged(spark, sf, quantity="quantity", increase="5%", decrease="5%")
    return merged.updates.select("line_seq", "l_suppkey", "key", "source_column", "outcome", "planned", *_shown("new"))


@query
def apply_updates(spark, sf):
    merged = _merged(spark, sf)
    return T.apply_to_table(R.template_table(spark, sf), "n", {"Qty": 1, "Price": 2}, merged.final)


@query
def apply_updates_to_grid(spark, sf):
    cells = T.grid_from_table(R.template_table(spark, sf), "n", ["Item", "Qty", "Price"])
    merged = _merged(spark, sf)
    shifted = merged.final.withColumn("row_idx", F.col("row_idx") + 1)
    return T.apply_to_grid(cells, shifted)


@query
def apply_updates_per_document(spark, sf):
    """Every document's own template, as far as it touches it."""
    merged = _merged(spark, sf, per_document=True)
    return T.apply_to_table(R.template_table(spark, sf), "n", {"Qty": 1, "Price": 2}, merged.final)


@query
def change_log_per_document(spark, sf):
    merged = _merged(spark, sf, per_document=True)
    return merged.changes.select("doc_id", "line_seq", "l_suppkey", "key", "source_column", "outcome", *_shown("new"))


@query
def merge_stats(spark, sf):
    stats = _merged(spark, sf, quantity="quantity", increase="5%", decrease="5%").stats
    return stats.withColumn("missing_columns", F.array_join("missing_columns", ","))


# ---- packing -------------------------------------------------------------------------------


def _packing_input(spark, sf):
    part = R.table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("ctn"),
        (F.col("p_size") * (4 + F.col("p_partkey") % 7)).cast("double").alias("plt"),
    )
    tolerance = F.when(F.col("l_linenumber") % 3 == 0, "5%").when(F.col("l_linenumber") % 3 == 1, "0.15").otherwise("10")
    df = R.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_suppkey", "l_partkey",
        (F.col("l_quantity") * 10 + F.col("l_linenumber")).alias("q"),
        tolerance.alias("inc"), F.when(F.col("l_suppkey") % 2 == 0, "2 %").otherwise(tolerance).alias("dec"),
    )
    return df.join(part, df["l_partkey"] == part["p_partkey"])


PACK = ["doc_id", "l_linenumber", "l_suppkey", "l_partkey", "q"]


@query
def tolerance_ratios(spark, sf):
    df = _packing_input(spark, sf)
    return df.select(*PACK, K.tolerance_ratio(F.col("inc"), F.col("q")).alias("inc_ratio"),
                     K.tolerance_ratio(F.col("dec"), F.col("q")).alias("dec_ratio"))


def _ranges(spark, sf):
    df = _packing_input(spark, sf).withColumns({"qi": F.col("q").cast("bigint"), "c": F.col("ctn").cast("bigint"), "p": F.col("plt").cast("bigint")})
    df = df.withColumns({"ir": K.tolerance_ratio(F.col("inc"), F.col("qi")), "dr": K.tolerance_ratio(F.col("dec"), F.col("qi"))})
    low, high = K.allowed_range(F.col("qi"), F.col("ir"), F.col("dr"))
    return df.withColumns({"low": low, "high": high})


@query
def packing_full(spark, sf):
    fit = K.full_pallets(F.col("qi"), F.col("p"), F.col("low"), F.col("high"))
    return _ranges(spark, sf).select(*PACK, fit.alias("pieces"))


@query
def packing_mixed(spark, sf):
    fit = K.mixed_packing(F.col("c"), F.col("p"), F.col("low"), F.col("high"))
    return _ranges(spark, sf).select(*PACK, fit.alias("pieces"))


def _planned(spark, sf):
    return plan_packing(_packing_input(spark, sf), F.col("q"), F.col("ctn"), F.col("plt"), F.col("inc"), F.col("dec"))


@query
def plan_packing_table(spark, sf):
    return _planned(spark, sf).select(*PACK, "planned")


@query
def packing_display(spark, sf):
    value = F.struct(F.lit("num").alias("kind"), F.col("q").alias("num"), F.lit(None).cast("string").alias("txt"),
                     F.lit(False).alias("force_text"))
    df = _planned(spark, sf).withColumn("new", K.planned_value(value, F.col("planned"), F.lit(True)))
    return df.select(*PACK, *_shown("new", ("kind", "num", "txt", "force_text")))


# ---- layouts -------------------------------------------------------------------------------


@query
def text_lines(spark, sf):
    pages = R.table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    return layout_tail.text_lines(pages)


@query
def cluster_lines(spark, sf):
    found = lines.cluster_lines(R.document_words(spark, sf))
    return found.select("doc_id", "page", "word_seq", "line_key")


@query
def assemble_lines(spark, sf):
    return lines.assemble_lines(R.document_words(spark, sf)).select("doc_id", "page", "line_key", "line_text")


@query
def detect_headers(spark, sf):
    found = layout_columns.detect_headers(lines.assemble_lines(R.column_words(spark, sf)))
    return found.withColumn("headers", F.array_join("headers", "|"))


@query
def bucket_lines(spark, sf):
    return layout_columns.bucket_lines(lines.assemble_lines(R.column_words(spark, sf)))


@query
def order_lines_columns(spark, sf):
    found = layout_columns.extract(R.column_words(spark, sf))
    return found.select("doc_id", "page", "key", "description", "quantity", "price", "amount", "delivery",
                        "quantity_num", "price_num", "amount_num", "line_seq")


@query
def marker_lines(spark, sf):
    found = layout_marker.marker_lines(lines.assemble_lines(R.marker_words(spark, sf), "reading"))
    return found.select("doc_id", "page", "line_key", "key", "quantity", "other_part_no", "delivery", "bucket_price", "price")


@query
def next_line_description(spark, sf):
    found = layout_marker.next_line_description(lines.assemble_lines(R.marker_words(spark, sf), "reading"))
    return found.select("doc_id", "page", "line_key", "description")


@query
def order_lines_marker(spark, sf):
    found = layout_marker.extract(R.marker_words(spark, sf))
    return found.select("doc_id", "page", "key", "description", "quantity", "price", "delivery", "other_part_no", "price_num")


def _mixed_words(spark, sf):
    """Pages of both layouts by position in one table, as one folder of them would be."""
    columns, marker = R.column_words(spark, sf), R.marker_words(spark, sf)
    return columns.withColumn("layout", F.lit("columns")).unionByName(marker.withColumn("layout", F.lit("marker")))


@query
def bucket_lines_by_table(spark, sf):
    """Item lines of two layouts in one job, by the rows of a bucket table."""
    rules = layout_table.layout_rules(*layout_table.known_layouts(spark))
    return layout_table.bucket_lines(layout_table.assemble_mixed(_mixed_words(spark, sf), rules), rules)


@query
def order_lines_by_table(spark, sf):
    found = layout_table.extract(_mixed_words(spark, sf), *layout_table.known_layouts(spark))
    return found.select("layout", "doc_id", "page", "line_seq", "key", "description", "quantity", "price", "amount", "delivery", "other_part_no",
                        "quantity_num", "price_num", "amount_num")


@query
def tail_regex_lines(spark, sf):
    found = layout_tail.tail_regex_lines(R.text_pages(spark, sf))
    return found.drop("following", "line_no")


@query
def lookahead_description(spark, sf):
    found = layout_tail.lookahead_description(layout_tail.tail_regex_lines(R.text_pages(spark, sf)))
    return found.select("doc_id", "key", "description")


@query
def order_lines_tail(spark, sf):
    found = layout_tail.extract(R.text_pages(spark, sf))
    return found.select("doc_id", "key", "description", "master_pack", "inner_pack", "quantity", "price", "amount",
                        "delivery", "quantity_num", "price_num", "amount_num")


@query
def order_lines_all_layouts(spark, sf):
    """Rows and sums of the three layouts in one canonical table."""
    every = order_lines.union_order_lines(
        layout_columns.extract(R.column_words(spark, sf)),
        layout_marker.extract(R.marker_words(spark, sf)),
        layout_tail.extract(R.text_pages(spark, sf)),
    )
    return every.groupBy("layout").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("quantity_num").cast("bigint")).alias("pieces"),
        F.count("amount_num").alias("amounts"),
    )


@query
def extraction_outcome(spark, sf):
    pages = R.text_pages(spark, sf)
    return order_lines.extraction_outcome(pages, layout_tail.extract(pages))


@query
def extraction_counts(spark, sf):
    words = R.column_words(spark, sf)
    return order_lines.extraction_counts(words, layout_columns.extract(words))


# ---- whole runs ----------------------------------------------------------------------------


@query
def extract_only(spark, sf):
    found = runs.run_extract_only(R.text_pages(spark, sf), "tail")
    return found.checked.flags.withColumn("reasons", F.array_join("reasons", ";"))


def _run(spark, sf):
    template = T.template_from_table(R.template_table(spark, sf, "P-"), "Item", ["Qty"], "n")
    return runs.run_full(
        R.column_words(spark, sf), "columns", template, ["Cantidad"], ["Qty"], increase="5%", decrease="5%",
        stage=staged,
    )


@query
def full_run(spark, sf):
    return _run(spark, sf).merged.updates.select("doc_id", "line_seq", "key", "planned", "outcome", *_shown("new"))


@query
def run_stats(spark, sf):
    stats = _run(spark, sf).stats
    return stats.withColumn("missing_columns", F.array_join("missing_columns", ","))


def _profiles(spark, sf):
    """One profile per order priority, with two column mappings, an empty place in one of
    them, and two profiles that cannot be used; the documents of one have no profile."""
    orders = R.table(spark, sf, "orders")
    name = F.col("o_orderpriority")
    profiles = orders.select(name.alias("name")).distinct().filter("name < '5'").select(
        "name", F.when(F.col("name") < "4", "columns").otherwise("nowhere").alias("layout"),
        F.when(F.col("name") < "2", "Cantidad").otherwise("quantity ,, Price").alias("source_cols"),
        F.when(F.col("name") < "2", "Qty").when(F.col("name") < "3", "QTY,Nope,Price").otherwise("Qty,,Price").alias("target_cols"),
        F.when(F.col("name") < "2", "15%").otherwise("5%").alias("qty_increase"),
        F.when(F.col("name") < "3", "5%").otherwise("0").alias("qty_decrease"),
    )
    documents = orders.select(F.col("o_orderkey").cast("string").alias("doc_id"), name.alias("profile"))
    template = T.template_from_table(R.template_table(spark, sf, "P-"), "Item", ["Qty", "Price"], "n")
    checked = runs.check_lines(staged(layout_columns.extract(R.column_words(spark, sf))), "columns")
    return runs.run_profiles(checked.clean, documents, profiles, template, checked.flags)


@query
def profile_runs(spark, sf):
    found = _profiles(spark, sf).updates
    return found.select("doc_id", "key", "source_column", "planned", "outcome", *_shown("new"))


@query
def profile_status(spark, sf):
    return _profiles(spark, sf).status


def _two_templates(spark, sf):
    """The parts as two grids: one as they are, one with other rows, columns in another order and no carton sizes."""
    parts = R.template_table(spark, sf, "P-")
    full = T.grid_from_table(parts, "n", ["Item", "Qty", "Price", "Pcs/Ctn", "Pcs/Plt"])
    moved = T.grid_from_table(parts.withColumn("n", 2 * F.col("n") + 7), "n", ["Price", "Item", "Pcs/Plt", "Qty"])
    return full.withColumn("template", F.lit("full")).unionByName(moved.withColumn("template", F.lit("moved")))


def _by_template(spark, sf):
    orders = R.table(spark, sf, "orders")
    name = F.col("o_orderpriority")
    profiles = orders.select(name.alias("name")).distinct().filter("name < '5'").select(
        "name", F.lit("columns").alias("layout"), F.lit("Cantidad, Price").alias("source_cols"),
        F.when(F.col("name") < "2", "full").when(F.col("name") < "3", "moved").when(F.col("name") < "4", "nowhere").alias("template"),
        F.when(F.col("name") < "2", "Qty,Price").otherwise("QTY,price").alias("target_cols"),
        F.when(F.col("name") < "2", "15%").otherwise("5%").alias("qty_increase"), F.lit("5%").alias("qty_decrease"),
    )
    documents = orders.select(F.col("o_orderkey").cast("string").alias("doc_id"), name.alias("profile"))
    checked = runs.check_lines(staged(layout_columns.extract(R.column_words(spark, sf))), "columns")
    templates = T.templates_from_cells(_two_templates(spark, sf), runs.wanted_columns(profiles))
    return runs.run_profiles(checked.clean, documents, profiles, templates, checked.flags)


@query
def profile_runs_by_template(spark, sf):
    """Profiles with templates of their own, in which one key stands in other rows and other columns."""
    found = _by_template(spark, sf).updates
    return found.select("doc_id", "template", "key", "row_idx", "col_idx", "source_column", "planned", "outcome", *_shown("new"))


@query
def profile_status_by_template(spark, sf):
    return _by_template(spark, sf).status


@query
def apply_updates_by_template(spark, sf):
    """Of every document's template the rows that it touches, with the final cells put in."""
    found = T.apply_to_grid(_two_templates(spark, sf), _by_template(spark, sf).final)
    return found.filter("col_idx < 4")
