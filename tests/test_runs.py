"""Sources, sinks and whole runs."""

import json

import pytest
from pyspark.sql import functions as F

from orderflow.operators import columns, merge, quality, template
from orderflow.plans import registry, runs
from orderflow.sources import publish, readers, writers
from orderflow.staging import shared_folder, staged, staging_scope
from orderflow.streaming import folder


def table(spark, rows, names, doc="d"):
    schema = "doc_id string, " + ", ".join(f"`{c}` string" for c in names)
    return spark.createDataFrame([(doc, *r) for r in rows], schema)


EN = ["Item", "Description", "Quantity", "Price", "Amount", "Delivery"]
RULES = {"qty": "Quantity", "price": "Price", "amount": "Amount"}


def flags_of(result):
    return {(r.key, r.column) for r in result.flags.collect()}


def test_validate_clean_and_invalid(spark):
    rows = [("A001", "Widget", "10", "5.0", "50.0", ""), ("Commercial", "Summary", "", "Total", "Total", "(USD)"),
            ("A002", "Gadget", "20", "3.0", "60.0", "")]
    result = quality.validate(table(spark, rows, EN), RULES)
    assert flags_of(result) == set() and result.clean.count() == 2
    rejects = result.rejects.collect()
    assert len(rejects) == 1 and [tuple(x) for x in rejects[0].reject_reasons] == [("Price", "Total"), ("Amount", "Total")]


def test_validate_flags(spark):
    rows = [("A001", "Widget", "10", "5.0", "999.0", ""), (" A002 ", "Wid�get", "10", "5.0", "50.5", ""),
            ("A003", "a­‑", None, "5.0", "", ""), ("A004", "ok", "10", "-5.0", "-52", ""),
            ("A004", "bad�", "  ", "1", "1", "")]
    result = quality.validate(table(spark, rows, EN), RULES)
    assert flags_of(result) == {("A001", "Quantity"), ("A001", "Price"), ("A001", "Amount"), ("A002", "Description"),
                                ("A003", "Description"), ("A004", "Quantity"), ("A004", "Price"), ("A004", "Amount")}
    reasons = {(r.key, r.column): list(r.reasons) for r in result.flags.collect()}
    assert reasons[("A003", "Description")] == ["Non-breaking Hyphen", "Soft Hyphen"]
    assert result.rejects.count() == 1  # blank but not empty
    counts = {(r.doc_id, r.reason): r.cells for r in quality.flag_counts(
        result.flags.select("doc_id", "key", "column", F.explode("reasons").alias("reason"))).collect()}
    assert counts[("d", quality.TOTAL_MISMATCH)] == 6


def test_validate_custom_rules_and_empty(spark):
    names = ["Key", "Qty", "UnitPrice", "Total"]
    rules = {"qty": "Qty", "price": "UnitPrice", "amount": "Total"}
    assert flags_of(quality.validate(table(spark, [("K", "2", "3", "6")], names), rules)) == set()
    assert flags_of(quality.validate(table(spark, [("K", "2", "3", "60")], names), rules)) == {
        ("K", "Qty"), ("K", "UnitPrice"), ("K", "Total")}
    assert flags_of(quality.validate(table(spark, [], names), rules)) == set()
    assert flags_of(quality.validate(table(spark, [("K", "2", "3", "60")], names), {"qty": "Qty", "price": "UnitPrice", "amount": None})) == set()


def test_validation_report(spark):
    rows = [("A001", "W", "10", "5", "999", ""), ("A002", "W", "x", "5", "50", "")]
    df = table(spark, rows, EN, "d1").union(table(spark, [("A", "W", "1", "1", "1", "")], EN, "d2"))
    got = {tuple(r) for r in quality.validation_report(df, RULES).collect()}
    assert got == {("d1", 2, 1, 3), ("d2", 1, 0, 0)}


def test_columns(spark):
    df = table(spark, [("A", "d", "1", "2", "3", "4")], EN).drop("doc_id")
    got, missing = columns.select_key_and_columns(df, ["price", "PRICE", "Nope", "item"])
    assert got.columns == ["Item", "Price"] and missing == ["Nope"]
    es = df.toDF("Artículo", "Denominación", "Cantidad", "Precio (USD)", "Importe", "F. Entrega")
    assert columns.rename_by_position(es, EN).columns == EN
    assert columns.resolve_by_position("quantity", es.columns, EN) == "Cantidad"
    assert columns.resolve_by_position("Quantity", ["Quantity", "x"], EN) == "Quantity"
    assert columns.resolve_by_position("Delivery", ["a", "b"], EN) == "Delivery"
    assert columns.resolve_by_position("Other", es.columns, EN) == "Other"
    assert columns.conform_columns(df, ["Item", "New"]).first().asDict() == {"Item": "A", "New": ""}
    with pytest.raises(ValueError, match="duplicate"):
        columns.select_key_and_columns(df.toDF("a", "A", "b", "c", "d", "e"), ["b"])
    with pytest.raises(columns.EmptyInputError):
        columns.require_rows(df.limit(0), "table")


CSVS = {
    "es.csv": "Artículo,Denominación,Cantidad,Precio (USD),Importe,F. Entrega\n000461200000102,ESCUADRA FIJA,504,0.818,412.27,29/12/2025\n",
    "sub/en.csv": 'Item,Description,Quantity,Price,Amount,Delivery\nA1,"two\nlines, ""quoted""",10,5,50,x\nA2,N/A,NaN,5,,y\n',
    "sub/deep/marker.csv": "Our Part No,Quantity,Your Part No,Price USD,Del. date,Description\nOP1,3,YP,1.5,01.02.26,desc\n",
    "empty.csv": "Itemno,Description,Master,Inner,Quantity,Unit price,Amount,ETD\n",
    "skip.txt": "not,a,table\n1,2,3\n",
}


@pytest.fixture()
def csv_folder(tmp_path):
    for name, text in CSVS.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_mixed_folder(spark, csv_folder):
    tables = readers.read_order_tables(spark, csv_folder)
    rows = {(r.doc_id.rsplit("/", 1)[1], r.cells[0]): r for r in tables.collect()}
    assert len(rows) == 4 and rows[("en.csv", "A1")].cells[1] == 'two\nlines, "quoted"'
    lines = readers.conform_tables(tables)
    got = {r.key: (r.layout, r.description, r.quantity, r.quantity_num, r.price, r.amount, r.other_part_no) for r in lines.collect()}
    assert got["000461200000102"] == ("columns_es", "ESCUADRA FIJA", "504", 504.0, "0.818", "412.27", None)
    assert got["A2"] == ("columns", None, None, None, "5", None, None)
    assert got["OP1"] == ("marker", "desc", "3", 3.0, "1.5", None, "YP")
    checked = runs.check_lines(lines, "columns")
    assert checked.rejects.count() == 0 and checked.flags.count() == 0
    headers = readers.table_headers(spark, csv_folder)
    report = {r.doc_id.rsplit("/", 1)[1]: (r.layout, r.columns_ok) for r in registry.classify_layouts(headers).collect()}
    assert report == {"es.csv": ("columns_es", False), "en.csv": ("columns", True), "marker.csv": ("marker", False), "empty.csv": ("tail", True)}
    assert headers.filter("duplicate").count() == 0 and readers.surplus_cells(tables).count() == 0


def test_odd_tables(spark, tmp_path):
    (tmp_path / "wide.csv").write_text('Item,"De\nscription",Quantity\nA1,x,1,EXTRA,"a,b"\nA2,"q ""y"" , z"\n"A3",,3,\n', encoding="utf-8")
    (tmp_path / "twice.csv").write_text("a,A\n1,2\n", encoding="utf-8")
    (tmp_path / "single.csv").write_text('\ufeffItem\n"one, two"\n', encoding="utf-8")
    tables = readers.read_order_tables(spark, str(tmp_path))
    got = {r.cells[0]: r for r in tables.collect()}
    assert got["A1"].headers == ["Item", "De\nscription", "Quantity"] and got["A1"].cells == ["A1", "x", "1"]
    assert got["A2"].cells == ["A2", 'q "y" , z', None] and got["A3"].cells == ["A3", None, "3"]
    assert got["one, two"].headers == ["Item"] and len(got) == 4
    assert [r.surplus for r in readers.surplus_cells(tables).collect()] == [["EXTRA", "a,b"]]
    assert [r.doc_id.rsplit("/", 1)[1] for r in readers.table_headers(spark, str(tmp_path)).filter("duplicate").collect()] == ["twice.csv"]


PAGE = ("Itemno Description Master Inner Quantity\n"
        "100 Hook 10 50 90 2,00 180,00 01.02.26\n"
        "200 Rail 10 50 100 2,00 999,00 01.02.26\n"
        "300 Bolt 10 50 1,2,3 2,00 1,00 01.02.26\n"
        "400 Nut 10 50 5 1,00 5,00 01.02.26")


def pages(spark):
    return spark.createDataFrame([("d1", 1, PAGE), ("d2", 1, PAGE.replace("90 2,00 180", "50 2,00 100")), ("d3", 1, "prose")],
                                 "doc_id string, page int, text string")


def parts(spark):
    df = spark.createDataFrame([(0, "100", None, 10, 50), (1, "200", None, 10, 50), (2, "300", None, 10, 50)],
                               "n int, Item string, Qty double, `Pcs/Ctn` int, `Pcs/Plt` int")
    return df, template.template_from_table(df, "Item", ["Qty"], "n")


def test_full_run(spark):
    df, tpl = parts(spark)
    run = runs.run_full(pages(spark), "tail", tpl, ["Quantity"], ["Qty"], stage=staged)
    got = {(r.doc_id, r.key): r.outcome for r in run.merged.updates.collect()}
    assert got == {("d1", "100"): "modified", ("d1", "200"): "flagged", ("d1", "400"): "unmatched",
                   ("d2", "100"): "written", ("d2", "200"): "flagged", ("d2", "400"): "unmatched"}
    stats = {r.doc_id: r.asDict() for r in run.stats.collect()}
    assert stats["d1"] == {"doc_id": "d1", "rows_extracted": 4, "rows_removed": 1, "cells_flagged": 3, "total_csv_rows": 3,
                           "rows_matched": 2, "rows_not_found": 1, "rows_blank_key": 0, "red_cells": 1, "yellow_cells": 1, "skipped_cells": 0,
                           "missing_columns": [], "qty_recalc_disabled": False}
    assert stats["d2"]["red_cells"] == 0
    only = runs.run_extract_only(pages(spark), "tail", strict=True)
    assert only.lines.count() == 8 and only.checked.clean.count() == 6
    with pytest.raises(columns.EmptyInputError):
        runs.run_extract_only(pages(spark).filter("doc_id = 'd3'"), "tail", strict=True)


def test_parsed_once(spark):
    """1,234 is 1.234; the text written for it must not be read again as 1234."""
    page = "100 Hook 1 1 2 1,234 2,468 01.02.26"
    df = spark.createDataFrame([("d", 1, page)], "doc_id string, page int, text string")
    _, tpl = parts(spark)
    run = runs.run_full(df, "tail", tpl, ["Unit price"], ["Qty"])
    assert run.checked.flags.count() == 0
    assert run.merged.updates.first().new.num == 1.234
    csv = spark.createDataFrame([("d", 0, ["Item", "Quantity", "Price", "Amount"], ["100", "2", "1.234", "2.468"])],
                                "doc_id string, line_seq bigint, headers array<string>, cells array<string>")
    line = readers.conform_tables(csv, "columns").first()
    assert line.price_num == 1234.0  # a CSV has only the text


def test_profiles(spark, tmp_path):
    path = tmp_path / "profiles.json"
    path.write_text(json.dumps([
        {"name": "wide", "converter": "tail", "pdf_cols": "Quantity, Unit price", "excel_cols": "Qty,Nope", "qty_increase": "15%", "qty_decrease": "15%"},
        {"name": "tight", "converter": "tail", "pdf_cols": "Quantity, Unit price", "excel_cols": "Qty,Nope"},
        {"name": "none", "converter": "columns_es", "pdf_cols": "Cantidad", "excel_cols": "qty", "qty_increase": "0", "qty_decrease": "0%"}]))
    _, tpl = parts(spark)
    lines = runs.run_extract_only(pages(spark), "tail").checked.clean
    docs = spark.createDataFrame([("d1", "wide"), ("d2", "none"), ("d3", "tight"), ("d4", "who"), ("d5", None)], "doc_id string, profile string")
    profiles = readers.read_profiles(spark, str(path))
    found = runs.run_profiles(lines, docs, profiles, tpl)
    assert {tuple(r) for r in found.status.collect()} == {("d1", "ok"), ("d2", "ok"), ("d3", "ok"), ("d4", "unknown_profile"), ("d5", "unknown_profile")}
    got = {(r.doc_id, r.key): (r.planned, r.outcome) for r in found.updates.collect()}
    assert got == {("d1", "100"): (100, "modified"), ("d1", "200"): (100, "written"), ("d1", "400"): (None, "unmatched"),
                   ("d2", "100"): (50, "written"), ("d2", "200"): (100, "written"), ("d2", "400"): (None, "unmatched")}


def test_a_template_for_each_profile(spark, tmp_path):
    """The path that a profile names is its template: other rows, other columns, no packing columns in one of them."""
    (tmp_path / "profiles.json").write_text(json.dumps([
        {"name": "one", "converter": "tail", "excel_template": "one.xlsx", "pdf_cols": "Quantity", "excel_cols": "Qty", "qty_increase": "15%", "qty_decrease": "15%"},
        {"name": "two", "converter": "tail", "excel_template": "two.xlsx", "pdf_cols": "Unit price,Quantity", "excel_cols": "price,qty"},
        {"name": "lost", "converter": "tail", "excel_template": "lost.xlsx", "pdf_cols": "Quantity", "excel_cols": "Qty"},
        {"name": "without", "converter": "tail", "pdf_cols": "Quantity", "excel_cols": "Qty"}]))
    profiles = readers.read_profiles(spark, str(tmp_path / "profiles.json"))
    one = [("one.xlsx", r, c, "txt", None, t) for r, row in enumerate([["Item", "Qty", "Pcs/Ctn", "Pcs/Plt"], ["100", "", "10", "50"], ["200", "", "10", "50"]]) for c, t in enumerate(row) if t]
    two = [("two.xlsx", r, c, "txt", None, t) for r, row in enumerate([["Qty", "Price", "", "Item"], ["", "2,00", "", "200"], ["", "", "", ""], ["90", "", "", "100"]]) for c, t in enumerate(row) if t]
    cells = spark.createDataFrame(one + two, "template string, row_idx bigint, col_idx int, kind string, num double, txt string")
    cells.write.parquet(str(tmp_path / "cells"))
    cells = readers.read_template_cells(spark, str(tmp_path / "cells"))
    templates = template.templates_from_cells(cells, runs.wanted_columns(profiles), key_column=None)
    names = ["one", "two", "lost", "without"]
    source = pages(spark).filter("doc_id = 'd1'").crossJoin(spark.createDataFrame([(n,) for n in names], "n string")).selectExpr("n as doc_id", "page", "text")
    docs = spark.createDataFrame([(n, n) for n in names], "doc_id string, profile string")
    found = runs.run_profiles(runs.run_extract_only(source, "tail").checked.clean, docs, profiles, templates)
    assert {r.doc_id: r.status for r in found.status.collect()} == {"one": "ok", "two": "ok", "lost": "unknown_template", "without": "unknown_template"}
    got = {(r.doc_id, r.key, r.target_column): (r.row_idx, r.col_idx, r.planned, r.outcome) for r in found.updates.collect()}
    assert got[("one", "100", "Qty")] == (1, 1, 100, "modified") and got[("one", "200", "Qty")] == (2, 1, 100, "written")
    assert got[("two", "100", "qty")] == (3, 0, None, "skipped") and got[("two", "100", "price")][:2] == (3, 1)
    assert got[("two", "200", "qty")] == (1, 0, None, "written") and got[("two", "200", "price")] == (1, 1, None, "skipped")
    put = {(r.doc_id, r.template, r.row_idx, r.col_idx): r.num if r.kind == "num" else r.txt for r in template.apply_to_grid(cells, found.final).collect()}
    assert put["one", "one.xlsx", 1, 1] == "90.0/100" and put["two", "two.xlsx", 1, 0] == 100.0 and put["two", "two.xlsx", 1, 3] == "200"
    assert not any(k[0] == "one" and k[1] == "two.xlsx" for k in put)


def test_profiles_are_data(spark, tmp_path):
    """Any number of mappings is one merge; what a profile cannot do is its documents' status."""
    (tmp_path / "tools.json").write_text(json.dumps([{"name": "Tail Tool", "script": "scripts/tail.py", "category": ""}]))
    rows = [{"name": f"p{i}", "converter": "Tail Tool", "pdf_cols": "Quantity,,Unit price"[: None if i % 2 else 8], "excel_cols": "Qty,Unused,Price"[: None if i % 2 else 3]} for i in range(40)]
    rows += [{"name": "uneven", "converter": "tail", "pdf_cols": "Quantity,Amount", "excel_cols": "Qty"},
             {"name": "nothing", "converter": "tail", "pdf_cols": "Quantity", "excel_cols": "Nope"},
             {"name": "strange", "converter": "Other Tool", "pdf_cols": "Quantity", "excel_cols": "Qty"}]
    (tmp_path / "profiles.json").write_text(json.dumps(rows))
    profiles = readers.read_profiles(spark, str(tmp_path / "profiles.json"), readers.read_tools(spark, str(tmp_path / "tools.json")), {"scripts/tail.py": "tail"})
    df = spark.createDataFrame([(0, "100", None, None, None)], "n int, Item string, Qty double, Unused string, Price double")
    tpl = template.template_from_table(df, "Item", ["Qty", "Unused", "Price"], "n")
    names = ["p0", "p1", "p2", "p3", "uneven", "nothing", "strange"]
    source = pages(spark).filter("doc_id = 'd1'").crossJoin(spark.createDataFrame([(n,) for n in names], "n string")).selectExpr("n as doc_id", "page", "text")
    docs = spark.createDataFrame([(n, n) for n in names], "doc_id string, profile string")
    found = runs.run_profiles(runs.run_extract_only(source, "tail").checked.clean, docs, profiles, tpl)
    assert {r.doc_id: r.status for r in found.status.collect()} == dict(
        {n: "ok" for n in names[:4]}, uneven="unequal_lists", nothing="no_pair", strange="unknown_layout")
    got = sorted((r.doc_id, r.target_column, r.new.num) for r in found.updates.filter("key = '100'").collect())
    assert got == [("p0", "Qty", 90.0), ("p1", "Price", 2.0), ("p1", "Qty", 90.0), ("p2", "Qty", 90.0), ("p3", "Price", 2.0), ("p3", "Qty", 90.0)]
    plan = found.updates._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 3


def test_null_markers_on_extracted_lines(spark):
    page = "100 Hook 10 50 90 2,00 N/A 01.02.26\nNA Hook 10 50 90 2,00 180,00 01.02.26"
    words = [("d", 1, i, x, 100.0 + 20 * line, t) for line, row in enumerate([("PART0000100", "N/A"), ("NA", "5,00"), ("PART0000200", "5,00")])
             for i, (x, t) in enumerate([(20.0, row[0]), (270.0, "5"), (365.0, "1,00"), (445.0, row[1])], start=10 * line)]
    df = spark.createDataFrame(words, "doc_id string, page int, word_seq int, x0 double, top double, text string")
    found = runs.run_extract_only(df, "columns")
    assert {r.key: r.amount for r in found.checked.clean.collect()}["PART0000100"] is None
    assert found.checked.rejects.count() == 0 and page


def test_shared_template_needs_an_order(spark):
    _, tpl = parts(spark)
    with pytest.raises(ValueError, match="order"):
        runs.run_full(pages(spark), "tail", tpl, ["Quantity"], ["Qty"], per_document=False)


def test_merged_output_per_document(spark, tmp_path):
    df, tpl = parts(spark)
    run = runs.run_full(pages(spark), "tail", tpl, ["Quantity"], ["Qty"])
    totals = writers.write_merged(run.merged, lambda final: template.apply_to_table(df, "n", {"Qty": 1}, final), str(tmp_path / "m"), stats=run.stats)
    assert totals["rows_matched"] == 4 and totals["rows_extracted"] == 8
    out = {(r.doc_id, r.Item): r.Qty for r in publish.read_published(spark, str(tmp_path / "m"), "merged").collect()}
    assert out == {("d1", "100"): "90.0/100", ("d1", "200"): "100", ("d2", "100"): "50", ("d2", "200"): "100"}
    grid = template.apply_to_grid(template.grid_from_table(df, "n", header=False), run.merged.final)
    cells = {(r.doc_id, r.row_idx, r.col_idx): r.txt if r.kind == "txt" else r.num for r in grid.collect()}
    assert cells["d1", 0, 1] == "90.0/100" and cells["d2", 0, 1] == 50.0 and cells["d1", 1, 0] == "200"
    assert len(cells) == len(grid.collect()) and ("d1", 2, 0) not in cells


def test_sinks_and_gate(spark, tmp_path):
    df, tpl = parts(spark)
    run = runs.run_full(pages(spark).filter("doc_id = 'd1'"), "tail", tpl, ["Quantity"], ["Qty"])
    writers.write_clean(run.checked, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c/rejects")).count() == 1
    table_ = lambda final: template.apply_to_table(df, "n", {"Qty": 1}, final)
    totals = writers.write_merged(run.merged, table_, str(tmp_path / "m"))
    assert totals["rows_matched"] == 2
    out = {r.Item: r.Qty for r in publish.read_published(spark, str(tmp_path / "m"), "merged").collect()}
    assert out == {"100": "90.0/100", "200": "100"}
    assert publish.read_published(spark, str(tmp_path / "m"), "stats").first().rows_matched == 2
    none = runs.run_full(pages(spark).filter("doc_id = 'd3'"), "tail", tpl, ["Quantity"], ["Qty"])
    with pytest.raises(merge.NoMatchesError) as error:
        writers.write_merged(none.merged, table_, str(tmp_path / "none"), stats=none.stats)
    assert error.value.stats["rows_extracted"] == 0 and not list((tmp_path / "none").rglob("*.parquet"))
    with pytest.raises(publish.NothingPublishedError):
        publish.read_published(spark, str(tmp_path / "none"), "merged")
    writers.write_merged(run.merged, table_, str(tmp_path / "none"))  # the same path, once lines match
    assert publish.read_published(spark, str(tmp_path / "none"), "changes").count() == 2


def test_a_failing_run_changes_nothing_that_is_read(spark, tmp_path):
    path, df = str(tmp_path / "out"), spark.createDataFrame([(1,)], "n int")
    with publish.publishing(spark, path) as run:
        run.write("t", df)
    with pytest.raises(ZeroDivisionError):
        with publish.publishing(spark, path) as run:
            run.write("t", df.union(df))
            1 / 0
    assert publish.read_published(spark, path, "t").count() == 1 and len(list((tmp_path / "out/runs").iterdir())) == 1
    with publish.publishing(spark, path) as run:
        run.write("t", df.union(df))
        assert publish.read_published(spark, path, "t").count() == 1  # not before the end
    assert publish.read_published(spark, path, "t").count() == 2
    with pytest.raises(publish.PublishedMeanwhileError):
        with publish.publishing(spark, path) as slow:
            slow.write("t", df.limit(0))
            with publish.publishing(spark, path) as quick:
                quick.write("t", df)
    assert publish.read_published(spark, path, "t").count() == 1
    assert len(publish.drop_unpublished(spark, path)) == 2 and publish.read_published(spark, path, "t").count() == 1


def test_writing_scans_the_lines_once(spark, tmp_path):
    """Totals are observed while the updates are written; no count reads the lines again."""
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(len(batch))
            yield batch

    lines = spark.createDataFrame([("d", i, "100" if i % 3 else "no", str(i)) for i in range(60)], "doc_id string, line_seq bigint, Item string, Quantity string")
    df, _ = parts(spark)
    tpl = template.template_from_table(df, "Item", ["Qty"], "n")
    seen = lines.mapInPandas(counted, lines.schema)
    merged = merge.merge_into_template(seen, tpl, ["Quantity"], ["Qty"], key="Item", crowd=None)
    totals = writers.write_merged(merged, lambda final: template.apply_to_table(df, "n", {"Qty": 1}, final), str(tmp_path / "m"))
    assert rows.value == 60
    assert {k: totals[k] for k in ("total_csv_rows", "rows_matched", "rows_not_found", "skipped_cells")} == {
        "total_csv_rows": 60, "rows_matched": 40, "rows_not_found": 20, "skipped_cells": 0}
    assert publish.read_published(spark, str(tmp_path / "m"), "stats").first().rows_matched == 40


def test_a_run_leaves_no_staged_tables(spark, tmp_path):
    from pathlib import Path

    shared = Path(shared_folder(spark).removeprefix("file:"))
    before = {p.name for p in shared.rglob("staged-*")}
    df, tpl = parts(spark)
    with staging_scope():
        run = runs.run_full(pages(spark), "tail", tpl, ["Quantity"], ["Qty"], stage=staged)
        assert {p.name for p in shared.rglob("staged-*")} > before
        writers.write_merged(run.merged, lambda final: template.apply_to_table(df, "n", {"Qty": 1}, final), str(tmp_path / "m"), stats=run.stats)
    assert {p.name for p in shared.rglob("staged-*")} == before
    with pytest.raises(RuntimeError):
        with staging_scope():
            staged(df)
            raise RuntimeError("on the way")
    assert {p.name for p in shared.rglob("staged-*")} == before
    assert publish.read_published(spark, str(tmp_path / "m"), "stats").count() == 2


def test_only_changed_parts_of_a_template_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "template")
    df = spark.range(100).select(F.col("id").cast("int").alias("n"), F.concat(F.lit("k"), "id").alias("Item"), F.lit("0").alias("Qty"))
    writers.write_template(df, path, "n", rows=10)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "template").rglob("*.parquet")}
    before = files()
    lines = spark.createDataFrame([("d", 0, "k15", "7"), ("d", 1, "k19", "8"), ("d", 2, "k73", "9"), ("d", 3, "k15", "11"), ("d", 4, "gone", "1"), ("d", 5, "k42", "0")],
                                  "doc_id string, line_seq bigint, Item string, Quantity string")
    stored = spark.read.parquet(path)
    tpl = template.template_from_table(stored.drop("row_range"), "Item", ["Qty"], "n")
    merged = merge.merge_into_template(lines, tpl, ["Quantity"], ["Qty"], key="Item")
    writers.update_template(merged.final, path, "n", tpl.positions, rows=10)
    after = files()
    same = {p for p in before if after.get(p) == before[p]}
    assert len(same) == 8 and not any(f"row_range={r}/" in p for p in same for r in (1, 7))
    found = {r.Item: r.Qty for r in spark.read.parquet(path).collect()}
    assert len(found) == 100 and (found["k15"], found["k19"], found["k73"], found["k42"], found["k10"]) == ("11", "8", "9", "0", "0")


def test_a_broken_file_is_a_row(spark, tmp_path):
    src = tmp_path / "src"
    pages(spark).filter("doc_id <> 'd2'").coalesce(1).write.parquet(str(src / "a"))
    (src / "b").mkdir()
    (src / "b/broken.parquet").write_bytes(b"this is no parquet file")
    whole = next((src / "a").glob("*.parquet")).read_bytes()
    (src / "b/cut.parquet").write_bytes(whole[: len(whole) // 2])
    lines, outcome = folder.ingest_folder(spark, str(src), "tail")
    assert lines.count() == 4
    got = {(r.doc_id.rsplit("/", 1)[-1], r.rows, r.status) for r in outcome.collect()}
    assert got == {("d1", 4, "ok"), ("d3", 0, "no_rows"), ("broken.parquet", 0, "unreadable"), ("cut.parquet", 0, "unreadable")}
    out = str(tmp_path / "out")
    folder.ingest_new(spark, str(src), "tail", out, str(tmp_path / "progress"))
    assert spark.read.parquet(out + "/lines").count() == 4
    got = {(r.doc_id.rsplit("/", 1)[-1], r.rows, r.status) for r in folder.ingest_outcome(spark, out).collect()}
    assert got == {("d1", 4, "ok"), ("d3", 0, "no_rows"), ("broken.parquet", 0, "unreadable"), ("cut.parquet", 0, "unreadable")}
    # more pages of a document in a later batch
    pages(spark).filter("doc_id = 'd1'").withColumn("page", F.lit(2)).coalesce(1).write.parquet(str(src / "c"))
    folder.ingest_new(spark, str(src), "tail", out, str(tmp_path / "progress"))
    assert {r.doc_id: r.rows for r in folder.ingest_outcome(spark, out).filter("status = 'ok'").collect()} == {"d1": 8}


def test_report_over_a_folder_of_layouts(spark, csv_folder, tmp_path):
    from pathlib import Path

    Path(csv_folder, "bad.csv").write_text("Itemno,Description,Master,Inner,Quantity,Unit price,Amount,ETD\n1,a\ufffd,1,1,2,3,7,x\n1,b,1,1,2,3,60,x\n2,c,1,1,2,3,Total,x\n", encoding="utf-8")
    Path(csv_folder, "twice.csv").write_text("Item,item\n1,2\n", encoding="utf-8")
    Path(csv_folder, "other.csv").write_text("x,y\nTotal,a\u00ad\n", encoding="utf-8")
    got = {r.doc_id.rsplit("/", 1)[1]: tuple(r)[1:] for r in readers.report_folder(spark, csv_folder).collect()}
    assert got == {
        "es.csv": ("columns_es", False, "ok", 1, 0, 0), "en.csv": ("columns", True, "ok", 2, 0, 0), "marker.csv": ("marker", False, "ok", 1, 0, 0),
        "empty.csv": ("tail", True, "no_rows", 0, 0, 0), "bad.csv": ("tail", True, "ok", 3, 1, 4),
        "twice.csv": ("columns", False, "duplicate_header", 0, 0, 0), "other.csv": ("tail", False, "ok", 1, 0, 1),
    }


def test_folder_ingest(spark, tmp_path):
    src, out, progress = (str(tmp_path / n) for n in ("src", "out", "progress"))
    pages(spark).filter("doc_id <> 'd2'").coalesce(1).write.parquet(src + "/a")
    folder.ingest_new(spark, src, "tail", out, progress)
    pages(spark).filter("doc_id = 'd2'").coalesce(1).write.parquet(src + "/b")
    folder.ingest_new(spark, src, "tail", out, progress)
    folder.ingest_new(spark, src, "tail", out, progress)
    assert spark.read.parquet(out + "/lines").count() == 8
    got = {(r.doc_id, r.status, r.batch) for r in spark.read.parquet(out + "/outcome").collect()}
    assert got == {("d1", "ok", 0), ("d3", "no_rows", 0), ("d2", "ok", 1)}
