"""Merging on small grids and tables."""

import random

import pytest
from pyspark.sql import functions as F

from orderflow.operators import merge as M
from orderflow.operators import template as T

CELLS = "row_idx bigint, col_idx int, kind string, num double, txt string"


def grid(spark, rows):
    """rows of Python values, row 0 being the header."""
    out = []
    for r, row in enumerate(rows):
        for c, v in enumerate(row):
            if v is None or v == "":
                continue
            kind = "txt" if isinstance(v, str) else "num"
            out.append((r, c, kind, None if kind == "txt" else float(v), v if kind == "txt" else None))
    return spark.createDataFrame(out, CELLS)


def lines_frame(spark, rows, columns=("Item", "Quantity"), doc="d"):
    schema = "doc_id string, line_seq bigint, " + ", ".join(f"`{c}` string" for c in columns)
    return spark.createDataFrame([(doc, i, *r) for i, r in enumerate(rows)], schema)


def merge(spark, rows, template, source=("Quantity",), target=("Qty",), columns=("Item", "Quantity"), **kw):
    cells = grid(spark, template)
    merged = M.merge_into_template(
        lines_frame(spark, rows, columns), T.template_from_cells(cells, target, kw.pop("key_column", None)),
        list(source), list(target), key=columns[0], **kw,
    )
    out = {(r.row_idx, r.col_idx): (r.kind, r.num, r.txt) for r in T.apply_to_grid(cells, merged.final).collect()}
    return merged, out


def stats(merged):
    return {k: v for k, v in merged.stats.first().asDict().items() if k in M.STAT_COUNTS and v}


def test_basic(spark):
    merged, out = merge(spark, [("A001", "100"), ("A002", "200,00")], [["Item", "Qty"], ["A001", ""], ["A002", ""], ["A003", ""]])
    assert out[(1, 1)] == ("num", 100.0, None) and out[(2, 1)] == ("num", 200.0, None) and (3, 1) not in out
    assert stats(merged) == {"total_csv_rows": 2, "rows_matched": 2}
    assert {r.outcome for r in merged.updates.collect()} == {"written"}


def test_first_occurrence_and_any_cell(spark):
    rows = [["Key", "Val"], ["X", 1], ["X", 2], ["Y", "Z"]]
    assert {r.value: r.row_idx for r in T.first_row_index(grid(spark, rows)).collect()} == {
        "Key": 0, "Val": 0, "X": 1, "1": 1, "2": 2, "Y": 3, "Z": 3}
    assert {r.value: r.row_idx for r in T.first_row_index(grid(spark, rows), 0).collect()} == {"Key": 0, "X": 1, "Y": 3}
    assert {r.name: r.col_idx for r in T.first_col_index(grid(spark, rows)).collect()}["z"] == 1
    merged, out = merge(spark, [("Z", "5")], rows, target=("val",))
    assert out[(3, 1)] == ("num", 5.0, None)  # found in the second column
    merged, out = merge(spark, [("Z", "5"), ("X", "7")], rows, target=("val",), key_column=0)
    assert stats(merged) == {"total_csv_rows": 2, "rows_matched": 1, "rows_not_found": 1}


def test_packing(spark):
    template = [["Item", "Qty", "Pcs/Ctn", "pcs/plt"], ["A001", "", 10, 50], ["A002", "", "10", 50], ["A003", "", "x", 50]]
    rows = [("A001", "90"), ("A002", "100"), ("A003", "90"), ("A001", ""), ("A002", "abc")]
    merged, out = merge(spark, rows[:3], template, quantity="quantity")
    assert out[(1, 1)] == ("txt", None, "90.0/100") and out[(2, 1)] == ("num", 100.0, None)
    assert out[(3, 1)] == ("num", 90.0, None)  # carton size is text: nothing planned
    assert stats(merged) == {"total_csv_rows": 3, "rows_matched": 3, "red_cells": 1}
    merged, out = merge(spark, rows, template, quantity="Quantity")
    assert out[(1, 1)] == ("txt", None, "") and out[(2, 1)] == ("txt", None, "abc")
    assert stats(merged)["red_cells"] == 1 and not merged.stats.first().qty_recalc_disabled
    merged, out = merge(spark, rows[:1], [["Item", "Qty"], ["A001", ""]], quantity="Quantity")
    assert merged.stats.first().qty_recalc_disabled and out[(1, 1)] == ("num", 90.0, None)
    merged, _ = merge(spark, rows[:1], template, quantity="Nope")
    assert merged.stats.first().qty_recalc_disabled
    merged, out = merge(spark, [("A001", "99")], [["Item", "Qty", "Pcs/Ctn", "Pcs/Plt"], ["A001", "", 50, 200]],
                        quantity="Quantity", increase=0, decrease="0%")
    assert out[(1, 1)] == ("txt", None, "99.0/N·A")


def test_tolerance_from_column(spark):
    cells = grid(spark, [["Item", "Qty", "Pcs/Ctn", "Pcs/Plt"], ["A001", "", 10, 50], ["A002", "", 10, 50]])
    df = lines_frame(spark, [("A001", "90", "15%"), ("A002", "90", "0")], ("Item", "Quantity", "tol"))
    merged = M.merge_into_template(
        df, T.template_from_cells(cells, ["Qty"]), ["Quantity"], ["Qty"], key="Item", quantity="Quantity",
        increase=F.col("tol"), decrease=F.col("tol"), carry=["tol"])
    assert {r.key: r.planned for r in merged.updates.collect()} == {"A001": 100, "A002": 90}


def test_outcomes(spark):
    flags = spark.createDataFrame([("d", "A002", "Quantity", "x"), ("other", "A001", "Quantity", "x")],
                                  "doc_id string, key string, column string, reason string")
    template = [["Item", "Qty", "Pcs/Ctn", "Pcs/Plt"], ["A001", "", 10, 50], ["A002", 1, 10, 50], ["A003", 100, 10, 50]]
    merged, _ = merge(spark, [("A001", "90"), ("A002", "90"), ("A003", "100"), ("A001", "50"), (" ", "1"), (None, "2"), ("no", "3")],
                      template, quantity="Quantity", flags=flags)
    got = {r.line_seq: r.outcome for r in merged.updates.collect()}
    assert got == {0: "modified", 1: "flagged", 2: "skipped", 3: "written", 4: "blank_key", 5: "unmatched", 6: "unmatched"}
    assert stats(merged) == {"total_csv_rows": 7, "rows_matched": 4, "rows_not_found": 2, "rows_blank_key": 1,
                             "red_cells": 1, "yellow_cells": 1, "skipped_cells": 1}
    final = {(r.row_idx, r.col_idx): (r.outcome, r.new.num) for r in merged.final.collect()}
    assert final[(1, 1)] == ("modified", 50.0)  # the mark stays, the value is the later one


@pytest.mark.parametrize("existing,new,want", [
    (5.5, "5.5", "skipped"), ("5,50", "5.5", "skipped"), (123, "00123", "skipped"), ("", "", "skipped"),
    (7, "", "written"), ("abc", " abc ", "skipped"), ("abc", "Abc", "written"), ("1.234,5", "1234.5", "skipped"),
])
def test_change_detection(spark, existing, new, want):
    merged, _ = merge(spark, [("A001", new)], [["Item", "Qty"], ["A001", existing]])
    assert [r.outcome for r in merged.updates.collect()] == [want]


def test_identifiers(spark):
    merged, out = merge(spark, [("A001", "000461200000102"), ("600200107", "00123")],
                        [["Ref", "PartCode"], ["A001", ""], [600200107, ""]], ("Code",), ("PartCode",), ("Ref", "Code"))
    assert out[(1, 1)] == ("txt", None, "000461200000102") and out[(2, 1)] == ("txt", None, "00123")
    assert all(r.new.force_text for r in merged.updates.collect())


def test_mapping(spark):
    template = T.template_from_cells(grid(spark, [["Item", "Qty"], ["A001", ""]]), ["Qty", "BadCol"])
    df = lines_frame(spark, [("A001", "1", "2")], ("Item", "Quantity", "Price"))
    merged = M.merge_into_template(df, template, ["quantity", "Price", "ignored"], ["QTY", "BadCol"], key="Item")
    row = merged.stats.first()
    assert row.missing_columns == ["BadCol"] and row.rows_matched == 1
    with pytest.raises(ValueError, match="BadCol"):
        M.merge_into_template(df, template, ["Price"], ["BadCol"], key="Item")


def test_gate(spark):
    merged, _ = merge(spark, [("NOPE", "1")], [["Item", "Qty"], ["A001", ""]])
    with pytest.raises(M.NoMatchesError) as e:
        M.merge_gate(merged.stats)
    assert (e.value.stats["rows_matched"], e.value.stats["rows_not_found"]) == (0, 1)


def apply_one_by_one(rows, cells):
    """Updates in order on a dict of cells, the way a person would type them in."""
    def cls(v):
        if isinstance(v, float):
            return v
        try:
            return float(v)
        except ValueError:
            return v.strip()

    outcomes = []
    for key, raw in rows:
        if key not in cells:
            outcomes.append("unmatched")
            continue
        ident = raw.isdigit() and raw.startswith("0") and len(raw) > 1
        new = raw if ident or not isinstance(cls(raw), float) else float(raw)
        if cls(cells[key]) == cls(new):
            outcomes.append("skipped")
        else:
            outcomes.append("written")
            cells[key] = new
    return outcomes


@pytest.mark.parametrize("crowd, part", [(1000, 1000), (50, 7), (50, 1), (0, 30)])
def test_sequences_against_one_by_one(spark, crowd, part):
    """Cells with more than so many updates are cut into parts; the others are not."""
    rnd = random.Random(part)
    keys = ["hot"] * 10 + ["a", "b", "c", "zz"]
    rows = [(rnd.choice(keys), rnd.choice(["1", "01", "2", "x", "", "1.0"])) for _ in range(400)]
    cells = {k: "" for k in ("hot", "a", "b", "c")}
    merged, out = merge(spark, rows, [["Item", "Qty"], ["hot", ""], ["a", ""], ["b", ""], ["c", ""]], crowd=crowd, part=part)
    want = apply_one_by_one(rows, cells)
    assert {r.line_seq: r.outcome for r in merged.updates.collect()} == dict(enumerate(want))
    for i, k in enumerate(("hot", "a", "b", "c"), 1):
        kind, num, txt = out.get((i, 1), (None, None, ""))
        assert (num if kind == "num" else txt) == cells[k]


def test_partition_invariance(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", "zz"]), str(rnd.randint(1, 4))) for _ in range(200)]
    seen = []
    for n in (1, 23):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        merged, out = merge(spark, rows, [["Item", "Qty"], ["a", ""], ["b", 3]])
        seen.append((sorted((r.line_seq, r.outcome) for r in merged.updates.collect()), out))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_per_document(spark):
    df = lines_frame(spark, [("a", "1")], doc="d1").union(lines_frame(spark, [("a", "1")], doc="d2"))
    template = T.template_from_cells(grid(spark, [["Item", "Qty"], ["a", ""]]), ["Qty"])
    args = (df, template, ["Quantity"], ["Qty"])
    own = M.merge_into_template(*args, key="Item", per_document=True)
    assert {(r.doc_id, r.outcome) for r in own.updates.collect()} == {("d1", "written"), ("d2", "written")}
    assert own.final.count() == 2
    shared = M.merge_into_template(*args, key="Item", order=("line_seq", "doc_id"))
    assert {(r.doc_id, r.outcome) for r in shared.updates.collect()} == {("d1", "written"), ("d2", "skipped")}


def test_wide_template(spark):
    df = spark.createDataFrame(
        [(0, 10, None, 10, 50), (1, 20, 7.0, 10, 50), (2, 10, 9.0, 10, 50)],
        "n int, part bigint, qty double, `Pcs/Ctn` int, `Pcs/Plt` int")
    template = T.template_from_table(df, "part", ["qty"], "n")
    merged = M.merge_into_template(lines_frame(spark, [("10", "90"), ("20", "7"), ("30", "1")]), template,
                                   ["Quantity"], ["Qty"], key="Item", quantity="Quantity", increase="15%", decrease="15%")
    assert {r.key: r.outcome for r in merged.updates.collect()} == {"10": "modified", "20": "modified", "30": "unmatched"}
    out = {r.n: r.qty for r in T.apply_to_table(df, "n", {"qty": 1}, merged.final).collect()}
    assert out == {0: "90.0/100", 1: "7.0/N·A", 2: "9"}
    missing = T.unmatched_keys(lines_frame(spark, [("30", "1"), ("30", "2"), ("10", "1"), ("", "1"), (None, "1")]), "Item", template.rows)
    assert {(r.key, r.lines) for r in missing.collect()} == {("30", 2), (None, 1)}


def test_grid_from_table(spark):
    df = spark.createDataFrame([(0, "x", None, True), (1, "", 2.5, None)], "n int, a string, b double, c boolean")
    got = {(r.row_idx, r.col_idx): (r.kind, r.num, r.txt) for r in T.grid_from_table(df, "n").collect()}
    assert got == {(0, 0): ("txt", None, "a"), (0, 1): ("txt", None, "b"), (0, 2): ("txt", None, "c"),
                   (1, 0): ("txt", None, "x"), (1, 2): ("bool", 1.0, None), (2, 1): ("num", 2.5, None)}


def test_hot_key_join_is_split(spark):
    """A third of all lines on one key, template too large to broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = 60000
        df = spark.range(n, numPartitions=8).select(
            F.lit("d").alias("doc_id"), F.col("id").alias("line_seq"),
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("Item"),
            F.col("id").cast("string").alias("Quantity"))
        parts = spark.range(1000).select(F.col("id").alias("n"), F.when(F.col("id") == 0, "hot").otherwise(
            F.concat(F.lit("k"), F.col("id"))).alias("part"), F.lit(0.0).alias("Qty"))
        template = T.template_from_table(parts, "part", ["Qty"], "n")
        merged = M.merge_into_template(df, template, ["Quantity"], ["Qty"], key="Item")
        rows = merged.updates.groupBy("outcome").count()
        counts = {r["outcome"]: r["count"] for r in rows.collect()}
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert sum(counts.values()) == n and "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_cell_on_every_page_is_not_one_task(spark):
    """One key on every page of a long document: its updates are cut by their order, each part a window of its own."""
    df = spark.range(40).select(
        F.lit("d").alias("doc_id"), (F.col("id") * 2**32).alias("line_seq"), F.lit("k").alias("Item"),
        ((F.col("id") / 2).cast("int")).cast("string").alias("Quantity"))
    parts = spark.createDataFrame([(0, "k", 0.0)], "n long, part string, Qty double")
    for per_document in (False, True):
        merged = M.merge_into_template(df, T.template_from_table(parts, "part", ["Qty"], "n"), ["Quantity"], ["Qty"], key="Item",
                                       per_document=per_document, crowd=39, part=10)
        got = [r.outcome for r in merged.updates.orderBy("line_seq").collect()]
        assert got == ["skipped", "skipped"] + ["written", "skipped"] * 19
        plan = merged.updates._jdf.queryExecution().optimizedPlan().toString()
        over_parts = [line for line in plan.splitlines() if "Window [" in line and "__row_before" in line]
        assert len(over_parts) == 1 and "[__part" in over_parts[0]


def test_a_row_that_a_crowded_and_another_key_lead_to(spark):
    """Updates of one row by two of its values stay in one order, though only one of them is frequent."""
    rows = [("A", str(i // 3 % 2)) if i % 5 else ("B", str(i % 2)) for i in range(60)]
    template = [["Item", "Other", "Qty"], ["A", "B", "0"], ["C", "", ""]]
    seen = []
    for crowd, part in ((1000, 1000), (20, 7)):
        merged, out = merge(spark, rows, template, crowd=crowd, part=part)
        seen.append((sorted((r.line_seq, r.outcome) for r in merged.updates.collect()), out))
    assert seen[0] == seen[1] and {"skipped", "written"} == {o for _, o in seen[0][0]}


def test_updates_are_exchanged_once(spark):
    """Without a crowded cell there is one window over the updates, no join behind it and nothing computed twice."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = lines_frame(spark, [("a", str(i)) for i in range(20)])
        parts = spark.createDataFrame([(0, "a", 0.0)], "n long, part string, Qty double")
        merged = M.merge_into_template(df, T.template_from_table(parts, "part", ["Qty"], "n"), ["Quantity"], ["Qty"], key="Item")
        plan = merged.updates._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Window [") == 1 and plan.count("Join") == 1 and plan.count("Exchange") <= 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


MANY = "template string, row_idx bigint, col_idx int, kind string, num double, txt string"


def grids(spark, named):
    found = None
    for name, rows in named.items():
        one = grid(spark, rows).withColumn("template", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found


def test_templates_as_tables(spark):
    """One key in different rows and columns of two templates; a target that only one of them has."""
    cells = grids(spark, {
        "a": [["Item", "Qty", "Pcs/Ctn", "Pcs/Plt"], ["K1", "", 10, 50], ["K2", 5, 10, 50], ["K1", 3, 10, 50]],
        "b": [["note", "", ""], ["QTY", "x", "Item"], [7, "", "K2"], ["", "K1", ""]],
    })
    wanted = spark.createDataFrame([("a", "Qty"), ("b", "qty"), ("b", "Nope"), ("c", "Qty"), (None, "Qty")], "template string, name string")
    found = T.templates_from_cells(cells, wanted)
    places = {(r.template, r.name): r.position for r in found.positions.collect()}
    assert places == {("a", "qty"): 1, ("a", "pcs/ctn"): 2, ("a", "pcs/plt"): 3, ("b", "qty"): 0}
    rows = {(r.template, r.key): (r.row_idx, {k: v.num for k, v in (r.cells or {}).items()}) for r in found.rows.collect() if (r.key or "").startswith("K")}
    assert rows == {("a", "K1"): (1, {2: 10.0, 3: 50.0}), ("a", "K2"): (2, {1: 5.0, 2: 10.0, 3: 50.0}), ("b", "K2"): (2, {0: 7.0}), ("b", "K1"): (3, {})}
    by_column = T.templates_from_cells(cells, wanted, key_column=1)
    assert ("b", "K2") not in {(r.template, r.key) for r in by_column.rows.collect()}


def test_counts_add_up(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", "b", "zz", "", None]), str(rnd.randint(1, 3)), rnd.choice(["1", "x"])) for _ in range(150)]
    merged, _ = merge(spark, rows, [["Item", "Qty", "Price"], ["a", "", ""], ["b", 3, 1]], ("Quantity", "Price"),
                      ("Qty", "Price"), ("Item", "Quantity", "Price"))
    s = merged.stats.first()
    assert s.rows_matched + s.rows_not_found + s.rows_blank_key == s.total_csv_rows == len(rows)
    plain = merged.updates.filter("outcome = 'written'").count()
    assert s.skipped_cells + s.yellow_cells + s.red_cells + plain == 2 * s.rows_matched


def test_final_cells_lie_by_their_row(spark):
    """Updates are exchanged before they are one for each pair; the cells that stay need no exchange of their own, and
    putting them into the rows of every document's template does not run the merge a second time."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = lines_frame(spark, [("a", "1"), ("b", "2"), ("none", "3"), ("a", "4")])
        cells = grid(spark, [["Item", "Qty"], ["a", 5], ["b", ""], ["c", 7]])
        cells = cells.unionByName(cells.where("row_idx = 1"))  # a row that stands there twice
        template = T.template_from_cells(cells, ["Qty"])
        merged = M.merge_into_template(df, template, ["Quantity"], ["Qty"], key="Item", per_document=True)
        plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
        assert plan(merged.final).count("Exchange") == plan(merged.updates).count("Exchange")
        applied = T.apply_to_grid(cells, merged.final)
        assert plan(applied).count("Window [") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    out = sorted((r.doc_id, r.row_idx, r.col_idx, r.num, r.txt, r.outcome) for r in applied.fillna({"num": -1.0, "txt": "", "outcome": ""}).collect())
    assert out == [("d", 1, 0, -1.0, "a", "")] * 2 + [("d", 1, 1, 4.0, "", "written")] * 2 + [
        ("d", 2, 0, -1.0, "b", ""), ("d", 2, 1, 2.0, "", "written")]


def test_marks_meet_the_lines_at_their_row(spark):
    """Lines are exchanged by key and by row, not by document and key as well for the checks' marks; the marks of a line are
    the same as where rows are crowded and nothing is exchanged by row. B leads to the row of A, zz to none."""
    rnd = random.Random(4)
    schema = "doc_id string, line_seq long, Item string, Quantity string, Price string"
    rows = [(rnd.choice(["d1", "d2", "d3", None]), i, rnd.choice(["A", "B", "C", "zz", "", None]), str(rnd.randint(1, 9)), "3") for i in range(200)]
    df = spark.createDataFrame(rows + rows[:20], schema)
    marked = [(d, k, c) for d in ("d1", "d2", None, "other") for k in ("A", "B", "zz", "", None, "unknown") for c in ("Quantity", "Price") if rnd.random() < 0.6]
    flags = spark.createDataFrame(marked + marked[:3], "doc_id string, key string, column string")
    cells = grid(spark, [["Item", "Other", "Qty", "Cost"], ["A", "B", "0", ""], ["C", "", "", 3]])
    template = T.template_from_cells(cells, ["Qty", "Cost"])
    rows_of = {"A": 1, "B": 1, "C": 2}
    for per_document in (False, True):
        args = (df, template, ["Quantity", "Price"], ["Qty", "Cost"])
        options = {"key": "Item", "order": ("line_seq",), "flags": flags, "per_document": per_document}
        merged, crowded = (M.merge_into_template(*args, **options, crowd=crowd) for crowd in (1000, 0))
        shown = lambda m: sorted((r.line_seq, repr(r.key), r.outcome, repr(r.source_column)) for r in m.updates.collect())
        got = shown(merged)
        assert got == shown(crowded) and {"flagged", "written", "skipped", "unmatched", "blank_key"} <= {g[2] for g in got}
        asked = {(r[1], c): (r[0], r[2], c) in set(marked) for r in rows for c in ("Quantity", "Price")}
        for seq, key, outcome, column in got:
            if outcome in ("flagged", "written"):
                assert eval(key) in rows_of and (outcome == "flagged") == asked[seq, eval(column)]
        before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = merged.updates._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(__mark" not in plan
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
