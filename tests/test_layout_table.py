"""Layouts that are rows of a table."""

import json

from orderflow.operators import layout_columns, layout_marker, layout_table
from orderflow.plans import registry

WORDS = "doc_id string, page int, word_seq int, x0 double, top double, text string"

COLUMNS = [
    [(20, "PART0000100"), (110, "Steel"), (150, "hook"), (270, "x"), (280, "5,00"), (320, "UN"), (365, "1.000,50/UN"), (430, "gap"), (445, "7"), (450, "5.002,50"), (490, "edge"), (500, "01/02/2026")],
    [(20, "short"), (110, "no"), (270, "5")], [(60, "PART0000200"), (110, "too"), (270, "5")], [(20, "PART0000300"), (110, "bare")],
]
MARKER = [
    [(50, "10,00"), (110, "STK"), (140, "Y"), (160, "1"), (260, "O P"), (300, "77"), (380, "01.02.26"), (455, "2,50")],
    [(210, "Hinge"), (260, "left")],
    [(50, "3"), (110, "STK"), (140, "Y"), (260, "OP2"), (445, "9,90")],
    [(210, "Remarks"), (260, "none")],
    [(50, "4"), (110, "STK"), (260, "OP3"), (380, "01.02.26"), (385, "late")],
    [(100, "too far left")], [(50, "STK"), (60, "x")],
]


def words(lines, doc, page=1):
    return [(doc, page, 20 * n + i, float(x), 100.0 + 20 * n + i % 3, t) for n, line in enumerate(lines) for i, (x, t) in enumerate(line)]


def mixed(spark):
    rows = [(*w, "columns") for w in words(COLUMNS, "c") + words(COLUMNS[:1], "c", 2)] + [(*w, "marker") for w in words(MARKER, "m") + words(MARKER, "c", 3)]
    return spark.createDataFrame(rows + [(*w, "nobody") for w in words(COLUMNS, "n")], f"{WORDS}, layout string")


def of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_rows_do_what_the_code_does(spark):
    df = mixed(spark)
    found = layout_table.extract(df, *layout_table.known_layouts(spark))
    by_code = layout_columns.extract(df.where("layout = 'columns'").drop("layout")).unionByName(layout_marker.extract(df.where("layout = 'marker'").drop("layout")))
    names = ["layout", "doc_id", "page", "line_seq", "key", "description", "quantity", "price", "amount", "delivery", "other_part_no", "quantity_num", "price_num", "amount_num"]
    assert of(found.select(*names)) == of(by_code.select(*names)) and found.count() == 9


def test_a_new_vendor_is_rows(spark, tmp_path):
    """Another marker, other columns, one of which takes all its words with a dash between; next to a known layout."""
    layouts = [{
        "layout": "vendor", "reading_order": False, "marker": "QTY", "min_tokens": 3, "described_right_of": 15.0, "not_described": ["Total"],
        "buckets": [
            {"field": "key", "low": 0, "high": 50, "how": "join", "separator": "-"}, {"field": "quantity", "low": 50, "above_low": True, "high": 90, "digits": True, "how": "last"},
            {"field": "price", "low": 90, "how": "last", "cut": " per", "without": "~"},
        ],
    }]
    (tmp_path / "layouts.json").write_text(json.dumps(layouts))
    rules, buckets = layout_table.read_layouts(spark, str(tmp_path / "layouts.json"))
    lines = [[(10, "A"), (20, "1"), (50, "7"), (60, "QTY"), (70, "12"), (80, "each"), (95, "~3,5 per 10")], [(20, "Long"), (30, "name")],
             [(10, "B"), (60, "QTY"), (70, "x"), (95, "1")], [(20, "Total"), (30, "2")], [(10, "C"), (60, "QTY")]]
    own = spark.createDataFrame([(*w, "vendor") for w in words(lines, "v")], f"{WORDS}, layout string")
    known_rules, known_buckets = layout_table.known_layouts(spark)
    found = layout_table.extract(mixed(spark).unionByName(own), known_rules.unionByName(rules), known_buckets.unionByName(buckets))
    got = [tuple(r) for r in found.where("layout = 'vendor'").orderBy("line_seq").select("doc_id", "key", "description", "quantity", "price", "price_num", "amount").collect()]
    assert got == [("v", "A-1", "Long name", "12", "3.5", 3.5, ""), ("v", "B", "", "", "1", 1.0, "")]
    assert found.where("layout <> 'vendor'").count() == 9
    registry.register_table_layout("vendor", ["Code", "Pieces", "Each"], ["key", "quantity", "price"], {"qty": "Pieces", "price": "Each"}, rules, buckets)
    try:
        again = registry.extract_lines(own.drop("layout"), "vendor")
        assert [r.key for r in again.orderBy("line_seq").collect()] == ["A-1", "B"]
    finally:
        registry._LAYOUTS.pop("vendor")


def test_words_are_exchanged_once_and_lines_not_again(spark):
    """Few layouts are brought to the words: these are exchanged by page alone, their lines stay there and are put in
    order without the buckets of their layout."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = layout_table.extract(mixed(spark), *layout_table.known_layouts(spark))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
        window = next(line for line in plan.splitlines() if "Project [" in line and "CASE WHEN item" in line)
        assert "buckets" not in window
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert found.count() == 9


def test_words_travel_as_plain_columns(spark):
    """What words are put in order by is made of them behind their exchange, not sent along."""
    found = layout_table.assemble_mixed(mixed(spark), layout_table.layout_rules(*layout_table.known_layouts(spark)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("struct(first") < plan.index("RepartitionByExpression")
    assert "struct(first" not in plan[plan.index("RepartitionByExpression"):]


def test_a_layout_named_twice(spark):
    """Every rule of the name reads the lines with its own buckets, whether these come before or behind the order of lines."""
    layouts, buckets = layout_table.known_layouts(spark)
    rules = layout_table.layout_rules(layouts.unionByName(layouts.where("layout = 'columns'")), buckets)
    lines = layout_table.assemble_mixed(mixed(spark), rules)
    assert layout_table.bucket_lines(lines).count() == layout_table.bucket_lines(lines, rules).count()
