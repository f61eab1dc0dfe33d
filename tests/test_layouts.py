"""Layout extraction on hand-written words and pages."""

import random

import pytest
from pyspark.sql import functions as F

from orderflow.operators import layout_columns, layout_marker, layout_tail, lines, order_lines
from orderflow.plans import registry

WORDS = "doc_id string, page int, word_seq int, x0 double, top double, text string"


def words_frame(spark, rows, doc="d1"):
    """rows: (page, top, [(x0, text), ...]) in extraction order."""
    out, seq = [], 0
    for page, top, words in rows:
        for x0, text in words:
            out.append((doc, page, seq, float(x0), float(top), text))
            seq += 1
    return spark.createDataFrame(out, WORDS)


def greedy(tops):
    """The line rule word by word."""
    anchors, keys = [], []
    for top in tops:
        hit = next((a for a in anchors if abs(a - int(top)) < 3), None)
        if hit is None:
            anchors.append(int(top))
            hit = int(top)
        keys.append(hit)
    return keys


def test_cluster_lines_greedy(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for doc in ("a", "b", "c"):
        for page in (1, 2):
            tops = [rnd.uniform(0, 60) for _ in range(150)]
            for i, (top, key) in enumerate(zip(tops, greedy(tops))):
                rows.append((doc, page, i, rnd.uniform(0, 600), top, "w"))
                want[(doc, page, i)] = key
    df = spark.createDataFrame(rows, WORDS).repartition(7)
    got = {(r.doc_id, r.page, r.word_seq): r.line_key for r in lines.cluster_lines(df).collect()}
    assert got == want
    reading = sorted(rows, key=lambda r: (r[0], r[1], round(r[4]), r[3], r[2]))
    want = {}
    for doc in ("a", "b", "c"):
        for page in (1, 2):
            mine = [r for r in reading if r[:2] == (doc, page)]
            for r, key in zip(mine, greedy([r[4] for r in mine])):
                want[r[:3]] = key
    got = {(r.doc_id, r.page, r.word_seq): r.line_key for r in lines.cluster_lines(df, "reading").collect()}
    assert got == want


def test_cluster_no_chaining(spark):
    df = words_frame(spark, [(1, t, [(t, "w")]) for t in (10, 11, 12, 13, 14, 20, 22, 25)])
    keys = sorted({r.line_key for r in lines.cluster_lines(df).collect()})
    assert keys == [10, 13, 20, 25]


def test_assemble_lines(spark):
    df = words_frame(spark, [(1, 10, [(50, "b"), (10, "a")]), (1, 11.9, [(20, "ab")]), (1, 30, [(5, "z")])])
    got = [(r.line_key, r.line_text) for r in lines.assemble_lines(df).orderBy("line_key").collect()]
    assert got == [(10, "a ab b"), (30, "z")]


HEADER_ES = [(20, "Artículo"), (110, "Descripcion"), (270, "Cantidad"), (340, "Precio"),
             (345, "(USD)"), (450, "Importe"), (500, "F."), (510, "Entrega")]
ITEM = [(20, "000461200000102"), (110, "ESCUADRA"), (150, "FI­JA"), (280, "504,00"), (320, "dropped"),
        (365, "0,818/UN"), (445, "412,27"), (490, "dropped"), (495, "29/12/2025")]


def test_columns_layout(spark):
    df = words_frame(
        spark,
        [(1, 40, HEADER_ES), (1, 60, ITEM), (1, 80, [(20, "short"), (280, "1")]),
         (2, 60, [(49.9, "0123456789"), (270, "nodigit"), (450, "1.234,50"), (460, "2.000,00")])],
    )
    rows = layout_columns.extract(df).orderBy("line_seq").collect()
    assert [(r.key, r.description, r.quantity, r.price, r.amount, r.delivery) for r in rows] == [
        ("000461200000102", "ESCUADRA FIJA", "504", "0.818", "412.27", "29/12/2025"),
        ("0123456789", "", "", "", "2000", ""),
    ]
    assert (rows[0].quantity_num, rows[0].price_num, rows[0].amount_num) == (504.0, 0.818, 412.27)
    headers = layout_columns.detect_headers(lines.assemble_lines(df)).first()
    assert headers.detected and list(headers.headers) == [
        "Artículo", "Descripcion", "Cantidad", "Precio (USD)", "Importe", "F. Entrega"]
    no_header = layout_columns.detect_headers(lines.assemble_lines(words_frame(spark, [(1, 9, ITEM)]))).first()
    assert not no_header.detected and list(no_header.headers) == layout_columns.HEADERS


def test_header_is_first_in_document_order(spark):
    df = words_frame(spark, [(2, 10, [(20, "Quantity"), (270, "late")]), (1, 90, [(20, "Cantidad"), (270, "b")]),
                             (1, 50, [(20, "Quantity"), (270, "a")])])
    assert layout_columns.detect_headers(lines.assemble_lines(df)).first().headers[2] == "a"


def test_marker_layout(spark):
    df = words_frame(
        spark,
        [
            (1, 100, [(50, "1.500,00"), (110, "STK"), (140, "YP"), (160, "77"), (260, "OP"), (300, "1 2"),
                      (380, "01.02.26"), (455, "12,50")]),
            (1, 112, [(210, "Hinge"), (260, "steel")]),
            (1, 130, [(50, "20"), (110, "STK"), (260, "OP2"), (441, "7,25")]),
            (1, 142, [(210, "see"), (260, "remarks")]),
            (1, 150, [(50, "30"), (110, "STK"), (260, "OP3"), (380, "01.02.26"), (445, "x9")]),
            (1, 162, [(199, "too far left")]),
            (1, 170, [(50, "40"), (110, "STK"), (260, "OP4")]),
            (2, 10, [(210, "other page")]),
        ],
    )
    rows = layout_marker.extract(df).orderBy("line_seq").collect()
    assert [(r.key, r.quantity, r.other_part_no, r.price, r.delivery, r.description) for r in rows] == [
        ("OP12", "1500", "YP 77", "12.5", "01.02.26", "Hinge steel"),
        ("OP2", "20", "", "", "7,25", ""),  # 441 falls in the date bucket, so it is no price
        ("OP3", "30", "", "", "x9", ""),
    ]


def test_marker_price_fallback(spark):
    df = words_frame(spark, [(1, 10, [(50, "5"), (260, "OP"), (300, "A"), (451, "STK")])])
    assert layout_marker.marker_lines(lines.assemble_lines(df, "reading")).first().price == "STK"


def pages_frame(spark, *texts):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(texts, 1)], "doc_id string, page int, text string")


def test_tail_layout(spark):
    filler = "\n".join(["noise"] * 38)
    df = pages_frame(
        spark,
        "Itemno Description Master Inner\n"
        "12345 Hook‑steel  large 10 5 1.200 2,50 3.000,00 01–05–26 late\n"
        "777 10 5 100 2.5 250.00 01.02.26\n\n  noise\n Brand: Acme­X \n"
        "888 10 5 100 2.5 250.00 01.02.26\nVendor 5\nBrand: no\n"
        "A99 10 5 100 2.5 250.00 01.02.26\n"
        "x 1 2 3 4\n" + "999 1 1 1 1 1 -\n" + filler + "\nbrand: reached",
        "",
        "111 1 1 1 1 1 -\n" + filler + "\nnoise\nbrand: too far",
    )
    rows = layout_tail.extract(df).orderBy("line_seq").collect()
    assert [(r.page, r.key, r.description, r.master_pack, r.quantity, r.price, r.amount, r.delivery) for r in rows] == [
        (1, "12345", "Hook-steel  large", "10", "1200", "2.5", "3000", "01-05-26 late"),
        (1, "777", "Brand: Acme-X", "10", "100", "2.5", "250", "01.02.26"),
        (1, "888", "", "10", "100", "2.5", "250", "01.02.26"),
        (1, "999", "brand: reached", "1", "1", "1", "1", "-"),
        (3, "111", "", "1", "1", "1", "1", "-"),
    ]


def test_tail_needs_no_shuffle(spark):
    plan = layout_tail.extract(pages_frame(spark, "x"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_text_lines(spark):
    got = layout_tail.text_lines(pages_frame(spark, "a\n\nb", "", None)).collect()
    assert [(r.page, r.line_no, r.text) for r in got] == [(1, 0, "a"), (1, 1, ""), (1, 2, "b")]


def test_outcome_and_counts(spark):
    df = pages_frame(spark, "1 1 1 1 1 1 -\n2 1 1 1 1 1 -", "nothing").union(
        spark.createDataFrame([("empty", 1, "prose")], "doc_id string, page int, text string"))
    found = layout_tail.extract(df)
    got = {tuple(r) for r in order_lines.extraction_outcome(df, found).collect()}
    assert got == {("d", 2, "ok"), ("empty", 0, "no_rows")}
    got = {tuple(r) for r in order_lines.extraction_counts(df, found).collect()}
    assert got == {("d", 2, 2), ("empty", 1, 0)}


def test_union_of_layouts(spark):
    a = layout_columns.extract(words_frame(spark, [(1, 60, ITEM)]))
    c = layout_tail.extract(pages_frame(spark, "1 1 1 1 1 1 -"))
    both = order_lines.union_order_lines(a, c)
    assert both.columns == order_lines.COLUMNS and both.count() == 2


def test_registry(spark):
    def mine(df):
        return df.mapInPandas(lambda it: it, df.schema)

    got = registry.register_layout("mine", ["K", "Qty"], ["key", "quantity"], {"qty": "Qty"}, mine)
    df = pages_frame(spark, "a", "b")
    assert registry.extract_lines(df, "mine").count() == 2
    assert got.field_of("qty") == "quantity" and got.field_of("Menge", ["Teil", "Menge"]) == "quantity"
    assert got.field_of("zzz") is None and got.field_rules() == {"qty": "quantity"}
    assert registry.layout("columns").field_of("Cantidad") == "quantity"
    with pytest.raises(KeyError):
        registry.layout("nope")
    with pytest.raises(TypeError):
        registry.register_layout("bad", ["K"], ["key"], extract=5)
    registry.register_layout("csv_only", ["K"], ["key"])
    with pytest.raises(TypeError):
        registry.extract_lines(df, "csv_only")


def test_classify_layouts(spark):
    df = spark.createDataFrame(
        [(1, ["Artículo", "x"]), (2, list(layout_columns.HEADERS)), (3, list(layout_marker.HEADERS)),
         (4, ["zzz"]), (5, list(registry.MARKER_EXPECTED))], "i int, headers array<string>")
    got = {r.i: (r.layout, r.columns_ok, r.qty_column, r.amount_column) for r in registry.classify_layouts(df).collect()}
    assert got == {
        1: ("columns_es", False, "Cantidad", "Importe"), 2: ("columns", True, "Quantity", "Amount"),
        3: ("marker", False, "Quantity", None), 4: ("tail", False, "Quantity", "Amount"),
        5: ("marker", True, "Quantity", None)}


def test_lines_take_one_shuffle_of_the_words(spark):
    df = words_frame(spark, [(1, 10, [(1.0, "w")])])
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (lines.assemble_lines(df), layout_columns.extract(df), layout_marker.extract(df)):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and "Join" not in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_words_without_a_place_are_counted(spark):
    rows = [("a", 1, 0, 1.0, 10.0, "x"), ("a", None, 1, 1.0, 10.0, "y"), ("a", 1, 2, 1.0, None, "z"), ("b", 1, 0, 1.0, 1.0, "x")]
    df = spark.createDataFrame(rows, WORDS)
    assert [tuple(r) for r in lines.unplaced_words(df).collect()] == [("a", 2)]


def test_order_of_long_pages(spark):
    """Text has no height: lines of a page beyond 2**20 still come before the next page."""
    from orderflow.operators.order_lines import line_sequence

    rows = [(1, 2**21), (2, 0), (1, 2**31 - 1), (2**31 - 1, 2**31 - 1)]
    df = spark.createDataFrame(rows, "page int, line int").select(line_sequence(F.col("page"), F.col("line")).alias("s"))
    a, b, c, d = (r.s for r in df.collect())
    assert a < c < b < d < 2**63


def test_words_are_not_sorted_before_their_exchange(spark):
    """Words leave their tasks as they come: no list of a page is gathered on both sides of the exchange, and the
    parts behind it are as many as the session's shuffles have, whatever they weigh compressed."""
    from orderflow.operators import lines

    words = spark.createDataFrame([("d", 1, i, 1.0, 10.0 * i, "w") for i in range(9)], "doc_id string, page int, word_seq int, x0 double, top double, text string")
    for found in (lines.assemble_lines(words), lines.cluster_lines(words, "reading")):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        before = plan[plan.index("Exchange hashpartitioning(doc_id"):]
        assert "REPARTITION_BY_NUM" in before and "collect_list" not in before
        assert found.count() == 9


def test_parts_grow_with_the_words(spark, monkeypatch):
    """However many words there are, a task gathers so many of them at most, as pages allow; the lines are the same."""
    words = words_frame(spark, [(page, 10.0 * line, [(1, "a"), (2, "b")]) for page in range(1, 31) for line in range(2)])
    shown = lambda: sorted((r.page, r.line_key, r.line_text) for r in lines.assemble_lines(words).collect())
    plain = shown()
    monkeypatch.setattr(lines, "PART_WORDS", 1)
    assert lines.assemble_lines(words).rdd.getNumPartitions() >= 120
    assert shown() == plain and len(plain) == 60
