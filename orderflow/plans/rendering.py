"""Order documents made from the driver's tables, so that every operator has input that
grows with them. Whole tables throughout; the rules only decide how a value is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADERS_ES = ["Artículo", "Descripcion", "Cantidad", "Precio", "Importe", "Entrega"]
HEADERS_EN = ["Item", "Description", "Quantity", "Price", "Amount", "Delivery"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def us_money(cents: Column) -> Column:
    whole = F.floor(cents / 100)
    return F.concat(F.format_number(whole, 0), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def eu_money(cents: Column) -> Column:
    return F.translate(us_money(cents), ",.", ".,")


TIES = ["l_suppkey", "l_shipdate", "l_extendedprice"]
ORDER = ["line_seq", *TIES]


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as order lines whose numbers are written in four styles, with some
    unreadable amounts, wrong totals and suspicious characters."""
    style = F.col("l_linenumber") % 4
    qty = F.col("l_quantity").cast("bigint")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    df = table(spark, sf, "lineitem").select(
        "*", qty.alias("qty"), cents.alias("cents"), F.expr("cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint)").alias("unit"),
        style.alias("style"),
    )
    unit, style, qty = F.col("unit"), F.col("style"), F.col("qty").cast("string")
    total = F.when(F.col("l_linenumber") == 5, F.expr("(cents * 3) div 2")).otherwise(F.col("cents"))
    return df.select(
        F.col("l_orderkey").alias("doc_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_seq"),
        *TIES,
        "l_partkey",
        "l_linenumber",
        F.col("l_partkey").cast("string").alias("key"),
        F.when(F.col("l_suppkey") % 13 == 0, "Wid�get")
        .when(F.col("l_suppkey") % 13 == 1, "Hook‑")
        .when(F.col("l_suppkey") % 13 == 2, "a­b‑")
        .otherwise(F.concat(F.lit("Part "), "l_returnflag")).alias("description"),
        F.when(style == 0, F.concat(qty, F.lit(",00"))).when(style == 1, F.concat(qty, F.lit(".00")))
        .when(style == 2, qty).otherwise(F.concat(F.lit(" "), qty, F.lit(" "))).alias("quantity"),
        F.when(style == 0, eu_money(unit)).when(style == 1, us_money(unit))
        .when(style == 2, F.replace(us_money(unit), F.lit(","), F.lit("")))
        .otherwise(F.concat(F.lit("USD "), us_money(unit))).alias("price"),
        F.when(F.col("l_partkey") % 11 == 3, "Total").when(style == 0, eu_money(total)).when(style == 1, us_money(total))
        .when(style == 2, F.replace(us_money(total), F.lit(","), F.lit("")))
        .otherwise(F.concat(F.lit("€"), eu_money(total))).alias("amount"),
    )


def template_table(spark: SparkSession, sf: str, prefix: str = "") -> DataFrame:
    """part as the template: some keys written in a way that lines do not match, some
    quantities filled in already."""
    key = F.col("p_partkey").cast("string")
    if prefix:
        item = F.concat(F.when(F.col("p_size") % 5 == 0, "Q-").otherwise(prefix), F.lpad(key, 10, "0"))
    else:
        item = F.when(F.col("p_size") % 5 == 0, F.lpad(key, 12, "0")).otherwise(key)
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("n"),
        item.alias("Item"),
        F.when(F.col("p_size") % 3 == 0, (F.col("p_partkey") % 50 + 1).cast("double")).alias("Qty"),
        F.col("p_retailprice").alias("Price"),
        F.col("p_size").alias("Pcs/Ctn"),
        (F.col("p_size") * (4 + F.col("p_partkey") % 7)).alias("Pcs/Plt"),
    )


def order_items(spark: SparkSession, sf: str) -> DataFrame:
    """One to three items per order: part, qty, unit and total in cents, date."""
    df = table(spark, sf, "orders").select(
        "*", F.explode(F.expr("sequence(1, 1 + cast(o_orderkey % 3 as int))")).alias("i")
    )
    qty = 1 + (F.col("o_orderkey") * 7 + F.col("i") * 13) % 50
    unit = 50 + (F.col("o_orderkey") * 31 + F.col("i") * 17) % 500000
    return df.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "i",
        (F.col("o_custkey") + F.col("i") * 7).alias("part"),
        qty.alias("qty"), unit.alias("unit"),
        F.when(F.col("o_orderkey") % 10 == 0, 2 * qty * unit).otherwise(qty * unit).alias("total"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("date"),
    )


def _word(x0: int, text, top: int) -> Column:
    return F.struct(
        F.lit(float(x0)).alias("x0"), F.lit(float(top)).alias("dy"),
        (text if isinstance(text, Column) else F.lit(text)).alias("text"),
    )


def _words(df: DataFrame, base: Column, words: list[Column], seq: Column) -> DataFrame:
    placed = df.select(
        F.col("o_orderkey").cast("string").alias("doc_id"), "page", seq.alias("s"), base.alias("base"),
        F.posexplode(F.array_compact(F.array(*words))).alias("pos", "w"),
    )
    return placed.select(
        "doc_id", "page", (F.col("s") * 100 + F.col("pos")).cast("int").alias("word_seq"),
        F.col("w.x0").alias("x0"), (F.col("base") + F.col("w.dy")).cast("double").alias("top"),
        F.col("w.text").alias("text"),
    )


def column_words(spark: SparkSession, sf: str) -> DataFrame:
    """orders as pages of words in the column layout: two items per page, the words of a
    line up to two points apart, a header in Spanish, English or none."""
    items = order_items(spark, sf).withColumn("page", F.expr("cast(1 + (i - 1) div 2 as int)"))
    odd = lambda n, rest: (F.col("o_orderkey") % n == rest) & (F.col("i") == 1)
    total = F.when(odd(17, 5), "Total").when(odd(19, 7), "N/A").otherwise(eu_money(F.col("total")))
    lines = _words(
        items, F.lit(100) + 20 * F.col("i"),
        [
            _word(20, F.concat(F.lit("P-"), F.lpad(F.col("part").cast("string"), 10, "0")), 0),
            _word(110, "Part", 1), _word(180, F.col("o_orderstatus"), 2),
            _word(270, F.concat(F.col("qty").cast("string"), F.lit(",00")), 0), _word(320, "UN", 1),
            _word(365, F.concat(eu_money(F.col("unit")), F.lit("/UN")), 2), _word(445, total, 0),
            _word(500, F.col("date"), 1),
        ],
        F.col("i"),
    )
    places = [20, 110, 270, 340, 450, 500]
    language = F.col("o_orderkey") % 3
    heads = table(spark, sf, "orders").withColumn("page", F.lit(1))
    header = _words(
        heads, F.lit(40),
        [
            F.when(language < 2, _word(x, F.when(language == 0, es).otherwise(en), 0))
            for x, es, en in zip(places, HEADERS_ES, HEADERS_EN)
        ],
        F.lit(0),
    )
    return lines.unionByName(header)


def marker_words(spark: SparkSession, sf: str) -> DataFrame:
    """orders as pages of words in the marker layout: an item line and a line below it,
    which is a description, a remark or something further left."""
    items = order_items(spark, sf).withColumn("page", F.expr("cast(1 + (i - 1) div 2 as int)"))
    has_price = F.col("o_orderkey") % 5 != 0
    lines = _words(
        items, F.lit(100) + 40 * F.col("i"),
        [
            _word(50, F.concat(F.col("qty").cast("string"), F.lit(",00")), 0),
            F.when(has_price, _word(110, "STK", 1)),
            _word(140, "YP", 2), _word(160, F.col("o_orderstatus"), 0),
            _word(260, "OP", 1), _word(300, F.col("part").cast("string"), 2),
            F.when(F.col("o_orderkey") % 4 != 0, _word(380, F.col("date"), 0)),
            _word(455, F.when(has_price, eu_money(F.col("unit"))).otherwise("STK"), 1),
        ],
        F.col("i") * 2,
    )
    left = F.when(F.col("o_orderkey") % 7 == 0, _word(150, "Left", 0)).otherwise(_word(210, "Hinge", 0))
    below = _words(
        items, F.lit(115) + 40 * F.col("i"),
        [left, _word(260, F.when(F.col("i") == 2, "Remarks").otherwise(F.col("o_orderpriority")), 1)],
        F.col("i") * 2 + 1,
    )
    return lines.unionByName(below)


def text_pages(spark: SparkSession, sf: str) -> DataFrame:
    """documents as pages of text in the tail layout: the whole prose and up to three
    item lines below it, some with their description further down."""
    document = table(spark, sf, "documents")
    numbers = F.expr("sequence(1, cast(doc_id % 4 as int))")

    def item(i: Column) -> Column:
        d = F.col("doc_id")
        qty = 1 + (d * 7 + i) % 2000
        unit = 50 + (d * 31 + i * 17) % 50000
        total = F.when(d % 10 == 1, 2 * qty * unit).otherwise(qty * unit)
        apart = (d + i) % 3 == 0
        head = F.concat(
            (1000 + d * 10 + i).cast("string"),
            F.when(apart, "").otherwise(F.concat(F.lit(" Hook‑steel  "), F.col("lang"))),
        )
        tail = F.concat(
            F.lit(" "), (10 * i).cast("string"), F.lit(" 5 "), F.translate(F.format_number(qty, 0), ",", "."), F.lit(" "),
            eu_money(unit), F.lit(" "), eu_money(total), F.lit(" 01–05–26"),
        )
        below = F.when(~apart, "").when(d % 2 == 0, F.concat(F.lit("\n\n  Brand: "), F.col("source"))).otherwise(
            F.concat(F.lit("\nVendor 9\nBrand: "), F.col("source"))
        )
        return F.concat(head, tail, below)

    items = F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("\n"), F.array_join(F.transform(numbers, item), "\n")))
    return document.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page"),
        F.concat(F.col("text"), F.coalesce(items, F.lit(""))).alias("text"),
    )


def document_words(spark: SparkSession, sf: str) -> DataFrame:
    """documents as words: every text line is a line of the page, its words spread over
    five points of height, so that the fourth and fifth of five start a line of their own."""
    lines = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.posexplode(F.split("text", "\n")).alias("line", "text"),
    )
    filled = F.filter(F.split("text", " "), lambda w: w != "")
    words = lines.select("doc_id", "line", F.posexplode(filled).alias("pos", "text"))
    return words.select(
        "doc_id", F.expr("cast(line div 50 as int)").alias("page"),
        (F.col("line").cast("bigint") * 1000000 + F.col("pos")).alias("word_seq"),
        (F.col("pos") * 5.0).alias("x0"),
        (F.col("line") % 50 * 12 + F.col("pos") % 5 + 0.25).cast("double").alias("top"), "text",
    )


def header_tables(spark: SparkSession, sf: str) -> DataFrame:
    """orders as tables of one row: headers in one of five spellings, and cells."""
    names = [
        ["Artículo", "Denominación", "Cantidad", "Precio (USD)", "Importe", "F. Entrega"],
        HEADERS_EN,
        ["Our Part No", "Quantity", "Your Part No", "Price USD", "Del. date", "Description"],
        ["物品", "描述", "数量", "价格", "金额", "交期"],
        ["Quantity", "Your Part No", "Our Part No", "Price USD", "Del. date", "Description"],
    ]
    spelled = [F.array(*[F.lit(n) for n in row]) for row in names]
    headers = F.get(F.array(*spelled), (F.col("o_orderkey") % 5).cast("int"))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_orderkey").alias("line_seq"),
        headers.alias("headers"),
        F.array(F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderkey").cast("string"),
                eu_money(cents), us_money(cents), F.col("o_orderpriority")).alias("cells"),
    )


def mixed_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every order as a file of its own, in one of five layouts, with its line items as rows; and the headers
    of all files, also of those without a row and of some with a name twice."""
    names = [
        ["Artículo", "Denominación", "Cantidad", "Precio", "Importe", "Entrega"], HEADERS_EN,
        ["Our Part No", "Quantity", "Your Part No", "Price USD", "Del. date", "Description"],
        ["Itemno", "Description", "Master", "Inner", "Quantity", "Unit price", "Amount", "ETD"],
        ["物品", "描述", "数量", "价格", "金额", "交期"],
    ]
    key, description, quantity, price, amount = (F.col(c) for c in ("key", "description", "quantity", "price", "amount"))
    none = F.lit(None).cast("string")
    cells = [
        [key, description, quantity, price, amount, none], [key, description, quantity, price, amount, none],
        [key, quantity, none, price, none, description], [key, description, none, none, quantity, price, amount, none],
        [key, description, quantity, price, amount, none],
    ]

    def kind(choices: list[Column], number: Column) -> Column:
        picked = choices[0]
        for i, choice in enumerate(choices[1:], 1):
            picked = F.when(number % 5 == i, choice).otherwise(picked)
        return picked

    headers = [F.array(*[F.lit(n) for n in row]) for row in names]
    twice = F.col("o_orderkey") % 97 == 0
    files = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.when(twice, F.array(F.lit("Item"), F.lit("item"))).otherwise(kind(headers, F.col("o_orderkey"))).alias("headers"), twice.alias("duplicate"),
    )
    rows = order_lines(spark, sf).where("doc_id % 97 <> 0").select(
        "doc_id", "line_seq", kind(headers, F.col("doc_id")).alias("headers"), kind([F.array(*c) for c in cells], F.col("doc_id")).alias("cells"),
    )
    return rows, files
