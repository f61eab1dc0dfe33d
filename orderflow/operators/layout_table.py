"""Layouts as rows: what marks an item line, and which words of it belong to which column.

A layout is a row of LAYOUTS and some rows of BUCKETS. Lines of all layouts are read in one
job: the rules of a layout, gathered to one row, meet its lines in an equi-join, and the
words are matched with the ranges inside the row. So a new document format is new rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderflow.functions.text import WHITESPACE_CLASS, clean_text
from orderflow.operators import layout_columns, layout_marker
from orderflow.operators.buckets import Bucket
from orderflow.operators.lines import PAGE, assemble_lines
from orderflow.operators.order_lines import LINE_FIELDS, NUMBER_COLUMNS, line_sequence, to_order_lines
from orderflow.operators.template import lookup_value
from orderflow.staging import staged

#: key_left_of: an item line begins with a word left of this, of key_min_length letters at least, which is its key.
#: marker: or it holds this text and has min_tokens words; words that are the marker belong to no column.
#: fallback_right_of: an empty price may be the last word, if it stands right of this.
#: described_right_of: the next line is the description, if it begins right of this and holds none of the texts.
LAYOUTS = (
    "layout string, reading_order boolean, key_left_of double, key_min_length int, marker string, min_tokens int, "
    "fallback_right_of double, described_right_of double, not_described array<string>, not_described_any_case array<string>"
)

#: Words with low <= x0 < high (low < x0 where above_low; null leaves a side open) belong to the field; digits: only
#: words with a digit. how: 'join' takes all of them, with the separator between, 'last' the last one.
#: cut: only what stands before this text; without: this text is taken out.
BUCKETS = (
    "layout string, field string, low double, high double, above_low boolean, digits boolean, how string, "
    "separator string, cut string, without string"
)

JOIN, LAST = "join", "last"


def bucket_rows(layout: str, buckets: Sequence[Bucket], joined: dict[str, str], cut: dict[str, str], without: dict[str, str]) -> list[tuple]:
    """Rows of BUCKETS for a layout given in code. joined: the fields that take all words, with their separator."""
    return [
        (layout, b.column, b.low and float(b.low), b.high and float(b.high), b.above_low, b.digits,
         JOIN if b.column in joined else LAST, joined.get(b.column), cut.get(b.column), without.get(b.column))
        for b in buckets
    ]


def known_layouts(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The two layouts by position that this package knows, as rows."""
    c, m = layout_columns, layout_marker
    layouts = [
        ("columns", False, float(c.ITEM_RIGHT_OF), c.ITEM_MIN_LENGTH, None, None, None, None, None, None),
        ("marker", True, None, None, m.MARKER, m.MIN_TOKENS, float(m.FALLBACK_PRICE_RIGHT_OF), float(m.DESCRIPTION_RIGHT_OF),
         m.NOT_A_DESCRIPTION, [m.NOT_A_DESCRIPTION_ANY_CASE]),
    ]
    buckets = [
        *bucket_rows("columns", c.DATA_BUCKETS, {"description": " "}, {"price": "/"}, {}),
        *bucket_rows("marker", m.BUCKETS, {"other_part_no": " ", "key": ""}, {}, {"key": " "}),
    ]
    return spark.createDataFrame(layouts, LAYOUTS), spark.createDataFrame(buckets, BUCKETS)


def read_layouts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Layouts and buckets of a JSON list: a layout's object has its buckets as a list."""
    bucket = BUCKETS.replace("layout string, ", "")
    rows = spark.read.schema(f"{LAYOUTS}, buckets array<struct<{', '.join(x.replace(' ', ': ', 1) for x in bucket.split(', '))}>>").option("multiLine", True).json(path)
    return rows.drop("buckets"), rows.select("layout", F.inline("buckets"))


def layout_rules(layouts: DataFrame, buckets: DataFrame) -> DataFrame:
    """One row for each layout: of (a join value), its columns, the array of its buckets, and rule, a number of its own.

    They are staged, so that their size is known and words and lines need not be exchanged by layout to meet few of them.
    """
    columns = [c for c in buckets.columns if c != "layout"]
    gathered = buckets.groupBy(lookup_value(F.col("layout")).alias("__of")).agg(F.collect_list(F.struct(*columns)).alias("buckets"))
    named = layouts.withColumn("of", lookup_value(F.col("layout"))).drop("layout")
    return staged(named.join(gathered, F.col("of") == F.col("__of"), "left").drop("__of").withColumn("rule", F.monotonically_increasing_id()))


def _holds(bucket: Column, word: Column) -> Column:
    x0 = word["x0"]
    left = F.when(bucket["above_low"], x0 > bucket["low"]).otherwise(x0 >= bucket["low"])
    return (
        (bucket["low"].isNull() | left) & (bucket["high"].isNull() | (x0 < bucket["high"]))
        & (~F.coalesce(bucket["digits"], F.lit(False)) | word["text"].rlike("[0-9]"))
    )


def _value(bucket: Column, words: Column) -> Column:
    texts = F.transform(F.filter(words, lambda w: _holds(bucket, w)), lambda w: w["text"])
    value = F.when(bucket["how"] == JOIN, F.call_function("array_join", texts, F.coalesce(bucket["separator"], F.lit(" ")))).otherwise(
        F.coalesce(F.try_element_at(texts, F.lit(-1)), F.lit(""))
    )
    before = F.when(bucket["cut"].isNull(), value).otherwise(F.call_function("substring_index", value, bucket["cut"], F.lit(1)))
    return F.when(bucket["without"].isNull(), before).otherwise(F.replace(before, bucket["without"], F.lit("")))


def _is_item() -> Column:
    first = F.get("words", F.lit(0))
    by_key = (first["x0"] < F.col("key_left_of")) & (F.length(first["text"]) >= F.coalesce("key_min_length", F.lit(0)))
    tokens = F.filter(F.split("line_text", f"[{WHITESPACE_CLASS}]+"), lambda t: t != "")
    by_marker = F.contains("line_text", F.col("marker")) & (F.size(tokens) >= F.coalesce("min_tokens", F.lit(0)))
    return F.coalesce(by_key, F.lit(False)) | F.coalesce(by_marker, F.lit(False))


def _description() -> Column:
    """The line's text, if it may describe the line above."""
    holds_one = F.exists(F.coalesce("not_described", F.array().cast("array<string>")), lambda t: F.contains("line_text", t))
    holds_any = F.exists(
        F.coalesce("not_described_any_case", F.array().cast("array<string>")), lambda t: F.contains(F.upper("line_text"), F.upper(t))
    )
    fits = (F.get("words", F.lit(0))["x0"] > F.col("described_right_of")) & ~holds_one & ~holds_any
    return F.when(fits, F.col("line_text"))


def assemble_mixed(words: DataFrame, rules: DataFrame) -> DataFrame:
    """Visual lines of words of any layouts (column layout), each in its layout's word order, with the layout's rules.

    Words whose layout has no rules give no lines. own_doc is layout and document as one value, by which, with the page, lines lie.
    """
    orders = rules.select(F.col("of").alias("__of"), F.col("reading_order").alias("in_reading_order"))
    ordered = words.withColumn("__at", lookup_value(F.col("layout"))).join(orders, F.col("__at") == F.col("__of")).drop("__at", "__of")
    # the layout is part of what tells pages apart, so it comes along without a value of its own
    own = F.when(F.col("doc_id").isNotNull(), F.struct("layout", "doc_id"))
    lines = assemble_lines(ordered.withColumn("doc_id", own), "declared")
    told = lines.select(F.col("doc_id.layout").alias("layout"), F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id").alias("own_doc"), *[c for c in lines.columns if c != "doc_id"])
    return told.withColumn("__at", lookup_value(F.col("layout"))).join(rules, F.col("__at") == F.col("of")).drop("__at", "of")


def bucket_lines(lines: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Item lines of any layouts to raw columns: layout, doc_id, page, line_key and the fields, empty ones as ''.

    lines: as from assemble_mixed. rules: those that they were assembled with; given them, only item lines get their
    buckets, and no line carries them while a page's lines are put in order.
    """
    page = W.partitionBy("own_doc", "page").orderBy("line_key")  # where they lie already
    # only item lines keep their words through the window
    slim = lines.withColumn("item", _is_item()).withColumn("own", _description()).withColumn("words", F.when(F.col("item"), F.col("words")))
    below = F.lead("own").over(page)
    items = (slim if rules is None else slim.drop("buckets")).withColumn("below", F.coalesce(below, F.lit(""))).where("item")
    if rules is not None:
        items = items.join(rules.select("rule", "buckets"), "rule")
    by_key = F.col("key_left_of").isNotNull()
    rest = F.when(by_key, F.slice("words", 2, F.size("words"))).otherwise(
        F.filter("words", lambda w: F.col("marker").isNull() | (w["text"] != F.col("marker")))
    )
    entries = F.transform("buckets", lambda b: F.struct(b["field"].alias("k"), _value(b, F.col("rest")).alias("v")))
    found = items.withColumn("rest", rest).withColumn("fields", F.map_from_entries(entries))
    field = lambda name: F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(""))
    last = F.try_element_at("words", F.lit(-1))
    usable = (last["x0"] > F.col("fallback_right_of")) & (last["text"] != field("delivery")) & (last["text"] != field("quantity"))
    values = {name: field(name) for name in LINE_FIELDS}
    values["key"] = F.when(by_key, F.get("words", F.lit(0))["text"]).otherwise(field("key"))
    values["price"] = F.when((field("price") == "") & F.coalesce(usable, F.lit(False)), last["text"]).otherwise(field("price"))
    values["description"] = F.when(F.col("described_right_of").isNotNull(), F.col("below")).otherwise(field("description"))
    cleaned = [clean_text(c, "drop_soft_hyphen").alias(n) for n, c in values.items()]
    return found.select("layout", "doc_id", "page", "line_key", *cleaned)


def extract(words: DataFrame, layouts: DataFrame, buckets: DataFrame) -> DataFrame:
    """Canonical order lines of words of any layouts. words: as from read_words, with the layout of the document."""
    rules = layout_rules(layouts, buckets)
    rows = bucket_lines(assemble_mixed(words, rules), rules)
    rows = rows.withColumn("line_seq", line_sequence(F.col("page"), F.col("line_key")))
    return to_order_lines(rows, F.col("layout"), NUMBER_COLUMNS)
