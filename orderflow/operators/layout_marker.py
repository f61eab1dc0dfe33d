"""Layout whose item lines carry a unit marker and whose description is the next line.

Numbers below are the page geometry of this layout: fixed values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderflow.functions.text import WHITESPACE_CLASS, clean_text
from orderflow.operators.buckets import Bucket, by_name
from orderflow.operators.lines import PAGE, assemble_lines
from orderflow.operators.order_lines import line_sequence, to_order_lines

HEADERS = ["Our Part No", "Quantity", "Your Part No", "Price USD", "Del. date", "Description"]
MARKER = "STK"
MIN_TOKENS = 4
BUCKETS = [
    Bucket("quantity", None, 130, digits=True),
    Bucket("other_part_no", 130, 250),
    Bucket("key", 250, 370),
    Bucket("delivery", 370, 450),
    Bucket("price", 450, None),
]
FALLBACK_PRICE_RIGHT_OF = 440
DESCRIPTION_RIGHT_OF = 200
NOT_A_DESCRIPTION = [MARKER, "---"]
NOT_A_DESCRIPTION_ANY_CASE = "REMARK"


def is_marker_line():
    tokens = F.filter(F.split("line_text", f"[{WHITESPACE_CLASS}]+"), lambda t: t != "")
    return F.contains("line_text", F.lit(MARKER)) & (F.size(tokens) >= MIN_TOKENS)


def marker_fields(lines: DataFrame) -> DataFrame:
    """Columns of every line by position, without the marker word; price_word is the
    last word of the full line where it may stand in for a missing price."""
    words = F.filter("words", lambda w: w["text"] != MARKER)
    b = by_name(BUCKETS)
    last = F.try_element_at("words", F.lit(-1))
    fields = lines.withColumns(
        {
            "quantity": b["quantity"].last(words),
            "other_part_no": b["other_part_no"].joined(words),
            "key": F.replace(b["key"].joined(words, ""), F.lit(" "), F.lit("")),
            "delivery": b["delivery"].last(words),
            "bucket_price": b["price"].last(words),
        }
    )
    usable = (
        (last["x0"] > FALLBACK_PRICE_RIGHT_OF)
        & (last["text"] != F.col("delivery"))
        & (last["text"] != F.col("quantity"))
    )
    return fields.withColumn(
        "price",
        F.when(F.col("bucket_price") != "", F.col("bucket_price")).when(usable, last["text"]).otherwise(""),
    )


def marker_lines(lines: DataFrame) -> DataFrame:
    """Item lines to raw columns, without the description."""
    return marker_fields(lines.filter(is_marker_line()))


def next_line_description(lines: DataFrame) -> DataFrame:
    """Add to every line the next line of its page if that can be a description, else ''.

    The window runs over the lines of a page, whose number its height bounds.
    """
    fits = F.lit(True)
    for text in NOT_A_DESCRIPTION:
        fits = fits & ~F.contains("line_text", F.lit(text))
    fits = fits & ~F.contains(F.upper("line_text"), F.lit(NOT_A_DESCRIPTION_ANY_CASE))
    fits = fits & (F.get("words", F.lit(0))["x0"] > DESCRIPTION_RIGHT_OF)
    page = W.partitionBy(*PAGE).orderBy("line_key")
    return (
        lines.withColumn("own", F.when(fits, F.col("line_text")).otherwise(""))
        .withColumn("description", F.coalesce(F.lead("own").over(page), F.lit("")))
        .drop("own")
    )


def extract(words: DataFrame, layout: str = "marker") -> DataFrame:
    lines = assemble_lines(words, "reading")
    # Only item lines keep their words through the window's shuffle.
    slim = lines.withColumn("is_item", is_marker_line())
    described = next_line_description(slim).filter("is_item")
    rows = marker_fields(described)
    fields = ["key", "quantity", "other_part_no", "price", "delivery", "description"]
    cleaned = rows.withColumns({c: clean_text(F.col(c), "drop_soft_hyphen") for c in fields})
    cleaned = cleaned.withColumn("line_seq", line_sequence(F.col("page"), F.col("line_key")))
    return to_order_lines(cleaned, layout, ["quantity", "price"])
