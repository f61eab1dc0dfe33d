"""Layout read from page text: item lines end in six columns of numbers and a date.

Input: pages(doc_id, page, text). A page is one row, so the text lines around an item
line are at hand and the whole extraction runs without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.functions.text import WHITESPACE_CLASS as WS
from orderflow.functions.text import clean_text, strip
from orderflow.operators.order_lines import line_sequence, to_order_lines

HEADERS = ["Itemno", "Description", "Master", "Inner", "Quantity", "Unit price", "Amount", "ETD"]
FIELDS = ["head", "master_pack", "inner_pack", "quantity", "price", "amount", "delivery"]

# The six columns at the end of an item line.
_TAIL = (
    rf"[{WS}]+([\d.]+)[{WS}]+([\d.]+)[{WS}]+([\d.,]+)[{WS}]+([\d.,]+)[{WS}]+([\d.,]+)"
    rf"[{WS}]+([\d.\-\x{{ad}}\x{{2011}}\x{{2013}}\x{{2014}}]+.*)\z"
)
LINE_PATTERN = r"(?s)\A(.*?)" + _TAIL
# The same tail without groups around it, to pick the lines worth taking apart.
TAIL_PATTERN = "(?s)" + _TAIL

LOOKAHEAD_LINES = 39
STOP_WORDS = ["vendor", "itemno", "purchase order"]
DESCRIPTION_WORD = "brand:"


def text_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """Page text to one row per line (counted from 0); empty pages give none."""
    return pages.filter(F.col(text) != "").select(
        "doc_id", "page", F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "text")
    )


def tail_regex_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """Lines that end in the six columns and begin with an item number, taken apart.

    head_rest is what stands between the item number and the columns; following holds
    the next lines, which is where a missing description is looked for.
    """
    lines = pages.filter(F.col(text) != "").select(
        "doc_id", "page", F.split(F.col(text), "\n", -1).alias("lines")
    )
    numbered = F.transform("lines", lambda line, i: F.struct(i.alias("line_no"), line.alias("line")))
    hits = F.filter(numbered, lambda s: s["line"].rlike(TAIL_PATTERN))
    with_next = F.transform(
        hits,
        lambda s: F.struct(
            s["line_no"].alias("line_no"),
            s["line"].alias("line"),
            F.slice("lines", s["line_no"] + 2, LOOKAHEAD_LINES).alias("following"),
        ),
    )
    found = lines.select("doc_id", "page", F.inline(with_next))
    # A line has no line break, so it can separate the groups: one match per line.
    groups = F.split(
        F.regexp_replace("line", LINE_PATTERN, "$1\n$2\n$3\n$4\n$5\n$6\n$7"), "\n", -1
    )
    parts = found.withColumn("parts", groups).withColumns(
        {name: F.col("parts")[i] for i, name in enumerate(FIELDS)}
    )
    head = parts.withColumn("head", strip(F.col("head")))
    return (
        head.withColumn("key", F.regexp_extract("head", rf"\A([0-9]+)(?:[{WS}]|\z)", 1))
        .filter(F.col("key") != "")
        .withColumn("head_rest", strip(F.expr("substring(head, length(key) + 1)")))
        .withColumn("delivery", clean_text(F.col("delivery"), "keep_dashes"))
        .select("doc_id", "page", "line_no", "key", "head_rest", *FIELDS[1:], "following")
    )


def lookahead_description(rows: DataFrame) -> DataFrame:
    """description: the rest of the head, or else the first brand line among the
    following lines unless a line of another section comes before it."""
    probes = F.transform("following", strip)
    starts = "|".join([*STOP_WORDS, DESCRIPTION_WORD])
    telling = F.filter(probes, lambda p: F.lower(p).rlike(rf"\A(?:{starts})"))
    first = F.get(telling, F.lit(0))
    brand = F.when(F.startswith(F.lower(first), F.lit(DESCRIPTION_WORD)), first)
    described = F.when(F.col("head_rest") != "", F.col("head_rest")).otherwise(F.coalesce(brand, F.lit("")))
    return rows.withColumn("description", clean_text(described, "keep_hyphens")).drop("head_rest", "following")


def extract(pages: DataFrame, layout: str = "tail") -> DataFrame:
    rows = lookahead_description(tail_regex_lines(pages))
    rows = rows.withColumn("line_seq", line_sequence(F.col("page"), F.col("line_no")))
    return to_order_lines(rows, layout, ["master_pack", "inner_pack", "quantity", "price", "amount"])
