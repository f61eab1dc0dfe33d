"""Layout with one line per item and columns by position; headers in any language.

Numbers below are the page geometry of this layout: fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions.text import clean_text
from orderflow.operators.buckets import Bucket, by_name
from orderflow.operators.lines import assemble_lines
from orderflow.operators.order_lines import line_sequence, to_order_lines

HEADERS = ["Item", "Description", "Quantity", "Price", "Amount", "Delivery"]
HEADER_WORDS = ["quantity", "cantidad", "description", "descripcion"]

HEADER_BUCKETS = [
    Bucket("Item", None, 100),
    Bucket("Description", 100, 260),
    Bucket("Quantity", 260, 330),
    Bucket("Price", 330, 420),
    Bucket("Amount", 440, 490),
    Bucket("Delivery", 490, None, above_low=True),
]
DATA_BUCKETS = [
    Bucket("description", 100, 260),
    Bucket("quantity", 260, 310, digits=True),
    Bucket("price", 360, 420),
    Bucket("amount", 440, 490),
    Bucket("delivery", 490, None, above_low=True),
]
ITEM_RIGHT_OF, ITEM_MIN_LENGTH = 50, 10


def _is_header(line_text: Column) -> Column:
    return F.lower(line_text).rlike("|".join(HEADER_WORDS))


def detect_headers(lines: DataFrame) -> DataFrame:
    """Per document the header texts of its first header line, in document order; a
    column without words there, or a document without such a line, gets the default.

    The first line is a minimum, so it is combined before the shuffle.
    """
    found = F.struct(
        "page",
        "line_key",
        *[F.nullif(b.joined(F.col("words")), F.lit("")).alias(b.column) for b in HEADER_BUCKETS],
    )
    first = lines.groupBy("doc_id").agg(
        F.min(F.when(_is_header(F.col("line_text")), found)).alias("h")
    )
    return first.select(
        "doc_id",
        F.col("h").isNotNull().alias("detected"),
        F.array(*[F.coalesce(F.col(f"h.{name}"), F.lit(name)) for name in HEADERS]).alias("headers"),
    )


def item_lines(lines: DataFrame) -> DataFrame:
    """Lines that begin with an item number: far left and long enough."""
    first = F.get("words", F.lit(0))
    return lines.filter((first["x0"] < ITEM_RIGHT_OF) & (F.length(first["text"]) >= ITEM_MIN_LENGTH))


def bucket_lines(lines: DataFrame) -> DataFrame:
    """Item lines to raw columns. Text columns join their words, the others keep the
    last; words between the columns are dropped; of a price only the part before '/'."""
    words = F.slice("words", 2, F.size("words"))
    b = by_name(DATA_BUCKETS)
    cleaned = lambda c: clean_text(c, "drop_soft_hyphen")
    return item_lines(lines).select(
        "doc_id",
        "page",
        "line_key",
        cleaned(F.col("words")[0]["text"]).alias("key"),
        cleaned(b["description"].joined(words)).alias("description"),
        cleaned(b["quantity"].last(words)).alias("quantity"),
        cleaned(F.substring_index(b["price"].last(words), "/", 1)).alias("price"),
        cleaned(b["amount"].last(words)).alias("amount"),
        cleaned(b["delivery"].last(words)).alias("delivery"),
    )


def extract(words: DataFrame, layout: str = "columns") -> DataFrame:
    rows = bucket_lines(assemble_lines(words, "extraction"))
    rows = rows.withColumn("line_seq", line_sequence(F.col("page"), F.col("line_key")))
    return to_order_lines(rows, layout, ["quantity", "price", "amount"])
