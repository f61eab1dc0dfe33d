"""Words with coordinates to visual lines.

Input: words(doc_id, page, word_seq, x0, top, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.operators.columns import settle, spread_by

PAGE = ["doc_id", "page"]
LINE_TOLERANCE = 3
#: So many words, with their pages, are gathered in a task without being spilled.
PART_WORDS = 2**20

WORD_ORDERS = {
    # The order in which words look for a line to join.
    "extraction": lambda: [F.col("word_seq")],
    "reading": lambda: [F.rint("top"), F.col("x0"), F.col("word_seq")],
    # One of the two for each word, by a column of its own.
    "declared": lambda: [
        F.when(F.col("in_reading_order"), F.rint("top")), F.when(F.col("in_reading_order"), F.col("x0")), F.col("word_seq"),
    ],
}


def _is_placed() -> Column:
    known = [F.col(c).isNotNull() for c in (*PAGE, "top_key")]
    return known[0] & known[1] & known[2]


def _with_top(words: DataFrame) -> DataFrame:
    return words.withColumn("top_key", F.col("top").try_cast("int"))


def unplaced_words(words: DataFrame) -> DataFrame:
    """Per document the words without a page or a top, which are on no line."""
    return _with_top(words).groupBy("doc_id").agg(F.count_if(~_is_placed()).alias("unplaced_words")).filter("unplaced_words > 0")


def _order(kind: str) -> Column:
    """Sort value of a word; a plain column where one is enough."""
    columns = WORD_ORDERS[kind]()
    return columns[0] if len(columns) == 1 else F.struct(*[c.alias(f"o{i}") for i, c in enumerate(columns)])


def _pages(words: DataFrame, keep: Column, order: str, tolerance: int) -> DataFrame:
    """Pages with their words, and the line of each distinct top. keep: what of a word is needed.

    A word joins the first line opened whose anchor is less than the tolerance away from
    its whole-number top, else it opens a line there. Which line that is depends on the
    top alone: a top that opened a line finds it again, and one that joined a line keeps
    joining it, as later lines come later in the search. So the anchors are found from the
    distinct tops of a page, in the order of their first words. The words are shuffled
    once, by page, which is as much as one sheet holds. They are counted first, so that the
    parts do not grow with the words; of a table that is a look at its footers.
    """
    parts = 0 if words.isStreaming else -(-words.count() // PART_WORDS)
    placed = _with_top(words).filter(_is_placed()).drop("top_key")
    # a word travels as its plain columns; what they are put in order by is made of them behind the exchange
    entry = F.struct(_order(order).alias("first"), "top_key", keep.alias("word"))
    pages = _with_top(spread_by(placed, *PAGE, parts=parts)).groupBy(*PAGE).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    near = lambda anchor, top: F.abs(anchor - top) < tolerance
    with_tops = settle(pages, {"tops": F.array_distinct(F.transform("entries", lambda e: e["top_key"]))})
    anchors = F.aggregate(
        "tops", F.array().cast("array<int>"),
        lambda done, top: F.when(F.exists(done, lambda a: near(a, top)), done).otherwise(F.concat(done, F.array(top))),
    )
    with_anchors = settle(with_tops, {"anchors": anchors})
    return settle(with_anchors, {"keys": F.transform("tops", lambda top: F.get(F.filter("anchors", lambda a: near(a, top)), F.lit(0)))})


def _words_on_lines(words: DataFrame, keep: Column, order: str, tolerance: int) -> DataFrame:
    """One row per word: page, line_key and what is kept of it."""
    found = _pages(words, keep, order, tolerance).select(*PAGE, "tops", "keys", F.explode("entries").alias("e"))
    line = F.get(F.col("keys"), (F.array_position("tops", F.col("e.top_key")) - 1).cast("int"))
    return found.select(*PAGE, line.alias("line_key"), "e.first", "e.word")


def cluster_lines(words: DataFrame, order: str = "extraction", tolerance: int = LINE_TOLERANCE) -> DataFrame:
    """Every word with the key of its visual line."""
    others = [c for c in words.columns if c not in PAGE]
    found = _words_on_lines(words, F.struct(*others), order, tolerance)
    return found.select(*PAGE, *[F.col(f"word.{c}").alias(c) for c in others], "line_key")


def assemble_lines(words: DataFrame, order: str = "extraction", tolerance: int = LINE_TOLERANCE) -> DataFrame:
    """Visual lines: words(array by x0) and line_text. A line is as long as a page is wide."""
    entry = F.struct("word.x0", F.col("first").alias("tie"), "word.text")
    lines = _words_on_lines(words, F.struct("x0", "text"), order, tolerance).groupBy(*PAGE, "line_key").agg(
        F.sort_array(F.collect_list(entry)).alias("sorted")
    )
    return lines.select(
        *PAGE,
        "line_key",
        F.transform("sorted", lambda w: F.struct(w["x0"].alias("x0"), w["text"].alias("text"))).alias("words"),
        F.array_join(F.transform("sorted", lambda w: w["text"]), " ").alias("line_text"),
    )
