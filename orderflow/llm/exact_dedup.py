"""Exact deduplication: two passes of a Bloom filter find what may be repeated, and only those rows are shuffled.

1. Every row gets a number and the SHA-256 of its normalised text; with the columns asked
   for they are written once, so what follows reads some tens of bytes a row.
2. First pass. A filter has a word of 64 bits for every few rows; a row's hash picks a
   word and a bit. In a word whose rows outnumber its bits two rows share a bit. Texts
   that are equal always do, so a row whose word has no such clash stands alone.
   What is gathered a word is a long and a count, combined before it travels.
3. Second pass. The rows that the first one leaves go through a filter of their own, with
   another hash, which lets go those that clashed by chance.
4. Rows that both passes hold possible are grouped by their digest; the others pass
   straight through, without a shuffle.

The words with clashes reach the tasks as a bitmap, one bit a word: at most MOST_WORDS
bits, 8 MB. Beyond ROWS_PER_WORD * MOST_WORDS rows the hashes are cut into slices, with
a filter for each; the rows are written slice by slice, so that every slice reads its own only.
Slices and words only decide what is shuffled, never which texts are equal.

All steps are DataFrame functions. Results: a null text counts as empty, and all empty texts
are equal. Of equal texts the row with the largest id stays, a row without an id
only where none has one; of several rows with that id one stays, and as they are equal in
id and text it does not matter which. Texts of any length are hashed whole. An empty table gives
an empty result. Extra columns are left out, or kept by keep_one_copy, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import lowered, text_of
from orderflow.staging import shared_folder, staged

#: Rows of a filter for each of its words, and the most words of a filter.
ROWS_PER_WORD, MOST_WORDS = 4, 2**26

#: Bits of a word, and words (one bit each) of a block of the bitmap, which is what bitmap_construct_agg builds.
WORD_BITS, BLOCK = 64, 32768


def normalised(text: Column) -> Column:
    """A-Z in lower case, all else as it is. lower() does the same to ASCII text, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(lowered(text))


def digests(docs: DataFrame, columns: Sequence[str], slices: int) -> DataFrame:
    """number, kept columns (a struct), digest and slice of every row, written once."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
        F.col("`doc_id`").cast("bigint").alias("id"), F.unhex(F.sha2(normalised(text_of()), 256)).alias("digest"),
    ).select(F.monotonically_increasing_id().alias("number"), "row", "id", "digest")
    if slices == 1:
        return staged(rows).withColumn("slice", F.lit(0))
    path = f"{shared_folder(docs.sparkSession)}/staged-{uuid.uuid4().hex}"
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("digest", F.lit("slice")), F.lit(slices)).cast("int"))
    sliced.write.partitionBy("slice").parquet(path)
    return docs.sparkSession.read.schema(sliced.schema).parquet(path)


def _word(words: int, seed: int) -> tuple[Column, Column]:
    """The word and the bit of a row."""
    code = F.xxhash64("digest", F.lit(seed))
    return F.pmod(F.shiftrightunsigned(code, 6), F.lit(words)), code.bitwiseAND(WORD_BITS - 1).cast("int")


def clashes(rows: DataFrame, words: int, seed: int) -> DataFrame:
    """The filter: block and bitmap, a bit for every word in which two rows share a bit."""
    word, bit = _word(words, seed)
    seen = rows.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(
        F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count(F.lit(1)).alias("n")
    ).where(F.col("n") > F.bit_count("bits"))
    return seen.groupBy(F.expr(f"word div {BLOCK}").alias("block")).agg(F.bitmap_construct_agg(F.col("word") % BLOCK).alias("bitmap"))


def possible(rows: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows whose text may occur again, and those whose text cannot."""
    words = max(1, min(MOST_WORDS, rows.count() // ROWS_PER_WORD))
    bitmap = F.broadcast(clashes(rows, words, seed))  # at most MOST_WORDS bits
    place = F.col("__word") % BLOCK
    byte = F.conv(F.hex(F.expr(f"substring(bitmap, cast(__word % {BLOCK} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    probed = rows.withColumn("__word", _word(words, seed)[0]).withColumn("__block", F.expr(f"__word div {BLOCK}")).join(
        bitmap, F.col("__block") == F.col("block"), "left"
    ).withColumn("__held", held).select(*rows.columns, "__held")
    return probed.where("__held").drop("__held"), probed.where("not __held").drop("__held")


def _settled(rows: DataFrame) -> DataFrame:
    """Rows of one slice with keep_id, group_size and kept."""
    first, alone = possible(rows, 1)
    both, chance = possible(first, 2)
    straight = alone.unionByName(chance).select(
        "row", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept")
    )
    groups = both.groupBy("digest").agg(F.max(F.struct("id", "number")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    # joined on structs, so that the rows of a large group can be split over tasks
    groups = groups.select(F.struct("digest").alias("of"), "best", "group_size")
    joined = both.withColumn("__of", F.struct("digest")).join(groups, F.col("__of") == F.col("of"))
    return straight.unionByName(joined.select(
        "row", "digest", F.col("best.id").alias("keep_id"), "group_size", (F.col("number") == F.col("best.number")).alias("kept")
    ))


def settled(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """row (a struct of the columns), digest, keep_id, group_size and kept of every document."""
    slices = max(1, -(-docs.count() // (ROWS_PER_WORD * MOST_WORDS)))
    rows = digests(docs, columns, slices)
    parts = [_settled(rows.where(F.col("slice") == s).drop("slice")) for s in range(slices)]
    return reduce(DataFrame.unionByName, parts)


def mark_copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row, dropped ones too. docs: doc_id, text."""
    return settled(docs, ["doc_id"]).select(
        "row.doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_one_copy(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns. Their texts are written once and move only where they may be repeated."""
    return settled(docs, docs.columns).where("kept").select("row.*")
