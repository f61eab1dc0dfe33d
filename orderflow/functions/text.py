"""Text clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the body of a regular expression class.
WHITESPACE_CLASS = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

SOFT_HYPHEN = "\u00ad"
NON_BREAKING_HYPHEN = "\u2011"
EN_DASH = "\u2013"
EM_DASH = "\u2014"
REPLACEMENT_CHARACTER = "\ufffd"

# Cell texts that a CSV reader of data frames takes as missing.
NULL_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

CLEAN_VARIANTS = ("drop_soft_hyphen", "keep_hyphens", "keep_dashes")


def strip(c: Column) -> Column:
    """Remove Unicode whitespace on both sides; SQL trim() only knows the blank."""
    return F.trim(c, F.lit(WHITESPACE))


def null_markers_to_null(c: Column) -> Column:
    return F.when(~c.isin(NULL_MARKERS), c)


def clean_text(c: Column, variant: str) -> Column:
    """Hyphen clean-up of extracted text.

    drop_soft_hyphen: soft hyphens vanish, non-breaking ones become '-', ends stripped.
    keep_hyphens:     both become '-', ends untouched.
    keep_dashes:      as keep_hyphens, and en and em dashes become '-' too.
    """
    if variant == "drop_soft_hyphen":
        return strip(F.translate(c, NON_BREAKING_HYPHEN + SOFT_HYPHEN, "-"))
    if variant == "keep_hyphens":
        return F.translate(c, SOFT_HYPHEN + NON_BREAKING_HYPHEN, "--")
    if variant == "keep_dashes":
        return F.translate(c, SOFT_HYPHEN + NON_BREAKING_HYPHEN + EN_DASH + EM_DASH, "----")
    raise ValueError(f"unknown variant {variant!r}, expected one of {CLEAN_VARIANTS}")
