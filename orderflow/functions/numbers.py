"""Numbers written as localised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderflow.functions.text import strip

# What may stand around a number.
CURRENCY_MARKS = ["USD", "$", "€"]

_PLAIN_FLOAT = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
_EU_GROUPS = r"\.\d{3},"
_US_GROUPS = r",\d{3}\."
# First part anything but "0", every later part exactly three characters.
_DOT_GROUPS = r"\A(?!0\.)[^.]*(\.[^.]{3})+\z"


def strip_currency(c: Column) -> Column:
    c = strip(c)
    for mark in CURRENCY_MARKS:
        c = F.replace(c, F.lit(mark), F.lit(""))
    return strip(c)


def decimal_text(s: Column) -> Column:
    """Rewrite EU or US grouped text without currency marks to plain decimal text; the
    first matching rule wins."""
    has_dot, has_comma = s.contains("."), s.contains(",")
    return (
        F.when(has_comma & has_dot & s.rlike(_EU_GROUPS), F.translate(s, ",.", "."))
        .when(has_comma & has_dot & s.rlike(_US_GROUPS), F.translate(s, ",", ""))
        .when(has_dot & ~has_comma & s.rlike(_DOT_GROUPS), F.translate(s, ".", ""))
        .when(has_comma & ~has_dot, F.translate(s, ",", "."))
        .otherwise(s)
    )


def to_double(c: Column) -> Column:
    """Plain decimal text to double, null when it is anything else (also nan, inf, 12d)."""
    return F.when(c.rlike(_PLAIN_FLOAT), c.try_cast("double"))


def parse_number(c: Column) -> Column:
    """Localised number text to double, null when it cannot be read.

    For whole columns parse_number_columns is better: it takes the three steps one
    after the other, so that none is repeated where the next one looks twice.
    """
    return to_double(decimal_text(strip_currency(c)))


def is_identifier(c: Column) -> Column:
    """Digits that must stay text: a leading zero, or more digits than a double keeps."""
    return F.coalesce(strip(c).rlike(r"\A(0\d+|\d{16,})\z"), F.lit(False))


def strip_thousands(c: Column) -> Column:
    """Join the groups of integer-like text such as 1.200 or 1,200; strip anything else."""
    s = strip(c)
    return (
        F.when(s.rlike(r"\A\d+(\.\d{3})+\z"), F.translate(s, ".", ""))
        .when(s.rlike(r"\A\d+(,\d{3})+\z"), F.translate(s, ",", ""))
        .otherwise(s)
    )


def is_integral(d: Column) -> Column:
    return d == F.rint(d)


_TWO_62 = 2.0**62


def _all_digits(d: Column) -> Column:
    """Digits of an integral double from 2**120 on: by exact halvings it becomes a whole
    number below 2**54, which is then doubled as often, in groups of nine digits."""
    size = F.abs(d)
    doublings = F.floor(F.log2(size)).cast("int") - 53
    start = F.floor(size / F.pow(F.lit(2.0), doublings.cast("double"))).cast("bigint")
    group = F.lit(10**9).cast("bigint")
    groups = F.array(start % group, F.floor(start / group) % group)

    def doubled(number: Column, _: Column) -> Column:
        carried = F.aggregate(
            number, F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("bigint").alias("carry")),
            lambda s, g: F.struct(
                F.concat(s["done"], F.array((g * 2 + s["carry"]) % group)).alias("done"),
                F.when(g * 2 + s["carry"] >= group, 1).otherwise(0).cast("bigint").alias("carry"),
            ),
            lambda s: F.when(s["carry"] > 0, F.concat(s["done"], F.array(s["carry"]))).otherwise(s["done"]),
        )
        return carried

    number = F.aggregate(F.sequence(F.lit(1), doublings), groups, doubled)
    text = F.array_join(F.transform(F.reverse(number), lambda g: F.lpad(g.cast("string"), 9, "0")), "")
    return F.concat(F.when(d < 0, "-").otherwise(""), F.ltrim(text, F.lit("0")))


def integer_text(d: Column) -> Column:
    """All digits of an integral double. Beyond 2**62 the high and low half are
    converted apart, because double to decimal goes through the short form."""
    high = F.floor(F.abs(d) / _TWO_62).cast("decimal(19,0)")
    low = (F.abs(d) % _TWO_62).cast("bigint").cast("decimal(19,0)")
    wide = (high * F.lit(2**62).cast("decimal(19,0)") + low).cast("string")
    return (
        F.when(F.abs(d) < _TWO_62, d.try_cast("bigint").cast("string"))
        .when(F.abs(d) < 2.0**120, F.concat(F.when(d < 0, "-").otherwise(""), wide))
        .when(F.abs(d) < float("inf"), _all_digits(d))
        .otherwise(d.cast("string"))
    )


def _point_text(d: Column, scale: int) -> Column:
    digits = d.try_cast(f"decimal(38,{scale})").cast("string")
    return F.rtrim(F.rtrim(digits, F.lit("0")), F.lit("."))


def _scientific_text(d: Column) -> Column:
    java = d.cast("string")
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0\z", "")
    exponent = F.substring_index(java, "E", -1).try_cast("int")
    return F.concat(
        mantissa,
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.when(F.abs(exponent) < 10, "0").otherwise(""),
        F.abs(exponent).cast("string"),
    )


def fraction_text(d: Column) -> Column:
    """Shortest decimal text of a non-integral double."""
    size = F.abs(d)
    return (
        F.when(size < 1e-4, _scientific_text(d))
        .when(size < 1, _point_text(d, 30))
        .otherwise(_point_text(d, 18))
    )


def number_text(d: Column) -> Column:
    """Integral numbers without a point, others in shortest decimal form."""
    return F.when(is_integral(d), integer_text(d)).otherwise(fraction_text(d))


def float_text(d: Column) -> Column:
    """A double as text that shows it is one: 90.0, 1234.5, 1e+16."""
    return (
        F.when(is_integral(d) & (F.abs(d) < 1e16), F.concat(integer_text(d), F.lit(".0")))
        .when(is_integral(d), _scientific_text(d))
        .otherwise(fraction_text(d))
    )
