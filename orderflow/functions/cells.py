"""Typed cells: struct<kind, num, txt>, kind one of num, txt, bool, or null when empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.functions import numbers as N
from orderflow.functions.text import strip

CELL = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("num", T.DoubleType()),
        T.StructField("txt", T.StringType()),
    ]
)
# A cell of a template also carries the number that stands in it.
READ_CELL = T.StructType([*CELL.fields, T.StructField("read", T.DoubleType())])


def cell(kind, num, txt) -> Column:
    return F.struct(
        F.lit(kind).cast("string").alias("kind") if not isinstance(kind, Column) else kind.alias("kind"),
        (num if isinstance(num, Column) else F.lit(num)).cast("double").alias("num"),
        (txt if isinstance(txt, Column) else F.lit(txt)).cast("string").alias("txt"),
    )


def text_cell(txt: Column) -> Column:
    return cell("txt", None, txt)


def number_cell(num: Column) -> Column:
    return cell("num", num, None)


def typed_value(c: Column, number: Column | None = None) -> Column:
    """Source text as the value to write, struct<kind, num, txt, force_text>:
    blank to '', identifiers kept as text, numbers parsed, other text untouched.

    number: the parsed number, where it is at hand already.
    """
    s = strip(c)
    number = N.parse_number(c) if number is None else number
    blank = c.isNull() | (s == "")
    ident = N.is_identifier(c)
    is_num = ~blank & ~ident & number.isNotNull()
    return F.struct(
        F.when(is_num, "num").otherwise("txt").alias("kind"),
        F.when(is_num, number).alias("num"),
        F.when(blank, "").when(ident, s).when(~is_num, c).alias("txt"),
        (~blank & ident).alias("force_text"),
    )


def cell_of(df: DataFrame, name: str) -> Column:
    """The value of an ordinary table column as a typed cell."""
    c, dtype = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        kind, num, txt = "txt", None, c
    elif isinstance(dtype, T.BooleanType):
        kind, num, txt = "bool", c.cast("int"), None
    elif isinstance(dtype, T.NumericType):
        kind, num, txt = "num", c, None
    else:
        kind, num, txt = "txt", None, c.cast("string")
    return cell(F.when(c.isNotNull(), kind), num, txt)


def canonical_text(value: Column) -> Column:
    """Lookup form of a typed cell: integral numbers as digits, text stripped, case kept."""
    kind, num, txt = value["kind"], value["num"], value["txt"]
    return (
        F.when(kind == "num", F.when(N.is_integral(num), N.integer_text(num)).otherwise(N.float_text(num)))
        .when(kind == "bool", F.when(num == 1, "True").otherwise("False"))
        .when(kind == "txt", strip(txt))
    )


def canonical_key_of(df: DataFrame, name: str) -> Column:
    """Lookup form of an ordinary table column; whole-number types keep every digit."""
    c, dtype = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return strip(c)
    if isinstance(dtype, (T.IntegralType,)):
        return c.cast("string")
    return canonical_text(cell_of(df, name))


def compare_class(value: Column) -> Column:
    """Two cells count as equal exactly when their compare classes are equal.

    Readable numbers compare as doubles whatever their type, the rest as stripped
    text; empty, null and blank are one class. Being an equivalence, 'unchanged
    against the value now in the cell' is the same as 'unchanged against the update
    before', which is what lets sequences of updates run as a lag.
    """
    return class_of(value, N.parse_number(value["txt"]))


def written_class(value: Column) -> Column:
    """Compare class of a value made by typed_value or planned_value. Its text is known
    not to be a localised number, at most the digits of an identifier."""
    return class_of(value, N.to_double(strip(value["txt"])))


def number_in(kind: Column, num: Column, text_number: Column) -> Column:
    """The number of a cell, of whatever type."""
    return F.when(kind.isin("num", "bool"), num).otherwise(text_number)


def class_of(value: Column, text_number: Column) -> Column:
    """Compare class when the number of the text is at hand."""
    num = number_in(value["kind"], value["num"], text_number)
    return F.struct(
        num.alias("num"),
        F.when(num.isNull(), F.coalesce(strip(value["txt"]), F.lit(""))).alias("txt"),
    )


def same_class(a: Column, b: Column) -> Column:
    return a["num"].eqNullSafe(b["num"]) & a["txt"].eqNullSafe(b["txt"])
