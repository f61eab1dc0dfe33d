"""Checks on order lines: unreadable numbers, wrong totals, suspicious characters."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.functions import text as X
from orderflow.operators.columns import parse_number_columns

# Characters that point to a broken extraction, and their names.
SUSPICIOUS_CHARACTERS = {
    X.SOFT_HYPHEN: "Soft Hyphen",
    X.NON_BREAKING_HYPHEN: "Non-breaking Hyphen",
    X.REPLACEMENT_CHARACTER: "Replacement Character",
}
TOTAL_MISMATCH = "Total Mismatch"

Rules = Mapping[str, "str | None"]  # qty, price, amount -> column name
ROLES = ("qty", "price", "amount")


@dataclass
class Validated:
    """Outcome of validate(): rows kept, rows set aside with reasons, flagged cells.

    checked holds all rows with their reasons, which everything else is derived from; derive
    makes the outcome of such rows, wherever they have been kept.
    """

    clean: DataFrame
    rejects: DataFrame
    flags: DataFrame
    checked: DataFrame | None = None
    derive: Callable[[DataFrame], Validated] | None = None


def rule_columns(df: DataFrame, rules: Rules) -> list[str]:
    named = [rules.get(role) for role in ROLES]
    return [c for c in named if c and c in df.columns]


def _number(column: str) -> Column:
    """The number of a text cell. A column parsed before (suffix _num) is used as it is:
    normalised text must not be read a second time, 1.234 would turn into 1234."""
    return F.col(f"`{column}_num`")


def with_numbers(df: DataFrame, rules: Rules) -> DataFrame:
    """The rule columns' numbers as columns, for those that have none yet."""
    missing = [c for c in rule_columns(df, rules) if f"{c}_num" not in df.columns]
    return parse_number_columns(df, missing)


def with_reject_reasons(df: DataFrame, rules: Rules) -> DataFrame:
    """Add reject_reasons: the cells of a row that hold text where a number belongs."""
    df = with_numbers(df, rules)
    reasons = []
    for column in rule_columns(df, rules):
        text = F.col(f"`{column}`")
        bad = text.isNotNull() & (text != "") & _number(column).isNull()
        reasons.append(F.when(bad, F.struct(F.lit(column).alias("column"), text.alias("value"))))
    empty = F.array().cast("array<struct<column:string,value:string>>")
    return df.withColumn("reject_reasons", F.array_compact(F.array(*reasons)) if reasons else empty)


def split_invalid_numeric(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Rows whose numbers can be read, and the others with their reasons. Both narrow."""
    checked = with_reject_reasons(df, rules)
    clean = checked.filter(F.size("reject_reasons") == 0)
    rejects = checked.filter(F.size("reject_reasons") > 0)
    return clean.select(*df.columns), rejects.select(*df.columns, "reject_reasons")


def total_differs(quantity: Column, price: Column, amount: Column) -> Column:
    """quantity x price is off by more than 1 and by more than 1 % of the amount."""
    difference = F.abs(quantity * price - amount)
    return F.coalesce((difference > 1.0) & (difference > amount * 0.01), F.lit(False))


def _total_flags(df: DataFrame, rules: Rules) -> Column | None:
    names = [rules.get(role) for role in ROLES]
    if not all(name and name in df.columns for name in names):
        return None
    wrong = total_differs(*[_number(name) for name in names])
    cells = F.array(*[_flag(F.lit(name), F.lit(TOTAL_MISMATCH)) for name in names])
    return F.when(wrong, cells).otherwise(F.array().cast("array<struct<column:string,reason:string>>"))


def _flag(column: Column, reason: Column) -> Column:
    return F.struct(column.alias("column"), reason.alias("reason"))


def text_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in skip
    ]


def _character_flags(columns: Sequence[str]) -> Column:
    """One flag per cell and kind of character, as an array over the row's cells."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns]
    )
    dirty = F.filter(cells, lambda c: c["value"].rlike("[" + "".join(SUSPICIOUS_CHARACTERS) + "]"))
    kinds = F.array(
        *[F.struct(F.lit(ch).alias("ch"), F.lit(name).alias("name")) for ch, name in SUSPICIOUS_CHARACTERS.items()]
    )
    per_cell = F.transform(
        dirty,
        lambda c: F.transform(
            F.filter(kinds, lambda k: F.contains(c["value"], k["ch"])),
            lambda k: _flag(c["column"], k["name"]),
        ),
    )
    return F.flatten(per_cell)


def _explode_flags(df: DataFrame, flags: Column, key: str, doc: str) -> DataFrame:
    return df.select(
        F.col(doc).alias("doc_id"), X.strip(F.col(f"`{key}`")).alias("key"), F.explode(flags).alias("f")
    ).select("doc_id", "key", "f.column", "f.reason")


def line_total_mismatch(df: DataFrame, rules: Rules, key: str, doc: str = "doc_id") -> DataFrame:
    """Flags on quantity, price and amount of rows whose total is wrong."""
    df = with_numbers(df, rules)
    flags = _total_flags(df, rules)
    if flags is None:
        flags = F.array().cast("array<struct<column:string,reason:string>>")
    return _explode_flags(df, flags, key, doc)


def suspicious_chars(
    df: DataFrame, key: str, doc: str = "doc_id", columns: Sequence[str] | None = None
) -> DataFrame:
    """Flags on cells with a soft hyphen, non-breaking hyphen or replacement character."""
    columns = columns if columns is not None else text_columns(df, skip=[doc])
    return _explode_flags(df, _character_flags(columns), key, doc)


def flag_union(*flags: DataFrame) -> DataFrame:
    """Union with set semantics on (doc_id, key, column); the reasons are gathered,
    of which there are as many as checks."""
    merged = flags[0]
    for more in flags[1:]:
        merged = merged.unionByName(more)
    return merged.groupBy("doc_id", "key", "column").agg(
        F.sort_array(F.collect_set("reason")).alias("reasons")
    )


def flag_counts(flags: DataFrame) -> DataFrame:
    """Distinct flagged cells per document and reason. The distinct runs on the full key
    first, so a document with very many flags is spread over tasks."""
    cells = flags.select("doc_id", "reason", "key", "column").distinct()
    return cells.groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("cells"))


def validate(
    df: DataFrame,
    rules: Rules,
    key: str | None = None,
    doc: str = "doc_id",
    columns: Sequence[str] | None = None,
) -> Validated:
    """Set unreadable rows aside, then check totals and characters of the remaining ones.

    Both checks read a row once and leave through one explode; the only shuffle is the
    one that makes flags distinct.
    """
    key = key or next(c for c in df.columns if c != doc)
    columns = columns if columns is not None else text_columns(df, skip=[doc])
    names = df.columns

    def derive(checked: DataFrame) -> Validated:
        clean = checked.filter(F.size("reject_reasons") == 0)
        rejects = checked.filter(F.size("reject_reasons") > 0)
        found = _character_flags(columns)
        totals = _total_flags(clean, rules)
        if totals is not None:
            found = F.concat(totals, found)
        flags = flag_union(_explode_flags(clean, found, key, doc))
        return Validated(clean.select(*names), rejects.select(*names, "reject_reasons"), flags, checked, derive)

    return derive(with_reject_reasons(df, rules))


def validation_report(
    df: DataFrame,
    rules: Rules,
    key: str | None = None,
    doc: str = "doc_id",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Per document: rows, rows set aside, flagged cells. All documents in one job."""
    key = key or next(c for c in df.columns if c != doc)
    columns = columns if columns is not None else text_columns(df, skip=[doc])
    checked = with_reject_reasons(df, rules)
    rejected = F.size("reject_reasons") > 0
    found = _character_flags(columns)
    totals = _total_flags(checked, rules)
    if totals is not None:
        found = F.concat(totals, found)
    # a row is one entry of its own, and one for each of its marks if it is kept
    row = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("reason")))
    entries = checked.select(
        F.col(doc).alias("doc_id"), X.strip(F.col(f"`{key}`")).alias("key"), rejected.alias("rejected"),
        F.explode(F.when(rejected, row).otherwise(F.concat(row, found))).alias("f"),
    )
    is_row = F.col("f.reason").isNull()
    cells = entries.groupBy("doc_id", F.when(~is_row, F.col("key")).alias("key"), F.col("f.column").alias("column")).agg(
        F.count_if(is_row).alias("rows_in"), F.count_if(is_row & F.col("rejected")).alias("rows_removed"),
        F.max((~is_row).cast("bigint")).alias("cell"),
    )
    return cells.groupBy("doc_id").agg(
        F.sum("rows_in").alias("rows_in"), F.sum("rows_removed").alias("rows_removed"), F.sum("cell").alias("cells_flagged")
    )
