"""Column selection, header mapping and column-wise conversions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.functions import cells as C
from orderflow.functions import numbers as N
from orderflow.functions import text as X


class EmptyInputError(ValueError):
    """There are no rows to work on."""


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail when there is no row at all; looks at one row only."""
    if df.isEmpty():
        raise EmptyInputError(f"{what} is empty")
    return df


def find_name(names: Sequence[str], wanted: str) -> str | None:
    """First name equal to the wanted one but for case."""
    return next((n for n in names if n.lower() == wanted.lower()), None)


def _reject_duplicates(df: DataFrame) -> None:
    lowered = [c.lower() for c in df.columns]
    twice = sorted({c for c in lowered if lowered.count(c) > 1})
    if twice:
        raise ValueError(f"duplicate column names: {twice}")


def select_key_and_columns(
    df: DataFrame, columns: Sequence[str], key: str | None = None
) -> tuple[DataFrame, list[str]]:
    """Key column (the first by default) and the requested columns, each once.

    Returns the selection and the requested names that do not exist.
    """
    _reject_duplicates(df)
    key = key or df.columns[0]
    found = {wanted: find_name(df.columns, wanted) for wanted in columns}
    chosen = dict.fromkeys([key] + [name for name in found.values() if name is not None])
    missing = [wanted for wanted, name in found.items() if name is None]
    return df.select(*[F.col(f"`{name}`") for name in chosen]), missing


def resolve_by_position(name: str | None, headers: Sequence[str], columns_meta: Sequence[str] | None):
    """Header that stands for a canonical name: itself if present, else the one at its position."""
    if not name or not headers or not columns_meta or name in headers:
        return name
    position = next((i for i, c in enumerate(columns_meta) if c.lower() == name.lower()), None)
    return headers[position] if position is not None and position < len(headers) else name


def rename_by_position(df: DataFrame, columns_meta: Sequence[str]) -> DataFrame:
    """Localised headers to canonical names; columns beyond the list keep theirs."""
    source = {name: resolve_by_position(name, df.columns, columns_meta) for name in columns_meta}
    known = {name: actual for name, actual in source.items() if actual in df.columns}
    rest = [c for c in df.columns if c not in known.values()]
    return df.select(
        *[F.col(f"`{actual}`").alias(name) for name, actual in known.items()],
        *[F.col(f"`{c}`") for c in rest],
    )


def header_position(headers: Column, name: str, columns_meta: Sequence[str]) -> Column:
    """The same rule when headers are data: zero-based position of a canonical name."""
    by_name = F.array_position(headers, name) - 1
    position = next((i for i, c in enumerate(columns_meta) if c.lower() == name.lower()), None)
    return F.when(by_name >= 0, by_name).when(
        F.size(headers) > F.lit(position), F.lit(position)
    ).cast("int")


def conform_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly these columns in this order, missing ones as empty text."""
    present = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in present else F.lit("").alias(c) for c in columns])


def _map_columns(df: DataFrame, columns: Sequence[str], fn) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: fn(F.col(f"`{c}`")) for c in present})


def clean_text_columns(df: DataFrame, columns: Sequence[str], variant: str) -> DataFrame:
    return _map_columns(df, columns, lambda c: X.clean_text(c, variant))


def normalize_numeric_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Localised numbers to canonical decimal text; unreadable text stays as it is."""
    present = [c for c in columns if c in df.columns]
    parsed = parse_number_columns(df, present, "__num")
    texts = {c: F.coalesce(N.number_text(F.col(f"`{c}__num`")), F.col(f"`{c}`")) for c in present}
    return parsed.withColumns(texts).drop(*[f"{c}__num" for c in present])


def strip_thousands_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _map_columns(df, columns, N.strip_thousands)


def coerce_typed_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    parsed = parse_number_columns(df, columns, "__num")
    values = {c: C.typed_value(F.col(f"`{c}`"), F.col(f"`{c}__num`")) for c in columns if c in df.columns}
    return parsed.withColumns(values).drop(*[f"{c}__num" for c in values])


def parse_number_columns(df: DataFrame, columns: Sequence[str], suffix: str = "_num") -> DataFrame:
    """Add the parsed double next to each text column."""
    return add_numbers(df, {f"{c}{suffix}": F.col(f"`{c}`") for c in columns if c in df.columns})


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add (or replace) columns that are worked out once per row.

    They go through a generator of one row. Behind a plain projection the optimizer
    would copy the whole expressions into every filter above, and where one step looks
    at another several times, that multiplies up.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def spread_by(df: DataFrame, *columns: str, parts: int = 0) -> DataFrame:
    """Rows exchanged by some columns, into as many parts as the session's shuffles have, or parts if that is more.

    For what is grouped or put in order behind it: no part of the rows is sorted before the
    exchange, as a list that is gathered on both sides would be, and the parts are not put together again
    by their compressed size, which says little of the memory that words and cells take.
    """
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *columns)


def add_numbers(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """Add columns with the number of each text, in three steps that look at one value
    each, so that no step is repeated where the next one looks twice."""
    if not texts:
        return df
    staged = df.withColumns({f"__{name}": N.strip_currency(c) for name, c in texts.items()})
    staged = staged.withColumns({f"__{name}": N.decimal_text(F.col(f"`__{name}`")) for name in texts})
    settled = settle(staged, {name: N.to_double(F.col(f"`__{name}`")) for name in texts})
    return settled.drop(*[f"__{name}" for name in texts])


def apply_null_markers(df: DataFrame) -> DataFrame:
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return _map_columns(df, texts, X.null_markers_to_null)


def identifier_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, identifier-like values and their share. One pass, one row per column."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(N.is_identifier(F.col(f"`{c}`"))).alias(f"n{i}") for i, c in enumerate(columns)],
    )
    entries = [
        F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"n{i}").alias("identifiers"))
        for i, c in enumerate(columns)
    ]
    return (
        counts.select(F.inline(F.array(*entries)))
        .withColumn("share", F.when(F.col("rows") > 0, F.col("identifiers") / F.col("rows")))
    )
