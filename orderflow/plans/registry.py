"""Layouts: what a document format is called, its columns, its checks, how to read it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.operators import layout_columns, layout_marker, layout_table, layout_tail
from orderflow.operators.columns import find_name, header_position, resolve_by_position


@dataclass(frozen=True)
class Layout:
    """headers: column names in file order, the first being the key.
    fields: the canonical order-line column of each header.
    rules: header of quantity, price and amount (None where there is none).
    extract: words or pages DataFrame to canonical order lines; None for CSV only."""

    name: str
    headers: Sequence[str]
    fields: Sequence[str]
    rules: Mapping[str, str | None]
    extract: Callable[[DataFrame], DataFrame] | None = None
    spellings: Sequence[Sequence[str]] = field(default=())

    def field_of(self, header: str, actual: Sequence[str] | None = None) -> str | None:
        """Canonical column behind a header name, given as in the layout, in a known
        other language, or as one of the document's actual headers."""
        if header in self.fields:
            return header
        for names in [actual or [], self.headers, *self.spellings]:
            name = find_name(names, header)
            if name is not None and list(names).index(name) < len(self.fields):
                return self.fields[list(names).index(name)]
        return None

    def field_rules(self) -> dict[str, str | None]:
        return {role: self.field_of(h) if h else None for role, h in self.rules.items()}


_LAYOUTS: dict[str, Layout] = {}


def register_layout(
    name: str,
    headers: Sequence[str],
    fields: Sequence[str],
    rules: Mapping[str, str | None] | None = None,
    extract: Callable[[DataFrame], DataFrame] | None = None,
    spellings: Sequence[Sequence[str]] = (),
) -> Layout:
    """Add a document format. extract is a DataFrame to DataFrame function; a parser of
    your own may use mapInPandas inside."""
    if extract is not None and not callable(extract):
        raise TypeError(f"layout {name!r}: extract must take and return a DataFrame")
    if len(headers) != len(fields):
        raise ValueError(f"layout {name!r}: {len(headers)} headers but {len(fields)} fields")
    layout = Layout(name, tuple(headers), tuple(fields), dict(rules or {}), extract, tuple(spellings))
    _LAYOUTS[name] = layout
    return layout


def register_table_layout(
    name: str,
    headers: Sequence[str],
    fields: Sequence[str],
    rules: Mapping[str, str | None] | None,
    layouts: DataFrame,
    buckets: DataFrame,
    spellings: Sequence[Sequence[str]] = (),
) -> Layout:
    """Add a document format whose lines are found by rows (see layout_table): those of this name in layouts and buckets."""
    own, ranges = (t.where(F.col("layout") == name) for t in (layouts, buckets))

    def extract(words: DataFrame) -> DataFrame:
        return layout_table.extract(words.withColumn("layout", F.lit(name)), own, ranges)

    return register_layout(name, headers, fields, rules, extract, spellings)


def layout(name: str) -> Layout:
    if name not in _LAYOUTS:
        raise KeyError(f"unknown layout {name!r}, registered: {sorted(_LAYOUTS)}")
    return _LAYOUTS[name]


def layouts() -> dict[str, Layout]:
    return dict(_LAYOUTS)


def extract_lines(source: DataFrame, name: str) -> DataFrame:
    """Canonical order lines of all documents of one layout."""
    chosen = layout(name)
    if chosen.extract is None:
        raise TypeError(f"layout {name!r} has no extract function")
    return chosen.extract(source)


# Header names of the known formats.
SPANISH = ["Artículo", "Denominación", "Cantidad", "Precio", "Importe", "Entrega"]
_COLUMN_FIELDS = ["key", "description", "quantity", "price", "amount", "delivery"]
_QPA = {"qty": "quantity", "price": "price", "amount": "amount"}

register_layout(
    "columns", layout_columns.HEADERS, _COLUMN_FIELDS,
    {"qty": "Quantity", "price": "Price", "amount": "Amount"}, layout_columns.extract, [SPANISH],
)
register_layout(
    "columns_es", SPANISH, _COLUMN_FIELDS,
    {"qty": "Cantidad", "price": "Precio", "amount": "Importe"}, layout_columns.extract,
    [layout_columns.HEADERS],
)
register_layout(
    "marker", layout_marker.HEADERS,
    ["key", "quantity", "other_part_no", "price", "delivery", "description"],
    {"qty": "Quantity", "price": "Price USD", "amount": None}, layout_marker.extract,
)
register_layout(
    "tail", layout_tail.HEADERS,
    ["key", "description", "master_pack", "inner_pack", "quantity", "price", "amount", "delivery"],
    {"qty": "Quantity", "price": "Unit price", "amount": "Amount"}, layout_tail.extract,
)

# The column order a check without metadata expects for the marker format.
MARKER_EXPECTED = ["Quantity", "Your Part No", "Our Part No", "Price USD", "Del. date", "Description"]


def classify_layout(headers: Column) -> Column:
    """Layout of a table by its header names (an array column)."""
    return (
        F.when(F.array_contains(headers, SPANISH[0]), "columns_es")
        .when(F.array_contains(headers, "Item"), "columns")
        .when(F.array_contains(headers, "Our Part No"), "marker")
        .otherwise("tail")
    )


def expected_headers(layout_name: Column) -> Column:
    known = {
        "columns_es": SPANISH,
        "columns": layout_columns.HEADERS,
        "marker": MARKER_EXPECTED,
        "tail": layout_tail.HEADERS,
    }
    expr = F.lit(None).cast("array<string>")
    for name, names in known.items():
        expr = F.when(layout_name == name, F.array(*[F.lit(n) for n in names])).otherwise(expr)
    return expr


def rule_column(layout_name: Column, role: str) -> Column:
    """Header of the quantity, price or amount column for a layout column."""
    expr = F.lit(None).cast("string")
    for name in ("columns_es", "columns", "marker", "tail"):
        header = layout(name).rules.get(role)
        expr = F.when(layout_name == name, F.lit(header).cast("string")).otherwise(expr)
    return expr


def classify_layouts(tables: DataFrame, headers: str = "headers") -> DataFrame:
    """Add to one row per table: layout, expected columns, whether the order is as
    expected, and the rule columns."""
    named = tables.withColumn("layout", classify_layout(F.col(headers)))
    expected = named.withColumn("expected", expected_headers(F.col("layout")))
    return expected.withColumns(
        {
            "columns_ok": F.col(headers) == F.col("expected"),
            "qty_column": rule_column(F.col("layout"), "qty"),
            "price_column": rule_column(F.col("layout"), "price"),
            "amount_column": rule_column(F.col("layout"), "amount"),
        }
    )


__all__ = [
    "Layout", "classify_layout", "classify_layouts", "extract_lines", "header_position",
    "layout", "layouts", "register_layout", "register_table_layout", "resolve_by_position",
]
