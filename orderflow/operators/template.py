"""The template that order lines are merged into, and how its rows and columns are found.

Two forms: a grid, cells(row_idx, col_idx, kind, num, txt), which is what a sheet is; and
an ordinary wide table with a key column. Either becomes a Template: one row per lookup
key with the cells that a merge may touch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.functions import cells as C
from orderflow.operators.columns import add_numbers, find_name

PER_CARTON, PER_PALLET = "Pcs/Ctn", "Pcs/Plt"


@dataclass
class Template:
    """rows: key, row_idx and, per position used, a cell column struct<kind, num, txt, read>
    (see cell_column); read is the number in the cell, also where it is text.
    positions: lower-cased target name to column index; missing names are not in it."""

    rows: DataFrame
    positions: dict[str, int]

    def position(self, name: str) -> int | None:
        return self.positions.get(name.lower())

    def cell(self, position: int) -> Column:
        return F.col(cell_column(position))

    @property
    def can_pack(self) -> bool:
        return None not in (self.position(PER_CARTON), self.position(PER_PALLET))


@dataclass
class Templates:
    """Any number of templates as tables.

    rows: template (its name), key, row_idx and cells, a map from position to the cell.
    positions: template, name (lower-cased) and position of the columns that are looked for.
    """

    rows: DataFrame
    positions: DataFrame


def cell_column(position: int) -> str:
    return f"cell_{position}"


def grid_from_table(df: DataFrame, row: str, columns: Sequence[str] | None = None, header: bool = True) -> DataFrame:
    """A wide table as a grid: row 0 holds the column names, the row with row number n
    becomes n + 1. Empty cells are left out."""
    columns = list(columns) if columns is not None else [c for c in df.columns if c != row]
    entries = [
        F.struct(F.lit(i).alias("col_idx"), C.cell_of(df, c).alias("cell")) for i, c in enumerate(columns)
    ]
    body = df.select((F.col(row).cast("bigint") + 1).alias("row_idx"), F.inline(F.array(*entries)))
    grid = body.select("row_idx", "col_idx", "cell.*").filter("kind is not null and not (txt <=> '')")
    if not header:
        return grid.withColumn("row_idx", F.col("row_idx") - 1)
    names = [(0, i, "txt", None, c) for i, c in enumerate(columns)]
    spark = df.sparkSession
    return spark.createDataFrame(names, "row_idx bigint, col_idx int, kind string, num double, txt string").union(grid)


def _with_value(cells: DataFrame) -> DataFrame:
    value = C.canonical_text(F.struct("kind", "num", "txt"))
    return cells.withColumn("value", value).filter(F.col("value") != "")


def first_row_index(cells: DataFrame, key_column: int | None = None) -> DataFrame:
    """Canonical value to the first row that holds it, in any column or in one."""
    if key_column is not None:
        cells = cells.filter(F.col("col_idx") == key_column)
    return _with_value(cells).groupBy("value").agg(F.min("row_idx").alias("row_idx"))


def first_col_index(cells: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Lower-cased value to the column of its first cell, row by row. With names only
    those are looked for, which cuts the cells down before anything is shuffled."""
    valued = _with_value(cells).withColumn("name", F.lower("value"))
    if names is not None:
        valued = valued.filter(F.col("name").isin([n.lower() for n in names]))
    return valued.groupBy("name").agg(F.min(F.struct("row_idx", "col_idx"))["col_idx"].alias("col_idx"))


def template_from_cells(cells: DataFrame, names: Sequence[str], key_column: int | None = None) -> Template:
    """Template of a grid. A key is looked up in every cell unless key_column is given.

    The positions of the target columns come to the driver: one number per name.
    """
    wanted = [*names, PER_CARTON, PER_PALLET]
    positions = {r["name"]: r["col_idx"] for r in first_col_index(cells, wanted).collect()}
    used = sorted(set(positions.values()))
    value = F.struct("kind", "num", "txt", C.number_in(F.col("kind"), F.col("num"), F.col("text_number")).alias("read"))
    inside = add_numbers(cells.filter(F.col("col_idx").isin(used)), {"text_number": F.col("txt")})
    rows = inside.groupBy("row_idx").agg(
        *[F.first(F.when(F.col("col_idx") == i, value), ignorenulls=True).alias(cell_column(i)) for i in used]
    )
    index = first_row_index(cells, key_column).withColumnRenamed("value", "key")
    return Template(index.join(rows, "row_idx", "left"), positions)


def template_from_table(df: DataFrame, key: str, names: Sequence[str], row: str) -> Template:
    """Template of a wide table; row numbers the rows, the lowest one of a key wins."""
    columns = [c for c in df.columns if c != row]
    resolved = {n.lower(): find_name(columns, n) for n in [*names, PER_CARTON, PER_PALLET]}
    positions = {n: columns.index(c) for n, c in resolved.items() if c is not None}
    used = sorted(set(positions.values()))
    keyed = df.select(
        C.canonical_key_of(df, key).alias("key"),
        F.col(row).cast("bigint").alias("row_idx"),
        *[C.cell_of(df, columns[i]).alias(f"plain_{i}") for i in used],
    )
    keyed = add_numbers(keyed.filter(F.col("key") != ""), {f"read_{i}": F.col(f"plain_{i}.txt") for i in used})
    cells = []
    for i in used:
        c = F.col(f"plain_{i}")
        read = C.number_in(c["kind"], c["num"], F.col(f"read_{i}"))
        cells.append(F.struct(*[c[n].alias(n) for n in ("kind", "num", "txt")], read.alias("read")).alias(cell_column(i)))
    first = keyed.groupBy("key").agg(F.min_by(F.struct("row_idx", *cells), "row_idx").alias("r"))
    return Template(first.select("key", "r.*"), positions)


POSITIONS = "template string, name string, position int"


def _typed_positions(spark, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), POSITIONS)


def named_templates(templates: Mapping[str, Template]) -> Templates:
    """Templates made one by one, under their names."""
    rows, positions = None, []
    for name, one in templates.items():
        entries = [x for i in sorted(set(one.positions.values())) for x in (F.lit(i), one.cell(i).cast(C.READ_CELL))]
        cells = F.create_map(*entries) if entries else F.lit(None)
        own = one.rows.select(F.lit(name).alias("template"), "key", "row_idx", cells.cast(T.MapType(T.IntegerType(), C.READ_CELL)).alias("cells"))
        rows = own if rows is None else rows.unionByName(own)
        positions += [(name, n, i) for n, i in one.positions.items()]
    return Templates(rows, _typed_positions(rows.sparkSession, positions))


def templates_from_cells(cells: DataFrame, wanted: DataFrame, key_column: int | None = None) -> Templates:
    """Templates of many grids in one table: cells with the column template. wanted: template and name
    of the columns that are written to; the packing columns are looked for in all of them.

    The columns found are data, so the number of templates, and what they are called, does not
    show in the plan. A row holds as many cells as there are names wanted of its template.
    """
    names = F.explode(F.concat(F.array("name"), F.array(F.lit(PER_CARTON), F.lit(PER_PALLET))))
    asked = wanted.select("template", names.alias("name")).select(lookup_value(F.col("template"), F.lower("name")).alias("__asked")).distinct()
    valued = _with_value(cells)
    named = valued.withColumn("name", F.lower("value"))
    positions = named.withColumn("__at", lookup_value(F.col("template"), F.col("name"))).join(
        asked, F.col("__at") == F.col("__asked"), "left_semi"
    ).groupBy("template", "name").agg(F.min(F.struct("row_idx", "col_idx"))["col_idx"].alias("position"))
    used = positions.select(lookup_value(F.col("template"), F.col("position")).alias("__used")).distinct()
    inside = cells.withColumn("__at", lookup_value(F.col("template"), F.col("col_idx"))).join(used, F.col("__at") == F.col("__used"), "left_semi").drop("__at")
    value = F.struct("kind", "num", "txt", C.number_in(F.col("kind"), F.col("num"), F.col("text_number")).alias("read"))
    entry = F.struct(F.col("col_idx").alias("k"), value.alias("v"))
    gathered = add_numbers(inside, {"text_number": F.col("txt")}).groupBy("template", "row_idx").agg(F.collect_list(entry).alias("entries"))
    places = F.array_distinct(F.transform("entries", lambda e: e["k"]))
    first = F.transform(places, lambda k: F.get(F.filter("entries", lambda e: e["k"] == k), F.lit(0))["v"])
    rows = gathered.select(lookup_value(F.col("template"), F.col("row_idx")).alias("__row"), F.map_from_arrays(places, first).alias("cells"))
    looked = valued if key_column is None else valued.filter(F.col("col_idx") == key_column)
    index = looked.groupBy("template", F.col("value").alias("key")).agg(F.min("row_idx").alias("row_idx"))
    joined = index.withColumn("__at", lookup_value(F.col("template"), F.col("row_idx"))).join(rows, F.col("__at") == F.col("__row"), "left")
    return Templates(joined.select("template", "key", "row_idx", "cells"), positions.select("template", "name", "position"))


def unmatched_keys(lines: DataFrame, key: str, index: DataFrame, index_key: str = "key") -> DataFrame:
    """Keys that no template row has, with their number of lines. Counted before the
    join, so a key that repeats is joined once; a missing key counts as unmatched."""
    counts = lines.groupBy(C.canonical_key_of(lines, key).alias("key")).agg(F.count(F.lit(1)).alias("lines"))
    known = index.select(F.col(index_key).alias("key"))
    asked = counts.filter(F.col("key").isNull() | (F.col("key") != ""))
    return asked.join(known, "key", "left_anti")


def lookup_value(*columns: Column) -> Column:
    """Join value that is compared as a whole.

    An index grouped by its key is already partitioned by it, and Spark would join it
    where it lies; then it cannot split the partition of a frequent key on the other
    side. On a struct the index goes through one more (small) shuffle, and the adaptive
    skew join applies. Small indexes are broadcast either way, by their measured size.
    """
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)])


def lookup_join(lines: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """Lines with the template row of their key: equi-join, lines without one drop out."""
    keyed = lines.withColumn("lookup_key", C.canonical_key_of(lines, key)).filter("lookup_key != ''")
    left = keyed.withColumn("__look", lookup_value(F.col("lookup_key"))).drop("lookup_key")
    right = index.withColumn("__look", lookup_value(F.col("key"))).drop("key")
    return left.join(right, "__look").drop("__look")


def _per_document(final: DataFrame, doc: str) -> list[str]:
    return [doc] if doc in final.columns else []


def apply_to_grid(cells: DataFrame, final: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The grid with the final cells put in; untouched cells keep their value.

    Final cells with a document belong to templates of their own: the result then has the
    document too, and of every document's template the rows it touches. The rows left out
    are those of the template itself. Cells of several templates, told by the column template
    of both, meet those of their own.
    """
    by = _per_document(final, doc)
    named = [c for c in ("template",) if c in final.columns and c in cells.columns]
    put = F.struct(*[F.col(f"new.{c}").alias(c) for c in ("kind", "num", "txt")])
    new = final.select(*by, *named, "row_idx", "col_idx", put.alias("put"), "outcome")
    if by:
        return _apply_to_touched(cells, new, by, named)
    joined = cells.join(new, [*named, "row_idx", "col_idx"], "full")
    picked = F.when(F.col("put").isNotNull(), F.col("put")).otherwise(F.struct("kind", "num", "txt"))
    return joined.select(*named, "row_idx", "col_idx", picked.alias("cell"), "outcome").select(
        *named, "row_idx", "col_idx", "cell.*", "outcome"
    )


def _apply_to_touched(cells: DataFrame, new: DataFrame, by: list[str], named: list[str]) -> DataFrame:
    """Of every document's template the rows that it touches, with what is put in.

    The final cells are read once: those of a document's row are gathered, meet the row of the template, and
    the cells are put in inside the row.
    """
    place = lookup_value(*map(F.col, [*named, "row_idx"]))
    puts = new.groupBy(*by, "row_idx", *named).agg(F.collect_list(F.struct("col_idx", "put", "outcome")).alias("puts"))
    olds = cells.groupBy(*named, "row_idx").agg(F.collect_list(F.struct("col_idx", F.struct("kind", "num", "txt").alias("cell"))).alias("olds"))
    joined = puts.withColumn("__look", place).join(
        olds.select(place.alias("__of"), "olds"), F.col("__look") == F.col("__of"), "left"
    ).withColumn("olds", F.coalesce("olds", F.array()))
    known = F.lit(True)  # a cell whose place is not fully known meets none
    for c in [*by, *named, "row_idx"]:
        known = known & F.col(c).isNotNull()
    meets = lambda p, o: F.coalesce(known & (p["col_idx"] == o["col_idx"]), F.lit(False))
    entry = lambda at, cell, outcome: F.struct(at.alias("col_idx"), cell.alias("cell"), outcome.alias("outcome"))
    shown = lambda p, old: entry(p["col_idx"], F.coalesce(p["put"], old), p["outcome"])
    kept = F.filter("olds", lambda o: ~F.exists("puts", lambda p: meets(p, o)))
    written = F.transform("puts", lambda p: F.transform(F.filter("olds", lambda o: meets(p, o)), lambda o: shown(p, o["cell"])))
    added = F.filter("puts", lambda p: ~F.exists("olds", lambda o: meets(p, o)))
    none = F.lit(None)
    empty = F.struct(none.cast("string").alias("kind"), none.cast("double").alias("num"), none.cast("string").alias("txt"))
    every = F.concat(
        F.transform(kept, lambda o: entry(o["col_idx"], o["cell"], none.cast("string"))), F.flatten(written),
        F.transform(added, lambda p: shown(p, empty)),
    )
    return joined.select(*by, *named, "row_idx", F.explode(every).alias("e")).select(
        *by, *named, "row_idx", "e.col_idx", "e.cell.*", "e.outcome"
    )


def apply_to_table(df: DataFrame, row: str, positions: dict[str, int], final: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The wide table with the final cells put in; target columns become text, which is
    the only type that holds both numbers and 'original/plan'.

    Final cells with a document give one row per document and row that it touches, with
    the document as first column; else there is one table with all its rows.
    """
    by = _per_document(final, doc)
    if by and doc in df.columns:
        raise ValueError(f"the template has a column {doc!r} of its own")
    columns = [c for c in df.columns if c != row]
    targets = sorted(set(positions.values()))
    value = F.struct(C.canonical_text(F.col("new")).alias("v"))
    wide = final.groupBy(*by, "row_idx").agg(
        *[F.max(F.when(F.col("col_idx") == i, value)).alias(f"n{i}") for i in targets]
    )
    left = df.withColumn("__look", lookup_value(F.col(row).cast("bigint")))
    right = wide.withColumn("__look", lookup_value(F.col("row_idx"))).drop("row_idx")
    joined = left.join(right, "__look", "inner" if by else "left")
    out = []
    for i, c in enumerate(columns):
        if i in targets:
            kept = C.canonical_text(C.cell_of(df, c))
            out.append(F.when(F.col(f"n{i}").isNotNull(), F.col(f"n{i}.v")).otherwise(kept).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return joined.select(*by, F.col(row), *out)
