"""Merge of order lines into a template: what is written where, and with which outcome."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderflow.functions import cells as C
from orderflow.functions import packing as K
from orderflow.functions.text import strip
from orderflow.operators.columns import add_numbers, find_name, parse_number_columns, settle, spread_by
from orderflow.operators.order_lines import NUMBER_COLUMNS
from orderflow.operators.packing import plan_packing
from orderflow.operators.template import PER_CARTON, PER_PALLET, Template, Templates, lookup_value
from orderflow.staging import staged

#: A cell with more updates than this is not left to one task, and so many updates of such cells are a part.
CROWD, PART = 2**18, 2**17

SKIPPED, FLAGGED, MODIFIED, WRITTEN = "skipped", "flagged", "modified", "written"
UNMATCHED, BLANK_KEY = "unmatched", "blank_key"


class NoMatchesError(Exception):
    """No line found a template row; stats says what was read."""

    def __init__(self, message: str, stats: dict | None = None):
        super().__init__(message)
        self.stats = stats or {}


@dataclass
class ColumnPair:
    """One resolved pair: source column of the lines, target column of the template."""

    order: int
    source: str
    target: str
    position: int


@dataclass
class MergePlan:
    """Resolved columns of a merge."""

    pairs: list[ColumnPair]
    missing_columns: list[str]
    quantity: str | None = None
    packing_requested: bool = False
    increase: object = 0.15
    decrease: object = 0.15
    number_columns: Mapping[str, str] = field(default_factory=dict)

    @property
    def packing_disabled(self) -> bool:
        return self.packing_requested and self.quantity is None


def resolve_mapping(
    columns: Sequence[str], source: Sequence[str], target: Sequence[str], template: Template
) -> tuple[list[ColumnPair], list[str]]:
    """Pair source and target names, the shorter list ending it, and drop pairs with a
    name that does not exist. Fails when none is left; returns missing target names."""
    pairs = []
    for name, wanted in zip(source, target):
        column, position = find_name(columns, name), template.position(wanted)
        if column is not None and position is not None:
            pairs.append(ColumnPair(len(pairs), column, wanted, position))
    missing = [wanted for _, wanted in zip(source, target) if template.position(wanted) is None]
    if not pairs:
        raise ValueError(f"no column pair can be resolved; target columns not found: {missing}")
    return pairs, missing


def plan_merge(
    lines: DataFrame,
    source: Sequence[str],
    target: Sequence[str],
    template: Template,
    quantity: str | None = None,
    increase=0.15,
    decrease=0.15,
) -> MergePlan:
    """Resolve all names of a merge. Packing is off when the quantity column or a packing
    column does not exist, which the statistics report."""
    pairs, missing = resolve_mapping(lines.columns, source, target, template)
    resolved = find_name(lines.columns, quantity) if quantity else None
    if not template.can_pack:
        resolved = None
    parsed = {p.source: f"{p.source}_num" for p in pairs if f"{p.source}_num" in lines.columns}
    return MergePlan(pairs, missing, resolved, quantity is not None, increase, decrease, parsed)


def _with_values(lines: DataFrame, plan: MergePlan) -> DataFrame:
    """Typed value of every source column as value_<order>; numbers parsed before are
    taken over, the others are parsed here, once per cell."""
    fresh = [p.source for p in plan.pairs if p.source not in plan.number_columns]
    parsed = parse_number_columns(lines, list(dict.fromkeys(fresh)), "__num")
    values = {
        f"value_{p.order}": C.typed_value(
            F.col(f"`{p.source}`"), F.col(f"`{plan.number_columns.get(p.source, p.source + '__num')}`")
        )
        for p in plan.pairs
    }
    return parsed.withColumns(values)


def _as_text(tolerance):
    return tolerance.cast("string") if isinstance(tolerance, Column) else tolerance


def _with_plans(lines: DataFrame, plan: MergePlan, template: Template) -> DataFrame:
    """Planned quantity of the pairs that carry it: usable_<order> and planned_<order>,
    and the value to write as new_<order>."""
    pairs = [p for p in plan.pairs if p.source == plan.quantity]
    if not pairs:
        return lines
    carton = template.cell(template.position(PER_CARTON))["read"]
    pallet = template.cell(template.position(PER_PALLET))["read"]
    for p in pairs:
        value, usable, planned = (F.col(f"{c}_{p.order}") for c in ("value", "usable", "planned"))
        lines = lines.withColumn(
            f"usable_{p.order}", carton.isNotNull() & pallet.isNotNull() & (value["kind"] == "num")
        )
        lines = plan_packing(
            lines, F.when(usable, value["num"]), carton, pallet,
            _as_text(plan.increase), _as_text(plan.decrease), f"planned_{p.order}",
        )
        lines = lines.withColumn(f"new_{p.order}", K.planned_value(value, planned, usable))
    return lines


def to_cell_updates(
    lines: DataFrame, plan: MergePlan, template: Template | None = None, keep: Sequence[str] = ("key",)
) -> DataFrame:
    """One row per line and column pair: the kept columns of the line and map_order,
    source_column, target_column, col_idx, value (typed source value), new (value to
    write), planned, old (cell of the template).

    Without template the lines carry no template cells and nothing is planned. Lines
    that found no template row (row_idx null) give one row without a pair.
    """
    lines = _with_values(lines, plan)
    if template is not None:
        lines = _with_plans(lines, plan, template)
    entries = []
    for p in plan.pairs:
        planned = f"planned_{p.order}" in lines.columns
        entries.append(
            F.struct(
                F.lit(p.order).alias("map_order"),
                F.lit(p.source).alias("source_column"),
                F.lit(p.target).alias("target_column"),
                F.lit(p.position).alias("col_idx"),
                F.col(f"value_{p.order}").alias("value"),
                (F.col(f"planned_{p.order}") if planned else F.lit(None).cast("bigint")).alias("planned"),
                F.col(f"new_{p.order}" if planned else f"value_{p.order}").alias("new"),
                (template.cell(p.position) if template is not None else F.lit(None).cast(C.READ_CELL)).alias("old"),
            )
        )
    updates = F.array(*entries)
    if template is not None:
        updates = F.when(F.col("row_idx").isNotNull(), updates)
    exploded = lines.select(*keep, F.explode_outer(updates).alias("u"))
    return exploded.select(*keep, "u.*")


def crowded_keys(lines: DataFrame, key: str, by: Sequence[str] = (), crowd: int | None = CROWD) -> DataFrame | None:
    """The keys that more than so many lines ask for, with the columns by; None if there are none.

    A cell gets at most one update from a line and column pair, so the keys are counted
    before anything is joined; that reads the key alone. by: the document, where each has a template of
    its own; then only the lines of documents with enough of them are counted by key. There are at most as many
    such keys as lines divided by crowd. crowd: None says that there are none; then nothing is read.
    """
    if crowd is None:
        return None
    counted = lines.select(*by, strip(C.canonical_key_of(lines, key)).alias("__key")).where("__key <> ''")
    many = F.col("n") > crowd
    if by:
        large = counted.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(many).select(lookup_value(*map(F.col, by)).alias("__of"))
        if large.isEmpty():
            return None
        counted = counted.withColumn("__by", lookup_value(*map(F.col, by))).join(staged(large), F.col("__by") == F.col("__of"), "left_semi")
    found = counted.groupBy(*by, F.col("__key").alias("key")).agg(F.count(F.lit(1)).alias("n")).where(many).drop("n")
    return None if found.isEmpty() else staged(found)


def mark_crowded(found: DataFrame, keys: DataFrame | None, rows: DataFrame, by: Sequence[str], doc: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Lines that know their template row with __crowded, whether a crowded key leads to that row, and this
    column's name; without crowded keys the lines as they are and no name.

    A row that several keys lead to is crowded for all of them. rows: of the template, by: the columns that
    tell the template of a key there, doc: those that tell whose row it is.
    """
    if keys is None:
        return found, []
    asked = keys.withColumn("__at", lookup_value(*map(F.col, by), F.col("key"))).drop("key", *[c for c in by if c not in doc])
    led = rows.select(lookup_value(*map(F.col, by), F.col("key")).alias("__of"), "row_idx")
    crowded = staged(asked.join(led, F.col("__at") == F.col("__of")).select(lookup_value(*map(F.col, doc), F.col("row_idx")).alias("__row")).distinct())
    marks = crowded.withColumn("__many", F.lit(True))
    told = found.withColumn("__at", lookup_value(*map(F.col, doc), F.col("row_idx"))).join(marks, F.col("__at") == F.col("__row"), "left")
    return told.withColumn("__crowded", F.coalesce("__many", F.lit(False))).drop("__at", "__row", "__many"), ["__crowded"]


def _before_in_parts(updates: DataFrame, cell: Sequence[str], order: Sequence[str], part: int) -> DataFrame:
    """Add __before to the updates of crowded cells: the class that the update before wrote.

    The updates are dealt out by ranges of cell and order, so a cell goes over as many parts as
    it has updates for, each in order. Inside a part the update before is the row
    before; the first row of a part gets it from the ends of the parts, one row each.
    """
    parts = max(1, -(-updates.count() // part))
    dealt = staged(updates.repartitionByRange(parts, *cell, *order).withColumn("__part", F.spark_partition_id()))
    own, place = F.struct(*cell), F.struct(*cell, *order)
    inside = W.partitionBy("__part").orderBy(*cell, *order)
    ends = dealt.groupBy("__part").agg(F.max_by(F.struct(own.alias("cell"), F.col("__new").alias("last")), place).alias("__end"))
    before = W.orderBy("__part")  # of the parts, not of the updates
    carried = staged(ends.select(F.col("__part").alias("__to"), F.lag("__end").over(before).alias("__carried")).where("__carried is not null"))
    looked = dealt.withColumn("__row_before", F.lag(F.struct(own.alias("cell"), F.col("__new").alias("last"))).over(inside))
    joined = looked.join(carried, F.col("__part") == F.col("__to"), "left")
    found = F.coalesce("__row_before", "__carried")
    same = found["cell"].eqNullSafe(own)
    return joined.withColumn("__before", F.when(same, found["last"])).select(*updates.columns, "__before")


def _row(order: Sequence[str]) -> Column:
    """The template row, or a number of their own for those that found none. The latter have no column, so
    they meet no cell that has the same number."""
    return F.coalesce(F.col("row_idx").cast("bigint"), F.xxhash64(*order))


def by_row(found: DataFrame, by: Sequence[str], order: Sequence[str], crowded: bool) -> DataFrame:
    """Lines that know their template row with __row, exchanged by it before they become one update for each pair.

    The order of the updates, the cells that stay and the rows that these make up need no exchange of their own then.
    Where a row is crowded the lines stay where they are; sequence_updates deals such rows out.
    """
    placed = found.withColumn("__row", _row(order))
    return placed if crowded else spread_by(placed, *by, "__row")


def sequence_updates(
    updates: DataFrame, cell: Sequence[str], order: Sequence[str], crowded: bool = False, part: int = PART
) -> DataFrame:
    """Add previous: the compare class of what stands in the cell just before a row.

    Updates of one cell apply in order; as equality is an equivalence, what a row finds
    is the class of the row before it, or of the template's cell for the first one. So
    this is one exchange of the updates, by cell, and a look at the row before. Rows
    without a cell have nothing to wait for; they are spread by their own order.

    crowded: there are rows whose column __crowded is true (see mark_crowded), all rows of their cells. The updates are
    then written once, and those of crowded cells are dealt out by cell and order.

    Updates that come with __row (see by_row) lie with their row already and are not exchanged again.
    """
    placed = updates if "__row" in updates.columns else updates.withColumn("__row", _row(order))
    keyed = placed.withColumns({"__new": C.written_class(F.col("new")), "__old": C.class_of(F.col("old"), F.col("old.read"))})
    own = ["__row" if c == "row_idx" else c for c in cell]
    before = F.lag("__new").over(W.partitionBy(*own).orderBy(*order))
    if not crowded:
        looked = keyed.withColumn("__before", before)
    else:
        kept = staged(keyed)
        many = F.col("__crowded") & F.col("row_idx").isNotNull()
        looked = kept.where(~many).withColumn("__before", before).unionByName(_before_in_parts(kept.where(many), cell, order, part))
    told = looked.withColumn("previous", F.coalesce("__before", "__old")).drop("__before", "__old")
    return told if "__row" in updates.columns else told.drop("__row")


def classify_outcome(updates: DataFrame, flagged: Column) -> DataFrame:
    """outcome of every sequenced update: skipped when the cell already holds the value, flagged
    when the check marked the source cell, modified when the value differs from the
    source, else written."""
    same = C.same_class(F.col("__new"), F.col("previous"))
    outcome = (
        F.when(F.col("key").isNotNull() & (F.col("key") == ""), BLANK_KEY)
        .when(F.col("row_idx").isNull(), UNMATCHED)
        .when(same, SKIPPED)
        .when(flagged, FLAGGED)
        .when(F.col("modified"), MODIFIED)
        .otherwise(WRITTEN)
    )
    return updates.withColumn("outcome", outcome).drop("__new", "previous", "modified")


def mark_modified(updates: DataFrame) -> DataFrame:
    """Whether the value to write differs from the source. Known before the updates are
    put in order, so that the source value need not travel along for it."""
    differs = ~C.same_class(C.written_class(F.col("value")), C.written_class(F.col("new")))
    return updates.withColumn("modified", differs)


def attach_rows(lines: DataFrame, key: str, rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lines with row_idx and cells of their template row, nulls where there is none. by: columns that tell
    the line's template, where rows hold several.

    Blank and missing keys get a lookup value that no row has and that differs from line
    to line, so they neither match nor gather in one task.
    """
    keyed = lines.withColumn("key", strip(C.canonical_key_of(lines, key)))
    look = F.coalesce(F.col("key"), F.lit(""))
    spread = F.pmod(F.xxhash64(*lines.columns), F.lit(4096)).cast("int") + 1
    left = keyed.withColumn("__look", lookup_value(*map(F.col, by), look, F.when(look == "", spread).otherwise(0)))
    right = rows.withColumn("__look", lookup_value(*map(F.col, by), F.col("key"), F.lit(0))).drop("key", *by)
    return left.join(right, "__look", "left").drop("__look")


def _with_flags(found: DataFrame, flags: DataFrame | None, doc: str) -> DataFrame:
    """Lines with the columns of theirs that a check marked, as an array."""
    if flags is None:
        return found.withColumn("__flagged", F.array().cast("array<string>"))
    marks = _marked_columns(flags).select(lookup_value(F.col("doc_id"), F.col("key")).alias("__mark"), "__flagged")
    return found.withColumn("__mark", lookup_value(F.col(doc), F.col("key"))).join(marks, "__mark", "left").drop("__mark")


def _marked_columns(flags: DataFrame) -> DataFrame:
    return flags.groupBy("doc_id", "key").agg(F.collect_set("column").alias("__flagged"))


def _by_row_with_flags(
    found: DataFrame, flags: DataFrame | None, rows: DataFrame, by: Sequence[str], order: Sequence[str], doc: str
) -> DataFrame:
    """Lines exchanged by their row (see by_row), those that found one with the columns of theirs that a check marked.

    The marks find the template row of their key, go there with the lines, and meet them where these lie. So the
    lines are not exchanged by document and key for it; those without a row have no cell that a mark could matter for.
    """
    if flags is None:
        return by_row(_with_flags(found, None, doc), by, order, False)
    marks = _marked_columns(flags).withColumn("__at", lookup_value(F.col("key")))
    led = rows.select(lookup_value(F.col("key")).alias("__of"), F.col("row_idx").cast("bigint").alias("__row"))
    at_row = marks.join(led.where("__row is not null"), F.col("__at") == F.col("__of"))
    lines = found.withColumns({"__row": _row(order), "__line": F.lit(True)})
    both = lines.unionByName(at_row.select(F.col("doc_id").alias(doc), "key", "__row", F.col("__flagged").alias("__mark")), True)
    own = W.partitionBy(doc, "__row", "key")  # one mark at most
    told = spread_by(both, *by, "__row").withColumn("__flagged", F.max("__mark").over(own))
    return told.where("__line").drop("__line", "__mark")


UPDATE = ["col_idx", "map_order", "source_column", "target_column", "value", "planned", "old", "new", "outcome"]


def _outcomes(updates: DataFrame, keep: list[str], order: Sequence[str], cell: list[str], part: int) -> DataFrame:
    """The updates with their outcome and __row, which is row_idx where there is one."""
    crowded = "__crowded" in updates.columns
    sequenced = sequence_updates(mark_modified(updates), cell, [*order, "map_order"], crowded, part)
    flagged = F.coalesce(F.array_contains("__flagged", F.col("source_column")), F.lit(False))
    return classify_outcome(sequenced, flagged).select(*keep, *UPDATE, "__row")


def merge_updates(
    lines: DataFrame,
    template: Template,
    plan: MergePlan,
    key: str,
    order: Sequence[str],
    flags: DataFrame | None = None,
    doc: str = "doc_id",
    per_document: bool = False,
    carry: Sequence[str] = (),
    crowd: int | None = CROWD,
    part: int = PART,
    placed: bool = False,
) -> DataFrame:
    """All updates with their outcome; a line without a template row, or without a key,
    is one row with outcome unmatched or blank_key.

    order: columns that put the lines in order.
    per_document: every document is merged into a template of its own.
    carry: columns of the lines that the tolerances are computed from.
    placed: keep __row, by which the updates lie (see final_cells).
    """
    used = [doc, *order, key, *[p.source for p in plan.pairs], *plan.number_columns.values(), *carry]
    by = [doc] if per_document else []
    taken = lines.select(*dict.fromkeys(used))
    crowds = crowded_keys(taken, key, by, crowd)
    found, mark = mark_crowded(attach_rows(taken, key, template.rows), crowds, template.rows, [], by)
    keep = list(dict.fromkeys([doc, *order, "key", "row_idx"]))
    if mark:
        found = by_row(_with_flags(found, flags, doc), by, order, True)
    else:
        found = _by_row_with_flags(found, flags, template.rows, by, order, doc)
    updates = to_cell_updates(found, plan, template, [*keep, "__flagged", "__row", *mark])
    outcomes = _outcomes(updates, keep, order, [*by, "row_idx", "col_idx"], part)
    return outcomes if placed else outcomes.drop("__row")


def merge_by_pairs(
    lines: DataFrame,
    templates: Templates,
    columns: Sequence[str],
    key: str,
    order: Sequence[str] = ("line_seq",),
    flags: DataFrame | None = None,
    increase=0.15,
    decrease=0.15,
    doc: str = "doc_id",
    crowd: int | None = CROWD,
    part: int = PART,
    placed: bool = False,
) -> DataFrame:
    """As merge_updates, every document into a template of its own, where the lines tell what
    is written and where: template (its name), pairs, an array of (source, target, position), qty_field, and
    carton and pallet, the positions of the packing columns.

    columns are those that a pair may name as its source.
    """
    numbers = [f"{c}_num" for c in columns if f"{c}_num" in lines.columns]
    tolerances = [c for c in ("qty_increase", "qty_decrease") if c in lines.columns]
    used = dict.fromkeys([doc, *order, key, *columns, *numbers, "template", "pairs", "qty_field", "carton", "pallet", *tolerances])
    taken = lines.select(*used)
    crowds = crowded_keys(taken, key, [doc, "template"], crowd)
    found, mark = mark_crowded(attach_rows(taken, key, templates.rows, ["template"]), crowds, templates.rows, ["template"], [doc])
    found = _with_flags(found, flags, doc)
    found = by_row(found, [doc], order, bool(mark))
    # number columns are known by the line; other texts are read where a pair asks for them
    amounts = [c for c in columns if c in NUMBER_COLUMNS or f"{c}_num" in numbers]
    valued = parse_number_columns(found, [c for c in amounts if f"{c}_num" not in numbers])
    texts = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"`{c}`"))])
    read = F.create_map(*[x for c in amounts for x in (F.lit(c), F.col(f"`{c}_num`"))]) if amounts else F.lit(None).cast("map<string,double>")
    known = F.array(*[F.lit(c) for c in amounts]).cast("array<string>")
    valued = valued.withColumns({"__texts": texts, "__read": read})
    carton, pallet = (F.try_element_at("cells", F.col(c))["read"] for c in ("carton", "pallet"))
    amount = C.typed_value(F.try_element_at("__texts", F.col("qty_field")), F.try_element_at("__read", F.col("qty_field")))
    packs = F.exists("pairs", lambda p: p["source"] == F.col("qty_field"))
    usable = F.coalesce(packs & carton.isNotNull() & pallet.isNotNull() & (amount["kind"] == "num"), F.lit(False))
    valued = valued.withColumn("__usable", usable)
    valued = plan_packing(
        valued, F.when(F.col("__usable"), amount["num"]), carton, pallet, _as_text(increase), _as_text(decrease), "__planned"
    )

    def update(pair: Column, at: Column) -> Column:
        is_quantity = F.coalesce(pair["source"] == F.col("qty_field"), F.lit(False))
        return F.struct(
            at.alias("map_order"), pair["source"].alias("source_column"), pair["target"].alias("target_column"),
            pair["position"].alias("col_idx"), F.try_element_at("__texts", pair["source"]).alias("__text"),
            F.try_element_at("__read", pair["source"]).alias("__number"), F.array_contains(known, pair["source"]).alias("__known"),
            F.when(is_quantity, F.col("__planned")).alias("planned"), (is_quantity & F.col("__usable")).alias("__usable"),
            F.try_element_at("cells", pair["position"]).alias("old"),
        )

    keep = list(dict.fromkeys([doc, *order, "key", "template", "row_idx"]))
    entries = F.when(F.col("row_idx").isNotNull(), F.transform("pairs", update))
    own = [*keep, "__flagged", "__row", *mark]
    exploded = valued.select(*own, F.explode_outer(entries).alias("u")).select(*own, "u.*")
    parsed = add_numbers(exploded, {"__parsed": F.when(~F.col("__known"), F.col("__text"))})
    number = F.when(F.col("__known"), F.col("__number")).otherwise(F.col("__parsed"))
    value = F.when(F.col("source_column").isNotNull(), C.typed_value(F.col("__text"), number))  # not of a line without a row
    updates = settle(parsed, {"value": value})
    new = F.when(F.col("__usable"), K.planned_value(F.col("value"), F.col("planned"), F.col("__usable"))).otherwise(F.col("value"))
    updates = updates.withColumn("new", new).drop("__usable", "__text", "__number", "__known", "__parsed")
    outcomes = _outcomes(updates, keep, order, [doc, "row_idx", "col_idx"], part)
    return outcomes if placed else outcomes.drop("__row")


def changes(updates: DataFrame) -> DataFrame:
    """The updates that write something: the change log."""
    return updates.filter(F.col("outcome").isin(FLAGGED, MODIFIED, WRITTEN))


def final_cells(
    updates: DataFrame, order: Sequence[str], doc: str = "doc_id", per_document: bool = False
) -> DataFrame:
    """Value that stays in each written cell: the last one written. Its mark is the last
    mark set, as a plain write leaves an earlier mark standing. Combined before the shuffle;
    updates with __row lie together already and are not shuffled."""
    position = F.struct(*order, "map_order")
    named = [c for c in ("template",) if c in updates.columns]
    row = "__row" if "__row" in updates.columns else "row_idx"
    by = [doc] if per_document else []
    marked = F.col("outcome").isin(FLAGGED, MODIFIED)
    final = changes(updates).groupBy(*by, row, "col_idx", *named).agg(
        F.max_by("new", position).alias("new"),
        F.coalesce(F.max_by(F.when(marked, F.col("outcome")), F.when(marked, position)), F.lit(WRITTEN)).alias("outcome"),
    )
    number = F.col(row).cast(updates.schema["row_idx"].dataType).alias("row_idx")  # what is written has a row
    return final.select(*by, *named, number, "col_idx", "new", "outcome")


def stat_counts() -> dict[str, Column]:
    """What is counted of the updates, per document or, while they are written, of all of them."""
    first = F.col("map_order") == 0
    outcome = F.col("outcome")
    unmatched, blank = outcome == UNMATCHED, outcome == BLANK_KEY
    return {
        "total_csv_rows": F.count_if(first | unmatched | blank),
        "rows_matched": F.count_if(first),
        "rows_not_found": F.count_if(unmatched),
        "rows_blank_key": F.count_if(blank),
        "red_cells": F.count_if(outcome == MODIFIED),
        "yellow_cells": F.count_if(outcome == FLAGGED),
        "skipped_cells": F.count_if(outcome == SKIPPED),
    }


def merge_stats(updates: DataFrame, plan: MergePlan, doc: str = "doc_id") -> DataFrame:
    """Counts per document, all from one pass over the updates."""
    counts = updates.groupBy(F.col(doc).alias("doc_id")).agg(*[c.alias(n) for n, c in stat_counts().items()])
    return counts.withColumns(
        {
            "missing_columns": F.array(*[F.lit(c) for c in plan.missing_columns]).cast("array<string>"),
            "qty_recalc_disabled": F.lit(plan.packing_disabled),
        }
    )


STAT_COUNTS = [
    "total_csv_rows", "rows_matched", "rows_not_found", "rows_blank_key",
    "red_cells", "yellow_cells", "skipped_cells",
]


def total_stats(stats: DataFrame) -> dict:
    """Sums over all documents, as one row."""
    counts = [c for c in stats.columns if c not in ("doc_id", "missing_columns", "qty_recalc_disabled")]
    row = stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts]).first()
    return row.asDict()


def merge_gate(stats: DataFrame) -> dict:
    """Totals of the merge; fails when no line matched, so that nothing gets written."""
    return check_matched(total_stats(stats))


def check_matched(totals: dict) -> dict:
    if totals["rows_matched"] == 0:
        raise NoMatchesError("no line matches a template row, nothing to write", totals)
    return totals


@dataclass
class Merged:
    """Outcome of merge_into_template()."""

    plan: MergePlan
    updates: DataFrame
    changes: DataFrame
    final: DataFrame
    stats: DataFrame
    per_document: bool = False


def merge_into_template(
    lines: DataFrame,
    template: Template,
    source: Sequence[str],
    target: Sequence[str],
    key: str | None = None,
    order: Sequence[str] = ("line_seq",),
    flags: DataFrame | None = None,
    quantity: str | None = None,
    increase=0.15,
    decrease=0.15,
    doc: str = "doc_id",
    per_document: bool = False,
    carry: Sequence[str] = (),
    crowd: int | None = CROWD,
    part: int = PART,
) -> Merged:
    """The whole merge as lazy tables; see apply_to_grid and apply_to_table for the
    merged template and merge_gate for the check before writing."""
    key = key or next(c for c in lines.columns if c not in (doc, *order))
    plan = plan_merge(lines, source, target, template, quantity, increase, decrease)
    placed = merge_updates(lines, template, plan, key, order, flags, doc, per_document, carry, crowd, part, placed=True)
    updates = placed.drop("__row")
    return Merged(
        plan, updates, changes(updates), final_cells(placed, order, doc, per_document),
        merge_stats(updates, plan, doc), per_document,
    )
