"""Whole runs: extract, check, merge."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions.text import strip
from orderflow.operators import merge as M
from orderflow.operators import order_lines
from orderflow.operators.columns import require_rows, settle
from orderflow.operators.quality import Validated, flag_union, validate
from orderflow.operators.stats import run_stats
from orderflow.operators.template import PER_CARTON, PER_PALLET, Template, Templates, lookup_value, named_templates
from orderflow.plans import registry

Stage = Callable[[DataFrame], DataFrame]

@dataclass
class Extracted:
    """Outcome of run_extract_only()."""

    lines: DataFrame
    checked: Validated


@dataclass
class FullRun:
    """Outcome of run_full()."""

    lines: DataFrame
    checked: Validated
    merged: M.Merged
    stats: DataFrame


def check_lines(lines: DataFrame, layout: str) -> Validated:
    """Checks of canonical order lines by the layout's rules, on the numbers parsed when
    the lines were extracted."""
    return validate(
        lines, registry.layout(layout).field_rules(), key="key", columns=order_lines.TEXT_COLUMNS
    )


def run_extract_only(source: DataFrame, layout: str, stage: Stage | None = None, strict: bool = False) -> Extracted:
    """Extract and check. strict: no row at all is an error (looks at one row)."""
    lines = registry.extract_lines(source, layout)
    if stage is not None:
        lines = stage(lines)
    if strict:
        require_rows(lines, "extraction")
    return Extracted(lines, check_lines(lines, layout))


def run_full(
    source: DataFrame,
    layout: str,
    template: Template,
    source_cols: Sequence[str],
    target_cols: Sequence[str],
    headers: Sequence[str] | None = None,
    increase=0.15,
    decrease=0.15,
    more_flags: Sequence[DataFrame] = (),
    per_document: bool = True,
    order: Sequence[str] = ("line_seq",),
    stage: Stage | None = None,
) -> FullRun:
    """Extract, check and merge all documents of a layout; every document into a template
    of its own unless per_document=False, when order must put all lines in one order.

    Column names may be the layout's, its known translations or the document's headers.
    The quantity column comes from the layout's rules. stage (see staging.staged) may
    keep the extracted lines, which both the checks and the merge read.
    """
    if not per_document and list(order) == ["line_seq"]:
        raise ValueError("documents that share a template need an order that tells their lines apart")
    chosen = registry.layout(layout)
    extracted = run_extract_only(source, layout, stage)
    fields = [chosen.field_of(name, headers) or name for name in source_cols]
    flags = flag_union(extracted.checked.flags.select("doc_id", "key", "column", F.explode("reasons").alias("reason")),
                       *more_flags) if more_flags else extracted.checked.flags
    merged = M.merge_into_template(
        extracted.checked.clean, template, fields, target_cols, key="key", order=order, flags=flags,
        quantity=chosen.field_rules().get("qty"), increase=increase, decrease=decrease, per_document=per_document,
    )
    stats = run_stats(extracted.lines, extracted.checked.rejects, flags, merged.stats, merged.plan)
    return FullRun(extracted.lines, extracted.checked, merged, stats)


OK, UNKNOWN_PROFILE, UNKNOWN_LAYOUT = "ok", "unknown_profile", "unknown_layout"
UNEQUAL_LISTS, NO_PAIR, UNKNOWN_TEMPLATE = "unequal_lists", "no_pair", "unknown_template"


def _names(text: str) -> Column:
    """Comma-separated names; empty places stay, so that both lists of a mapping keep step."""
    return F.transform(F.split(F.coalesce(F.col(text), F.lit("")), ","), strip)


def _lookup(known: dict[str, object], name: Column, kind: str) -> Column:
    if not known:
        return F.lit(None).cast(kind)
    entries = [x for k, v in known.items() for x in (F.lit(k), F.lit(v).cast(kind))]
    return F.try_element_at(F.create_map(*entries), name)


def _layout_fields() -> dict[str, str]:
    """Layout and lower-cased header name, in all spellings, to the column of the order lines."""
    found = {}
    for name, layout in registry.layouts().items():
        for headers in [order_lines.TEXT_COLUMNS, layout.headers, *layout.spellings]:
            for header in headers:
                found.setdefault(f"{name}/{header.lower()}", layout.field_of(header) or header)
    return found


def wanted_columns(profiles: DataFrame) -> DataFrame:
    """template and name of all columns that profiles write to (see templates_from_cells)."""
    names = profiles.filter("template is not null").select("template", F.explode(_names("target_cols")).alias("name"))
    return names.filter("name <> ''").distinct()


def _with_places(profiles: DataFrame, templates: Templates | Template) -> tuple[DataFrame, Templates]:
    """Profiles with places, a map from lower-cased column name to position of their template (null without
    one), and the templates. A single template is that of all profiles, whatever they name."""
    if isinstance(templates, Template):
        profiles, templates = profiles.withColumn("template", F.lit("")), named_templates({"": templates})
    places = templates.positions.groupBy(lookup_value(F.col("template")).alias("__of")).agg(
        F.map_from_entries(F.collect_list(F.struct("name", "position"))).alias("places")
    )
    told = profiles.withColumn("__at", lookup_value(F.col("template"))).join(places, F.col("__at") == F.col("__of"), "left")
    return told.drop("__at", "__of"), templates


def resolve_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles with status, template, pairs, qty_field, the positions of the packing columns and the
    tolerances: what the names of each mean, worked out once per profile. pairs is null where the status is not ok.

    A pair with a name that does not exist is left out; a profile without any pair left, with lists of
    unequal length, with an unknown layout or a template that is not there is told by its status.
    """
    fields, quantities = _layout_fields(), {n: r.field_rules().get("qty") for n, r in registry.layouts().items()}
    known = F.col("layout").isin(list(quantities))
    pair = lambda source, target: F.struct(
        _lookup(fields, F.concat(F.col("layout"), F.lit("/"), F.lower(source)), "string").alias("source"),
        target.alias("target"), F.try_element_at("places", F.lower(target)).alias("position"),
    )
    lists = profiles.select(
        "name", "layout", "template", "places", "qty_increase", "qty_decrease", _names("source_cols").alias("sources"), _names("target_cols").alias("targets")
    )
    paired = settle(lists, {"pairs": F.filter(
        F.zip_with("sources", "targets", pair), lambda p: p["source"].isNotNull() & p["position"].isNotNull()
    )})
    status = (
        F.when(~F.coalesce(known, F.lit(False)), UNKNOWN_LAYOUT).when(F.size("sources") != F.size("targets"), UNEQUAL_LISTS)
        .when(F.col("places").isNull(), UNKNOWN_TEMPLATE).when(F.size("pairs") == 0, NO_PAIR).otherwise(OK)
    )
    told = paired.withColumn("status", status)
    carton, pallet = (F.try_element_at("places", F.lit(c.lower())) for c in (PER_CARTON, PER_PALLET))
    both = carton.isNotNull() & pallet.isNotNull()
    return told.select(
        "name", "status", "template", F.when(F.col("status") == OK, F.col("pairs")).alias("pairs"),
        _lookup({k: v for k, v in quantities.items() if v}, F.col("layout"), "string").alias("qty_field"),
        F.when(both, carton).alias("carton"), F.when(both, pallet).alias("pallet"), "qty_increase", "qty_decrease",
    )


@dataclass
class ProfileRuns:
    """Outcome of run_profiles()."""

    updates: DataFrame
    status: DataFrame
    placed: DataFrame | None = None  # the updates with the row that they lie by

    @property
    def final(self) -> DataFrame:
        """What stays in the cells of every document's own template (see apply_to_grid)."""
        return M.final_cells(self.updates if self.placed is None else self.placed, ["line_seq"], per_document=True)


def run_profiles(
    lines: DataFrame,
    documents: DataFrame,
    profiles: DataFrame,
    templates: Templates | Template,
    flags: DataFrame | None = None,
) -> ProfileRuns:
    """All documents, each merged by its saved profile into the template that the profile names, and for every
    document whether that could be done.

    documents: doc_id and profile (a name); profiles as from read_profiles. Profiles and templates are
    data like any other: the resolved pairs and the template's name travel with the lines, a key is looked up in the
    template of its line, so any number of profiles, mappings and templates is one merge.
    A single Template is that of all profiles.
    """
    placed, templates = _with_places(profiles, templates)
    resolved = resolve_profiles(placed)
    chosen = documents.select("doc_id", lookup_value(F.col("profile")).alias("__name")).join(
        resolved.withColumn("__name", lookup_value(F.col("name"))), "__name", "left"
    ).drop("__name")
    status = chosen.select("doc_id", F.coalesce("status", F.lit(UNKNOWN_PROFILE)).alias("status"))
    ready = chosen.filter(F.col("status") == OK).select(
        lookup_value(F.col("doc_id")).alias("__doc"), "template", "pairs", "qty_field", "carton", "pallet", "qty_increase", "qty_decrease"
    )
    told = lines.withColumn("__doc", lookup_value(F.col("doc_id"))).join(ready, "__doc").drop("__doc")
    crowded = M.crowded_keys(lines, "key", ["doc_id"]) is not None  # told by the lines alone, before any join
    placed = M.merge_by_pairs(
        told, templates, order_lines.TEXT_COLUMNS, key="key", flags=flags,
        increase=F.col("qty_increase"), decrease=F.col("qty_decrease"), crowd=M.CROWD if crowded else None,
        placed=True,
    )
    return ProfileRuns(placed.drop("__row"), status, placed)
