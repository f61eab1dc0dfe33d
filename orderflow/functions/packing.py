"""Quantities that fill pallets and cartons within a tolerance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderflow.functions.cells import cell
from orderflow.functions.numbers import float_text
from orderflow.functions.text import strip

NO_PACKING = "N·A"


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def tolerance_ratio(tolerance, quantity: Column, is_text: bool | None = None) -> Column:
    """'15%' to 0.15; a number below 1 is a ratio already; from 1 on it counts pieces.

    tolerance may be a Python value or a column, so it can come from a profile.
    Columns are taken as text unless is_text=False.
    """
    if is_text is None:
        is_text = isinstance(tolerance, (str, Column))
    if is_text:
        text = strip(_column(tolerance))
        percent = strip(F.rtrim(text, F.lit("%"))).try_cast("double") / 100.0
        number = text.try_cast("double")
    else:
        text, percent = F.lit(""), F.lit(None).cast("double")
        number = _column(tolerance).cast("double")
    return (
        F.when(text.endswith("%"), percent)
        .when(number < 1, number)
        .when(quantity <= 0, F.lit(0.0))
        .otherwise(number / quantity)
    )


def allowed_range(quantity: Column, increase: Column, decrease: Column) -> tuple[Column, Column]:
    """Least and greatest quantity that the tolerances allow."""
    return F.greatest(F.lit(0.0), quantity * (1 - decrease)), quantity * (1 + increase)


def full_pallets(quantity: Column, per_pallet: Column, low: Column, high: Column) -> Column:
    """Whole pallets: rounded up if that is allowed, else down, else null."""
    up = F.ceil(quantity / per_pallet) * per_pallet
    down = F.floor(quantity / per_pallet) * per_pallet
    return F.when(up <= high, up).when((down > 0) & (down >= low), down).cast("bigint")


def _first_fit(first: Column, last: Column, ctn: Column, plt: Column, low: Column, high: Column) -> Column:
    """Highest pallet count from first down to last whose total lies in the range."""

    def total(n: Column) -> Column:
        pallets = n * plt
        return pallets + F.ceil(F.greatest(F.lit(0.0), low - pallets) / ctn) * ctn

    totals = F.transform(F.sequence(first, last, F.lit(-1).cast("bigint")), total)
    return F.when(
        first >= last, F.get(F.filter(totals, lambda t: (t >= low) & (t <= high)), F.lit(0))
    )


BLOCK = 2**14


def _common_divisor(a: Column, b: Column) -> Column:
    """Greatest common divisor of two whole numbers below 2**63, which take at most 91 steps."""
    start = F.struct(a.alias("a"), b.alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(91)), start, step, lambda s: s["a"])


def mixed_packing(ctn: Column, plt: Column, low: Column, high: Column) -> Column:
    """Most pallets first, then the fewest cartons that reach the range; null if none fits.

    What a pallet count below the range adds up to depends only on its remainder by the
    carton size, and multiples of a pallet have ctn / gcd(ctn, plt) remainders; so no more
    counts than that can differ. The first 32 are tried at once, the others in blocks, one
    after the other, until one fits; a block is all that is held at a time.
    """
    top = F.floor(high / plt).cast("bigint")
    near = F.greatest(F.lit(0).cast("bigint"), top - F.least(ctn, F.lit(31)).cast("bigint"))
    different = F.expr("cast(0 as bigint)") + F.floor(ctn / _common_divisor(ctn.cast("bigint"), plt.cast("bigint"))).cast("bigint")
    bottom = F.greatest(F.lit(0).cast("bigint"), top - different)
    some = F.when(top - 32 >= bottom, F.sequence(F.lit(0).cast("bigint"), F.floor((top - 32 - bottom) / BLOCK).cast("bigint")))
    blocks = F.when(top >= 32, some)  # below, no remainder is looked for

    def block(found: Column, number: Column) -> Column:
        first = top - 32 - number * BLOCK
        return F.when(found.isNotNull(), found).otherwise(
            _first_fit(first, F.greatest(bottom, first - (BLOCK - 1)), ctn, plt, low, high).cast("bigint")
        )

    rest = F.aggregate(blocks, F.lit(None).cast("bigint"), block)
    return F.when(top >= 0, F.coalesce(_first_fit(top, near, ctn, plt, low, high).cast("bigint"), rest)).cast("bigint")


def planned_value(original: Column, plan: Column, planned: Column) -> Column:
    """The cell to write: the number itself if the plan keeps it, else 'original/plan'.

    original: typed value struct; plan: planned quantity; planned: whether a plan was made.
    Returns struct<kind, num, txt, force_text>.
    """
    shown = F.concat(
        float_text(original["num"]), F.lit("/"), F.coalesce(plan.cast("string"), F.lit(NO_PACKING))
    )
    changed = planned & (plan.isNull() | (plan.cast("double") != original["num"]))
    new = cell(
        F.when(changed, "txt").otherwise(original["kind"]),
        F.when(~changed, original["num"]),
        F.when(changed, shown).otherwise(original["txt"]),
    )
    return F.struct(
        new["kind"].alias("kind"),
        new["num"].alias("num"),
        new["txt"].alias("txt"),
        F.when(changed, True).otherwise(original["force_text"]).alias("force_text"),
    )
