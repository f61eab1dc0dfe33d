"""The packing plan as a table job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions import packing as K


def plan_packing(
    df: DataFrame, quantity: Column, per_carton: Column, per_pallet: Column,
    increase, decrease, out: str = "planned",
) -> DataFrame:
    """Add the planned whole quantity, null when nothing fits (or there is no quantity).

    All three inputs are cut to whole numbers first; where one is not positive the cut
    quantity is returned as it is. The tolerances are Python values or columns. Every
    step is a column of its own, so that the range is worked out once per row.
    """
    q, ctn, plt, low, high = (F.col(f"__{out}_{c}") for c in ("q", "ctn", "plt", "low", "high"))
    names = [f"__{out}_{c}" for c in ("q", "ctn", "plt", "inc", "dec", "low", "high", "full")]
    df = df.withColumns({
        names[0]: quantity.try_cast("bigint"),
        names[1]: per_carton.try_cast("bigint"),
        names[2]: per_pallet.try_cast("bigint"),
    })
    df = df.withColumns({names[3]: K.tolerance_ratio(increase, q), names[4]: K.tolerance_ratio(decrease, q)})
    df = df.withColumns(dict(zip(names[5:7], K.allowed_range(q, F.col(names[3]), F.col(names[4])))))
    df = df.withColumn(names[7], K.full_pallets(q, plt, low, high))
    usable = (q > 0) & (ctn > 0) & (plt > 0)
    planned = F.coalesce(F.col(names[7]), K.mixed_packing(ctn, plt, low, high))
    return df.withColumn(out, F.when(usable, planned).otherwise(q)).drop(*names)
