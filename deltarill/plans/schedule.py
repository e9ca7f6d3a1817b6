"""Which vertices run in a round: all that are pending, or those of highest priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltarill.plans.kernel import Kernel


def threshold(state: DataFrame, kernel: Kernel, portion: float, min_rows: int = 1000, exact: bool = False) -> Column | None:
    """A predicate over ``value`` and ``delta`` that about ``portion`` of the vertices meet, or None for all.

    The cut is the quantile ``1 - portion`` of the priorities, approximate by default; at most one number reaches the driver.
    Priorities above the cut run, and those at it if it is also the highest.
    """
    pri = kernel.priority(F.col("value"), F.col("delta"))
    if state.limit(min_rows + 1).count() <= min_rows:
        return None
    p = state.select(pri.alias("p")).where(~F.isnan("p"))
    q = F.expr(f"percentile_disc({1 - portion}) WITHIN GROUP (ORDER BY p)") if exact else F.percentile_approx("p", 1 - portion, 10000)
    row = p.agg(q.alias("cut"), F.max("p").alias("most")).first()
    if row.cut is None:
        return None
    cut = F.lit(row.cut)
    return pri >= cut if row.cut == row.most else pri > cut


def any_pending(state: DataFrame, kernel: Kernel) -> bool:
    """Whether any vertex has something to do."""
    return not state.where(kernel.pending(F.col("value"), F.col("delta"))).isEmpty()
