"""The keyed state table: put, look up, update, accumulate, remove. Every operation gives a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltarill.plans.kernel import Kernel


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the last in the given order (nulls first). Null keys are no keys.

    An aggregate, so repeats of a hot key are combined before the shuffle.
    """
    others = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(*order))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in others])


def put(state: DataFrame, rows: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Insert the keys that are new and replace the others, but for the columns in ``keep``. ``rows`` has one row per key."""
    s, r = state.alias("s"), rows.where(F.col(key).isNotNull()).alias("r")
    j = s.join(r, F.col(f"s.{key}") == F.col(f"r.{key}"), "full_outer")
    there, new = F.col(f"s.{key}").isNotNull(), F.col(f"r.{key}").isNotNull()

    def pick(c: str) -> Column:
        if c == key:
            return F.coalesce(f"s.{key}", f"r.{key}").alias(c)
        replaced = ~there | new if c not in keep else ~there
        return F.when(replaced, F.col(f"r.{c}")).otherwise(F.col(f"s.{c}")).alias(c)

    return j.select(*[pick(c) for c in state.columns])


def lookup(state: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of the given keys; keys that are not there give none."""
    return state.join(keys.select(key).distinct(), key, "left_semi")


def contains(state: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Each asked key once, with ``found``; a null key is never found."""
    there = state.select(F.col(key).alias("_k")).distinct()
    asked = keys.select(key).distinct()
    return asked.join(there, F.col(key) == F.col("_k"), "left").select(key, F.col("_k").isNotNull().alias("found"))


def update_delta(state: DataFrame, kernel: Kernel, where: Column) -> DataFrame:
    """Reset deltas to the identity and priorities to 0."""
    return state.withColumns({
        "delta": F.when(where, kernel.id_column).otherwise(F.col("delta")), "priority": F.when(where, F.lit(0.0)).otherwise(F.col("priority")),
    })


def update_value(state: DataFrame, value: Column, where: Column) -> DataFrame:
    return state.withColumn("value", F.when(where, value).otherwise(F.col("value")))


def accumulate_delta(state: DataFrame, messages: DataFrame, kernel: Kernel, key: str) -> DataFrame:
    """Combine messages (``key, m``) into the deltas and renew the priorities of the vertices that got one."""
    m = messages.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(kernel.agg(F.col("m")).alias("_m"))
    j = state.join(m, F.col(key) == F.col("_k"), "left")
    delta = F.when(F.col("_m").isNotNull(), kernel.combine(F.col("delta"), F.col("_m"))).otherwise(F.col("delta"))
    pri = F.when(F.col("_m").isNotNull(), kernel.priority(F.col("value"), delta)).otherwise(F.col("priority"))
    return j.withColumns({"priority": pri, "delta": delta}).drop("_k", "_m")


def accumulate_value(state: DataFrame, kernel: Kernel) -> DataFrame:
    return state.withColumn("value", kernel.combine(F.col("value"), F.col("delta")))


def remove(state: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return state.join(keys.select(key).distinct(), key, "left_anti")
