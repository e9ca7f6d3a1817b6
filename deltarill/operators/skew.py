"""A few keys holding most records: value-frequency compression.

Rows are first grouped by (key, value), which spreads a hot key over as many tasks as it has values and collapses its
repeats before anything is gathered per key; the per-key results then come from the weighted values. Nothing is sampled:
counts, distinct counts, modes and percentiles are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltarill.session import materialize

#: equally filled ranges that the values of a key with many of them are cut into for percentiles. They only place the cuts: whatever they are, the result is exact.
RANGES = 64
#: a key has many values from this share of all weighted values on, so there are at most 1 / MANY of them
MANY = 1 / 1024


def compress(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key_val, value, n``: how often each value occurs under each key; null keys are left out, null values are a value."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key_val"), F.col(value).alias("value")).agg(F.count("*").alias("n"))


def per_key_totals(compressed: DataFrame) -> DataFrame:
    """``key_val, n_rows, n_distinct, mode, mode_rows``: from weighted values; of equally frequent values the least is the mode.

    Null values count in ``n_rows`` only. All aggregates combine before the shuffle by key, so a hot key sends one row a task.
    """
    best = F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("minus"), F.col("value").alias("v")))
    return (
        compressed.groupBy("key_val")
        .agg(F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct"), F.min(best).alias("best"))
        .select("key_val", "n_rows", "n_distinct", F.col("best.v").alias("mode"), (-F.col("best.minus")).alias("mode_rows"))
    )


def per_key_times(compressed: DataFrame) -> DataFrame:
    """``key_val, n_rows, n_distinct, first, last``: from weighted values, nulls counting in ``n_rows`` only."""
    return compressed.groupBy("key_val").agg(
        F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct"), F.min("value").alias("first"), F.max("value").alias("last")
    )


def per_key_sums(compressed: DataFrame) -> DataFrame:
    """``key_val, n_values, total``: number and sum of the values that are not null; ``total`` is null where there is none."""
    return compressed.groupBy("key_val").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("n_values"), F.sum(F.col("value") * F.col("n")).alias("total")
    )


def per_key_percentiles(compressed: DataFrame, shares: list[float]) -> DataFrame:
    """``key_val, share, value``: exact discrete percentiles, the least value at or below which ``share`` of the key's rows lie.

    The values of a key that has many are cut at ``RANGES`` bounds of its own; counts per (key, range) find the range that holds
    each percentile, and only the values of that range are ordered. So a task orders a part of a hot key, or a key with few
    values, never a whole hot key. Weighted values are written once to the shared folder. Null values are left out; a key with
    nulls only gives no row.
    """
    c = materialize(compressed.where("value is not null"))
    per = c.groupBy("key_val").agg(F.count("*").alias("values"))
    total = per.agg(F.sum("values")).first()[0] or 0
    many = per.where(F.col("values") > F.lit(MANY * total)).select("key_val")
    cuts = [i / RANGES for i in range(1, RANGES)]
    # at most 1 / MANY keys, with their bounds
    own = c.join(F.broadcast(many), "key_val", "left_semi").groupBy("key_val").agg(F.percentile_approx("value", cuts, 10 * RANGES).alias("bounds"))
    below = F.size(F.filter("bounds", lambda b: b < F.col("value")))
    ranged = c.join(F.broadcast(materialize(own)), "key_val", "left").select("key_val", "value", "n", F.when(F.col("bounds").isNull(), 0).otherwise(below).alias("r"))
    sums = ranged.groupBy("key_val", "r").agg(F.sum("n").alias("n"))
    by_key = Window.partitionBy("key_val").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    upto = sums.withColumn("upto", F.sum("n").over(by_key)).withColumn(
        "total", F.sum("n").over(Window.partitionBy("key_val"))
    )
    wanted = upto.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    need = F.greatest(F.ceil(F.col("share") * F.col("total")), F.lit(1))
    holds = wanted.where((F.col("upto") >= need) & (F.col("upto") - F.col("n") < need)).select(
        "key_val", "r", "share", (need - (F.col("upto") - F.col("n"))).alias("need")
    )
    in_range = Window.partitionBy("key_val", "r").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(holds.select("key_val", "r").distinct(), ["key_val", "r"], "left_semi").withColumn("cum", F.sum("n").over(in_range))
    return (
        placed.join(holds, ["key_val", "r"])
        .where("cum >= need and cum - n < need")
        .select("key_val", "share", "value")
    )


def heavy_keys(df: DataFrame, key: str, value: str, min_share: float) -> DataFrame:
    """``key_val, n_rows``: keys with at least ``min_share`` of all rows whose key is not null; ties at the limit are in.

    The number of such rows, one number, is counted first. A table without keys gives no row.
    """
    rows = df.agg(F.count(key)).first()[0]
    totals = per_key_totals(compress(df, key, value))
    return totals.where(F.col("n_rows") >= F.lit(min_share * rows)).select("key_val", "n_rows")
