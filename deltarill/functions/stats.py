"""Histograms in logarithmic steps, and statistics that merge by adding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values of the histogram
FIRST, BASE, WIDTH = 1e-9, 1.1, 80


def log_bucket(v: Column) -> Column:
    """0 below the first bound, then one step per tenth."""
    return F.when(v < FIRST, 0).otherwise(1 + F.floor(F.log(v / F.lit(FIRST) + F.lit(BASE)) / F.log(F.lit(BASE)))).cast("long")


def bucket_value(b: Column) -> Column:
    """The value a bucket stands for."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.pow(F.lit(BASE), b - 1) * FIRST)


def log_histogram(df: DataFrame, column: str) -> DataFrame:
    """``bucket, n``; nulls are left out."""
    return df.where(F.col(column).isNotNull()).groupBy(log_bucket(F.col(column).cast("double")).alias("bucket")).agg(F.count("*").alias("n"))


def histogram_text(hist: DataFrame) -> DataFrame:
    """``bucket, line``: a bar of at most 80 signs per bucket."""
    most = hist.agg(F.max("n")).first()[0] or 1  # one number
    return hist.select("bucket", F.repeat(F.lit("#"), F.ceil(F.col("n") * WIDTH / F.lit(most)).cast("int")).alias("line"))


def merge_stats(*stats: DataFrame) -> DataFrame:
    """``key, value``: the sum per key over all tables; null values count as 0."""
    return reduce(DataFrame.unionByName, stats).groupBy("key").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))


def uniform(low: float = 0.0, high: float = 1.0, seed: int | None = None) -> Column:
    """A random number from ``low`` up to ``high``; the same in every run for a seed and a partitioning."""
    return F.lit(low) + F.rand(seed) * F.lit(high - low)
