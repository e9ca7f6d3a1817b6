"""Keys that hold much of a table, and joins in which such a key is split over many tasks.

Adaptive execution splits a skewed join only where both sides are bare shuffles; here one side is mostly an aggregate or a
window over its shuffle, so the split is done in the plan: the rows of a hot key are spread by a salt, and the other side's few
rows of that key are repeated for each salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: salts of a hot key: one a task, but so many at least that they spread evenly over few tasks, and so many at most
LEAST_SPLIT, MOST_SPLIT = 64, 1024
#: the least share of the rows that makes a key hot: so there are at most 1 / LEAST_SHARE of them
LEAST_SHARE = 1 / 1024
_BUCKETS = 4096


def hot_keys(df: DataFrame, key: str) -> list:
    """The keys with more rows than half a task's even share, ``LEAST_SHARE`` of all at least; nulls are no keys.

    Rows are counted by hash bucket first and by key only within the buckets that are full enough to hold one, so neither
    count holds or shuffles more than a bounded number of groups per task.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = df.select(F.col(key).alias("k")).where("k is not null").withColumn("b", F.pmod(F.xxhash64("k"), F.lit(_BUCKETS)).cast("int"))
    buckets = {r.b: r.n for r in k.groupBy("b").agg(F.count("*").alias("n")).collect()}
    need = max(LEAST_SHARE, 0.5 / tasks) * sum(buckets.values())
    full = [b for b, n in buckets.items() if n > need]
    if not full:
        return []
    return [r.k for r in k.where(F.col("b").isin(full)).groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > need).select("k").collect()]


def splits(df: DataFrame) -> int:
    """Salts of a hot key."""
    return max(LEAST_SPLIT, min(MOST_SPLIT, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def salt(key: Column, hot: list, n: int, spread: Column) -> Column:
    """0 for most keys; for hot ones a number below ``n`` that depends on ``spread`` alone."""
    return F.when(key.isin(hot), F.pmod(F.xxhash64(spread), F.lit(n)).cast("int")).otherwise(F.lit(0)) if hot else F.lit(0)


def repeated(df: DataFrame, key: str, hot: list, n: int, name: str = "_salt") -> DataFrame:
    """Rows of hot keys once for each salt, the others with salt 0."""
    every = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))
    return df.withColumn(name, F.explode(every))
