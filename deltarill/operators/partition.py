"""Sharding: how many, which edge goes where, and what a run needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltarill.session import materialize


def auto_shards(n_edges: int, payload_bytes: int = 4, budget_mb: int = 1024) -> int:
    """Shards so that one takes about an eighth of the budget."""
    # fixed value: the published formula
    return int(1 + n_edges * (2 * 4 + payload_bytes) / (budget_mb * 2**20 / 8) + 0.5)


def shard_sizes(n_edges: int, shards: int) -> list[int]:
    """Edges per shard: one more than the even share first, then the even share of what remains."""
    out, left = [], n_edges
    for done in range(shards):
        take = min(left, left // (shards - done) + (1 if done == 0 and shards > 1 else 0)) if done < shards - 1 else left
        out.append(take)
        left -= take
    return out


def fits_in_memory(n_vertices: int, n_edges: int, budget_mb: int, shards: int = 1) -> bool:
    """Whether state and edges take less than four thirds of the budget, at four bytes a field."""
    # fixed value: the published formula
    return shards == 1 and 2 * n_vertices * 4 + n_edges * 4 + 2 * n_vertices * 4 + n_vertices * 4 < budget_mb * 2**20 / 3 * 4


def _indexed(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """Rows with ``idx``, and how many there are."""
    low = (1 << 33) - 1  # fixed value: of the row ids Spark gives, the low bits are the place in the partition
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ranged = materialize(placed.withColumn("_p", F.shiftright("_m", 33).cast("int")).withColumn("_r", F.col("_m").bitwiseAND(F.lit(low))).drop("_m"))
    before, total = [], 0
    for p, n in sorted((r._p, r.n) for r in ranged.groupBy("_p").agg((F.max("_r") + 1).alias("n")).collect()):
        before.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before or [(0, 0)], "_p int, _before long")
    # one row per range
    return ranged.join(F.broadcast(offsets), "_p").withColumn("idx", F.col("_before") + F.col("_r")).drop("_p", "_r", "_before"), total


def with_index(df: DataFrame, *order: str) -> DataFrame:
    """Rows with ``idx``, their place from 0 in the given order, which must be total for a repeatable result.

    Rows are range-partitioned and sorted once; a place is the place in a range plus the rows of the ranges before (one number each).
    """
    return _indexed(df, *order)[0]


def equal_edge_shards(edges: DataFrame, shards: int, *order: str) -> DataFrame:
    """Edges with ``shard``: contiguous in the given order and of equal size."""
    if shards < 1:
        raise ValueError("shards must be positive")
    indexed, n = _indexed(edges, *order)
    sizes = shard_sizes(n, shards)
    # the first shard may be one larger, the others differ by one at most, so that a place gives its shard up to one
    ends, at = [], 0
    for s in sizes:
        at += s
        ends.append(at)
    bounds = F.array(*[F.lit(e).cast("long") for e in ends])
    guess = F.least(F.floor(F.col("idx") * F.lit(shards) / F.lit(max(n, 1))), F.lit(shards - 1)).cast("int")
    near = F.filter(F.transform(F.array(guess - 1, guess, guess + 1), lambda g: F.greatest(F.lit(0), F.least(g, F.lit(shards - 1)))), lambda g: F.get(bounds, g) > F.col("idx"))
    return indexed.withColumn("shard", F.array_min(near))


def mod_int(key: Column, n: int) -> Column:
    """The remainder with the sign of the key."""
    return key % F.lit(n)


def mod_str(key: Column, n: int) -> Column:
    """By the whole number before the first ``_``; null where there is none."""
    return F.split_part(key, F.lit("_"), F.lit(1)).try_cast("int") % F.lit(n)


def mod_hash(key: Column, n: int) -> Column:
    """By a hash of any key, never negative."""
    return F.pmod(F.xxhash64(key), F.lit(n))
